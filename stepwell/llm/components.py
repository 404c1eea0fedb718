"""Connected components of an edge table, by alternating large and small stars.

Each round links every node's larger neighbours, then its smaller ones, to the smallest node it knows, until the edges
are stars around the smallest node of each component. Minima are taken before a shuffle, so a hub with very many
neighbours is a row a task there. They are a written table before the neighbours meet them: a small one is broadcast, and
with a large one the join deals out both sides anew, so that AQE can split a hub. Each step is a table in the shared
folder, so a lost executor repeats at most a step; tables that a later one replaces are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of every node of ``edges`` (longs ``a``, ``b``).

    Loops and repeated edges do no harm; edges with a null end are none; no edge gives no row. ``folder`` is where the
    steps are written."""

    def stored(rows: DataFrame, name: str) -> DataFrame:
        return files.stored(rows, f"{folder}/{name}")

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, larger: bool, name: str) -> DataFrame:
        """``larger``: neighbours above a node are linked to its least one; else all of a node's smaller neighbours and the
        node itself."""
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), f"{name}-least")
        met = both.join(least, F.col("a") == F.col("n"))
        if larger:
            return stored(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        linked = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return stored(linked.where("a <> b").distinct(), name)

    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round-0")
    seen, k = mark(current), 0
    while seen[0]:
        k += 1
        current = star(star(current, True, f"large-{k}"), False, f"round-{k}")
        now = mark(current)
        for name in (f"large-{k}-least", f"large-{k}", f"round-{k}-least", f"round-{k - 1}"):
            files.remove(f"{folder}/{name}")
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
