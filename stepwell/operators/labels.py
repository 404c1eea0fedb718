"""Views over the label tables that the pipelines append to.

A table may be missing; a view exists only where its table does. Shards of several generations are read by name, so
columns that one lacks are null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import latest

Tables = Mapping[str, DataFrame]
#: Tables that are views as they are.
PASSED_ON = ("session_conflicts", "user_friction", "perceived_errors", "session_narration", "session_reviews")
LABEL_VIEWS: dict[str, Callable[[Tables], DataFrame]] = {name: (lambda t, name=name: t[name]) for name in PASSED_ON}


def view(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    LABEL_VIEWS[f.__name__] = f
    return f


@view
def session_classifications(t: Tables) -> DataFrame:
    """Two retired labels stay as nulls."""
    none = F.lit(None).cast("string")
    return t["session_classifications"].select("session_id", "work_category", "goal", "confidence", "classified_at", none.alias("autonomy_tier"), none.alias("success"), F.col("work_category").alias("category"))


@view
def session_goals(t: Tables) -> DataFrame:
    return t["session_classifications"].select("session_id", "goal", "confidence", "classified_at")


@view
def conflicts_summary(t: Tables) -> DataFrame:
    return t["session_conflicts"].groupBy("session_id").agg(F.count("*").alias("conflict_count"))


@view
def perceived_summary(t: Tables) -> DataFrame:
    rank = F.when(F.col("severity") == "major", 3).when(F.col("severity") == "moderate", 2).otherwise(1)
    told = t["perceived_errors"].groupBy("session_id").agg(F.count("*").alias("n_errors"), F.max(rank).alias("worst"), F.sort_array(F.collect_set("signal")).alias("signals"))
    return told.select("session_id", "n_errors", F.element_at(F.array(F.lit("minor"), F.lit("moderate"), F.lit("major")), F.col("worst")).alias("max_severity"), "signals")


@view
def session_stories(t: Tables) -> DataFrame:
    return latest(t["session_stories"], ["session_id"], F.desc(F.col("window_count") + F.col("subagent_window_count")), F.desc("narrated_at"))


@view
def subagent_stories(t: Tables) -> DataFrame:
    return latest(t["subagent_stories"], ["session_id", "agent_id"], F.desc("window_count"), F.desc("narrated_at"))


@view
def session_findings(t: Tables) -> DataFrame:
    return latest(t["session_findings"], ["finding_key"], F.desc("reviewed_at"))


def read_tables(spark, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables below ``root`` that hold shards, all generations by name."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in names:
        try:
            out[name] = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
        except AnalysisException:
            continue
    return out


def append(rows: DataFrame, root: str, name: str) -> None:
    """New shards of a table; those that are there stay as they are."""
    rows.write.mode("append").option("compression", "zstd").parquet(f"{root}/{name}")
