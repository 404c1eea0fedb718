"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word n-grams. Copies of a text (equal 64-bit hash) are one node. Nodes that agree in a band of
MinHash values are candidates; bands are chosen so that a pair at the threshold is missed with a probability of
5e-6. Nodes connected by candidates form a block, and a block's nodes meet once: a block of up to ``block`` nodes and
``block_bytes`` of text in one group, a larger one as chunks, of which every two meet in a group, so no group grows with
the block. N-grams and MinHash values are made of a text once, before they are dealt to its groups. In a group the MinHash
values of candidate pairs are compared step by step, pairs whose posterior probability of reaching the
threshold (uniform prior) is below ``tolerance`` are dropped, and the rest are verified on their n-gram sets. A group
returns the number of links of each node and a spanning forest of them, not the pairs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .components import components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 40
    rows: int = 6
    step: int = 40
    tolerance: float = 1e-6
    block: int = 512
    block_bytes: int = 8_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class _WordIds(dict):
    """A hash of each word, made when it is first asked for. Emptied before a text once it holds 150,000."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_WORD_IDS = _WordIds()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, settings: Settings) -> np.ndarray:
    """The sorted set of a text's word n-grams as 64-bit hashes. Words are runs of ASCII letters and digits (A to Z
    lower-cased) and characters beyond ASCII; a text of fewer words than n is one n-gram, one without words has none."""
    if len(_WORD_IDS) > 150_000:
        _WORD_IDS.clear()
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    ids = np.fromiter(map(_WORD_IDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - settings.words + 1)
    out = np.zeros(n if len(ids) else 0, np.uint64)
    for k in range(min(settings.words, len(ids))):
        out = (out ^ ids[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def min_hashes(grams: np.ndarray, settings: Settings) -> np.ndarray:
    masks, factors = _permutations(settings.hashes)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(settings.hashes, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        np.minimum(out, ((x[start : start + 2048][None, :] ^ masks[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray, settings: Settings) -> np.ndarray:
    """A hash for each band, which also tells the bands apart."""
    v = values.reshape(settings.bands, settings.rows).astype(np.uint64)
    key = np.arange(1, settings.bands + 1, dtype=np.uint64) * _ODD
    for k in range(settings.rows):
        key = (key ^ v[:, k]) * _ODD
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def needed_matches(settings: Settings) -> dict[int, int]:
    """By number of compared values: the fewest matches with which a pair is kept. With a uniform prior, m matches of n
    leave a probability of P(Binomial(n + 1, t) <= m) that the similarity is t or more."""
    out, t = {}, settings.similarity
    for n in range(settings.step, settings.hashes + 1, settings.step):
        below, m = 0.0, -1
        while m < n:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= settings.tolerance:
                break
        out[n] = m
    return out


def linked(left: list[tuple[np.ndarray, np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None, settings: Settings) -> np.ndarray:
    """Index pairs of linked texts, each given as its n-grams, MinHash values and band keys; within ``left`` if
    ``right`` is None."""
    other = left if right is None else right
    met = np.zeros((len(left), len(other)), bool)
    keys, other_keys = np.array([x[2] for x in left]), np.array([x[2] for x in other])
    for b in range(settings.bands):
        met |= keys[:, b][:, None] == other_keys[:, b][None, :]
    if right is None:
        met = np.triu(met, 1)
    i, j = np.nonzero(met)
    values, other_values = np.array([x[1] for x in left]), np.array([x[1] for x in other])
    same = np.zeros(len(i), np.int64)
    for n, least in needed_matches(settings).items():
        same += (values[i, n - settings.step : n] == other_values[j, n - settings.step : n]).sum(axis=1)
        keep = same >= least
        i, j, same = i[keep], j[keep], same[keep]
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = left[x][0], other[y][0]
        if min(len(a), len(b)) < settings.similarity * max(len(a), len(b)):
            continue
        both = len(np.intersect1d(a, b, assume_unique=True))
        if both >= settings.similarity * (len(a) + len(b) - both):
            out.append((x, y))
    return np.array(out, np.int64).reshape(-1, 2)


def _forest(nodes: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of each node to the smallest one of its component."""
    parent = {n: n for n in nodes}

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [(n, root(n)) for n in nodes if root(n) != n]


def _group_rows(c1: int, c2: int, rows: list[tuple[int, int, int, bytes, bytes]], settings: Settings) -> list[tuple[int, int | None, int]]:
    """Rows are node, copies, chunk, n-grams, MinHash values. Out: node, null, linked documents; or node, smaller linked
    node, 0."""
    rows = list({r[0]: r for r in rows}.values())
    known = []
    for r in rows:
        values = np.frombuffer(r[4], np.uint32)
        known.append((np.frombuffer(r[3], np.uint64), values, band_keys(values, settings)))
    if c1 == c2:
        left = right = list(range(len(rows)))
        found = linked(known, None, settings)
    else:
        left, right = ([k for k, r in enumerate(rows) if r[2] == c] for c in (c1, c2))
        found = linked([known[k] for k in left], [known[k] for k in right], settings) if left and right else np.zeros((0, 2), np.int64)
    links, pairs = dict.fromkeys((r[0] for r in rows), 0), []
    for x, y in found.tolist():
        a, b = rows[left[x]], rows[right[y]]
        links[a[0]] += b[1]
        links[b[0]] += a[1]
        pairs.append((a[0], b[0]))
    return [(n, None, k) for n, k in links.items() if k] + [(a, b, 0) for a, b in _forest(list(links), pairs)]


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_key``, ``class_id`` and ``n_links`` of every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their n-gram sets is ``similarity`` or more, or their texts
    are equal. ``class_id`` is the smallest id of those connected by links (its own for one without); ``n_links`` counts
    the documents linked to it. Texts without words, null and empty ones among them, are linked to equal texts only, and
    null counts as empty. Repeated rows are documents of their own. Ids are whole numbers; a class of null ids alone has
    a null id. Other columns are not read.
    """
    return _classes(docs, settings, folder, id_col, text_col).drop("class_key")


def _classes(docs: DataFrame, settings: Settings, folder: str | None, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with ``class_key``, the smallest text key of those connected. Unlike ``class_id`` it tells apart
    classes whose ids are null or repeated."""
    s, spark = settings, docs.sparkSession
    folder = files.run_folder(spark, "near", folder)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                grams = [shingles(t.as_py(), s) for t in part.column(1)]
                rows = [k for k, g in enumerate(grams) if len(g)]
                keys = [band_keys(min_hashes(grams[k], s), s) for k in rows]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["key", "bands"])

    # Copies of a text are reduced to one before bands are exploded; the first of equal rows is the same row.
    base.select("key", "text").mapInArrow(banded, "key long, bands array<long>").groupBy("key").agg(F.first("bands").alias("bands")).write.parquet(f"{folder}/bands")
    bands = spark.read.parquet(f"{folder}/bands").select("key", F.explode("bands").alias("band"))
    # Written tables where a key may be hot: the join then deals out both sides anew, and AQE can split them.
    shared = files.stored(bands.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "low"), f"{folder}/shared")
    blocks = components(bands.join(shared, "band").select(F.col("key").alias("a"), F.col("low").alias("b")), f"{folder}/blocks")

    nodes = base.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("bytes"))
    in_blocks = files.stored(blocks.join(nodes, F.col("node") == F.col("key")).select("label", "key", "first_id", "copies", "bytes"), f"{folder}/in_blocks")
    chunks = F.ceil(F.greatest(F.count("*") / s.block, F.sum("bytes") / s.block_bytes)).cast("int")
    sizes = files.stored(in_blocks.groupBy("label").agg(chunks.alias("chunks")), f"{folder}/sizes")
    placed = in_blocks.join(sizes, "label").select("key", "first_id", "copies", "label", "chunks", F.pmod(F.xxhash64("key", "label"), F.col("chunks")).cast("int").alias("chunk"))
    # A text is taken from one document: by key and id, so that a text with many copies is no hot key.
    texts = base.select("id", F.col("key").alias("k"), "text").join(placed, (F.col("k") == F.col("key")) & F.col("id").eqNullSafe(F.col("first_id")))

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                grams = [shingles(t.as_py(), s) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([g.tobytes() for g in grams], pa.binary()), pa.array([min_hashes(g, s).tobytes() for g in grams], pa.binary()), *part.columns[1:]], ["grams", "minima", *rest])

    rest = ["label", "key", "copies", "chunk", "chunks"]
    known = texts.select("text", *rest).mapInArrow(prepared, "grams binary, minima binary, label long, key long, copies long, chunk int, chunks int")
    groups = known.select("label", "key", "copies", "chunk", "grams", "minima", F.explode_outer(F.expr("transform(sequence(0, chunks - 1), c -> named_struct('c1', least(c, chunk), 'c2', greatest(c, chunk)))")).alias("g")).select("label", "g.c1", "g.c2", "key", "copies", "chunk", "grams", "minima")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []
        kinds = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kinds)

        for batch in batches:
            for label, c1, c2, *row in zip(*(batch.column(i) for i in range(8)), strict=True):
                g = label.as_py(), c1.as_py(), c2.as_py()
                if g != group:
                    if len(held) > 1:
                        out += _group_rows(group[1], group[2], held, s)
                    if len(out) > 100_000:
                        yield rows()
                        out = []
                    group, held = g, []
                held.append(tuple(x.as_py() for x in row))
        if len(held) > 1:
            out += _group_rows(group[1], group[2], held, s)
        yield rows()

    together = groups.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "c1", "c2").sortWithinPartitions("label", "c1", "c2")
    together.mapInArrow(verified, "node long, other long, links long").write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    counts = links.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), f"{folder}/classes")
    ids = nodes.select(F.col("key").alias("node"), "first_id")
    class_ids = files.stored(classes.join(ids, "node").groupBy("label").agg(F.min("first_id").alias("class_id")), f"{folder}/class_ids")
    members = classes.join(class_ids, "label").select(F.col("node").alias("key"), "class_id", F.col("label").alias("class_key")).join(counts.withColumnRenamed("node", "key"), "key", "left")
    told = nodes.join(members.withColumn("in_class", F.lit(True)), "key", "left").select("key", F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("first_id")).alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # From a written table, so that the join deals out both sides anew and AQE can split a text of very many copies.
    told.write.parquet(f"{folder}/told")
    return base.select("id", "key").join(spark.read.parquet(f"{folder}/told"), "key").select(F.col("id").alias(id_col), F.col("key").alias("text_key"), "class_id", "class_key", "n_links")


def keep_one(docs: DataFrame, settings: Settings = Settings(), folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each class of ``near_duplicates`` whose id is the class's, with all columns of ``docs``, whatever these
    are called: of several with that id, one with the smallest text key. Texts of one id, or of null ids, that aren't
    linked are classes of their own, and each keeps a row; so do null and empty texts, one for all. An empty table gives
    no row."""
    found = _classes(docs, settings, folder, id_col, text_col)
    kept_id, kept_key, key = files.unused([*docs.columns, "class_key", "class_id", "text_key", "n_links"], "kept_id", "kept_key", "key")
    n_rows = "rows_of_class"
    kept = files.stored(found.where(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.first("class_id").alias(kept_id), F.min("text_key").alias(kept_key), F.count("*").alias(n_rows)).drop("class_key"), files.run_folder(docs.sparkSession, "kept", folder))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = keyed.join(kept.drop(n_rows), F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return (rows.dropDuplicates([id_col, key]) if kept.where(F.col(n_rows) > 1).limit(1).count() else rows).drop(key)
