"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Words of test items and training documents are hashed in k-grams, and of each run of consecutive k-grams as long as a
window the smallest hash is kept (leftmost of equal ones). Two texts that share a window of words keep the same k-gram
of it, so joining kept hashes misses no shared window. Each joined hash is then extended: every window of the document
that contains the k-gram is compared, word by word, with the windows of the items. Only windows that are equal count.

An item of at least ``WINDOW`` words has a window at each word; a shorter one is a single window of all its words. For
windows of L words k-grams have min(K, L) words, so each length that occurs among the items (ten at most) is winnowed
by itself, all of them in one pass over the documents.

What the items give (hashes, windows) and the hits are written tables, so Spark knows their true size and broadcasts
them only below ``spark.sql.autoBroadcastJoinThreshold``; beyond, the same plan shuffles. Rows that meet the hashes hold
a document's id and a place, never its words; those of documents with hits are read again to extend them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

WINDOW = 10
K = 5
#: Fixed value: what a word is, after A to Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A null text has none. lower() changes ASCII texts in A to Z alone and is faster than translate()."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _kept(length: int, k: int) -> Column:
    """The winnowed k-grams of ``words`` (``n_words`` of them): hash in the upper and place in the lower half of a long."""
    per_window = length - k + 1
    gram = ", ".join(f"words[i + {j}]" for j in range(k))
    grams = f"transform(sequence(0, n_words - {k}), i -> shiftleft(CAST(hash({gram}) AS BIGINT), 32) | i)"
    if per_window > 1:
        least = ", ".join(f"g[i + {j}]" for j in range(per_window))
        grams = f"transform(array({grams}), g -> array_distinct(transform(sequence(0, n_words - {length}), i -> least({least}))))[0]"
    return F.expr(f"IF(n_words < {length}, CAST(array() AS ARRAY<BIGINT>), {grams})")


def _exploded(rows: DataFrame, lengths: list[int], k: int, heads: bool) -> DataFrame:
    """``rows`` with ``length``, ``h`` and ``at`` of every kept k-gram instead of their words; with ``heads`` also a row of
    length 0 for each row. explode() would make Catalyst copy the whole computation of its array into a filter;
    explode_outer() does not."""
    arrays = ([F.array(F.lit(-1).cast("long"))] if heads else []) + [_kept(n, min(k, n)) for n in lengths]
    which = ([0] if heads else []) + lengths
    others = [c for c in rows.columns if c != "words"]
    each = rows.select(*others, F.posexplode_outer(F.array(*arrays)).alias("which", "kept")).select(*others, F.element_at(F.array(*map(F.lit, which)), F.col("which") + 1).alias("length"), F.explode_outer("kept").alias("x"))
    return each.where("x IS NOT NULL").select(*others, "length", F.shiftright("x", 32).cast("int").alias("h"), F.col("x").bitwiseAND(0x7FFFFFFF).cast("int").alias("at"))


def _span_text(start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice("words", start + 1, length), " ")


def _items(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item``, ``words``, ``n_words`` and ``length`` (of its windows) of items that have words."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words"))
    return rows.where("n_words > 0").withColumn("length", F.least(F.lit(window), F.col("n_words")))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, folder: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: its id, ``text_key`` (a hash of its text), ``n_words``, ``n_hit`` (words inside
    any occurrence of an item's window), ``spans`` (first and behind-last word of each occurrence) and ``items`` (ids,
    as strings, sorted, of the items with occurring windows).

    Null and empty texts have no words and no hit. Repeated rows give a row each; null ids stay null. Equal items count
    each. No item, or none with words: no hit. Texts may be of any length. Only the named columns are read. Intermediate
    tables are written below ``folder``, or the session's shared folder.
    """
    folder = files.run_folder(docs.sparkSession, "leaks", folder)
    test = _items(items, item_id_col, item_text_col, window)
    lengths = sorted(r.length for r in test.select("length").distinct().collect())  # ``window`` at most
    parts = [_exploded(test.where(F.col("length") == n).select("n_words", "words"), [n], k, False).select("length", "h") for n in lengths]
    hashes = files.stored(_union(parts, docs.sparkSession, "length int, h int").distinct(), f"{folder}/hashes")
    starts = F.sequence(F.lit(0), F.col("n_words") - F.col("length"))
    windows = files.stored(test.select("item", F.explode_outer(F.transform(starts, lambda s: _span_text(s, F.col("length")))).alias("span_text")).groupBy("span_text").agg(F.collect_set("item").alias("items")), f"{folder}/windows")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), words(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words"))
    met = _exploded(rows, lengths, k, True).join(hashes.withColumn("found", F.lit(True)), ["length", "h"], "left").where("found OR length = 0")
    hits = files.stored(met.select("id", "text_key", "n_words", "length", "at"), f"{folder}/hits")

    places = hits.where("length > 0").groupBy("id", "text_key").agg(F.collect_set(F.struct("length", "at")).alias("places")).select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), "places")
    # One text for an id and a text key; its words are taken only after the join.
    again = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")).join(places, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))).drop("hit_id", "hit_key")
    worded = again.select("id", "text_key", words(F.col("text")).alias("words"), "places").withColumn("n_words", F.size("words"))

    def around(p: Column) -> Column:
        """The windows that contain a k-gram: first word and length in one long, as arrays of structs have no hashed
        distinct."""
        reach = p["length"] - F.least(F.lit(k), p["length"])
        low, high = F.greatest(p["at"] - reach, F.lit(0)), F.least(p["at"], F.col("n_words") - p["length"])
        return F.transform(F.sequence(low, high), lambda s: F.shiftleft(s.cast("long"), 32) + p["length"])

    def span(x: Column) -> Column:
        start, length = F.shiftright(x, 32).cast("int"), x.bitwiseAND(0x7FFFFFFF).cast("int")
        return F.struct(start.alias("start"), (start + length).alias("end"), _span_text(start, length).alias("span_text"))

    spans = F.array_distinct(F.flatten(F.transform("places", around)))
    extended = worded.withColumn("spans", spans).select("id", "text_key", "n_words", F.explode_outer(F.transform("spans", span)).alias("s"))
    told = extended.join(windows, F.col("s.span_text") == F.col("span_text")).select("id", "text_key", "n_words", F.struct("s.start", "s.end").alias("span"), "items")

    heads = hits.where("length = 0").select("id", "text_key", "n_words", F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
    joined = (
        heads.unionByName(told)
        .groupBy("id", "text_key", "n_words")
        .agg(F.count(F.when(F.col("span").isNull(), 1)).cast("int").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .withColumn("n_hit", F.expr("aggregate(spans, named_struct('end', 0, 'n', 0L), (a, s) -> named_struct('end', greatest(a.end, s.end), 'n', a.n + greatest(0, s.end - greatest(a.end, s.start))), a -> a.n)"))
    )
    return joined.select(F.col("id").alias(id_col), "text_key", F.col("n_words").cast("long").alias("n_words"), "n_hit", "spans", "items", F.explode(F.expr("array_repeat(0, copies)")).alias("copy")).drop("copy")


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contamination(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """``matches`` as counts: the id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``. Nulls, empty
    tables and repeated rows as there."""
    found = matches(docs, items, **columns)
    return found.select(found.columns[0], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns, whatever these are called. Rows meet their verdict
    by id and text hash: null and empty texts stay, of repeated rows all or none, a null id is an id like others. An
    empty table gives no row; no item rejects none."""
    bad_id, bad_key, key = files.unused(docs.columns, "bad_id", "bad_key", "key")
    bad = matches(docs, items, id_col, text_col, **columns).where("n_hit > 0").select(F.col(id_col).alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)
