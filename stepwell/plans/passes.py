"""Queries of the dataflow passes over relations made of the driver's tables, with the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_columns import text_at
from ..operators import friction, passes, views
from ..session import table
from .inputs import Relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", text_at("props", "$.k").cast("int"))


_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, arg_max(value, event_id) AS reported_cost_usd FROM events WHERE event_type = 'purchase' GROUP BY 1")
def reported_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("session_id"), F.lit("cost-state").alias("event_type"), F.lit(False).alias("is_sidechain"), F.to_json(F.struct(F.col("value").alias("total"))).alias("payload"), F.col("event_id").alias("seq"))
    return passes.reported_cost(events)


@query("""SELECT session_id, '{' || string_agg('"' || t || '":' || n, ',' ORDER BY t) || '}' AS record_counts, sum(n)::BIGINT AS records_total FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def record_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.census(_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("type")))


@query("""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(t, ''), event_id) AS ordinal, event_id FROM (SELECT * FROM (SELECT CAST(user_id % 50 AS VARCHAR) AS session_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 't' || (event_id % 100) END AS t, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 400)::VARCHAR END AS u FROM events) QUALIFY u IS NULL OR row_number() OVER (PARTITION BY session_id, u ORDER BY event_id) = 1)""")
def first_by_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    records = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("session_id"), "event_id", F.when(e % 7 != 0, F.concat(F.lit("t"), (e % 100).cast("string"))).alias("timestamp"), F.when(e % 5 != 0, (e % 400).cast("string")).alias("uuid"), F.lit(0).alias("file_rank"), e.alias("line"))
    return passes.first_by_uuid(records).select("session_id", F.col("ordinal").cast("long").alias("ordinal"), "event_id")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS session_id, 'm' || ({_K} % 5) AS message_id, min(event_id) AS ordinal, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS text, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase')::VARCHAR AS usage, count(DISTINCT {_K} % 3) AS n_calls FROM events GROUP BY 1, 2""")
def bundled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("m"), (F.col("k") % 5).cast("string")).alias("message_id"), F.col("event_id").alias("ordinal"), F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("text"), F.when(F.col("event_type") == "purchase", F.col("value").cast("string")).alias("usage"), (F.col("k") % 3).cast("string").alias("tool_use_id"))
    return passes.bundle(parts).select("session_id", "message_id", "ordinal", "text", "usage", F.size("tool_use_ids").cast("long").alias("n_calls"))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS step_id, 'call-' || event_id AS tool_use_id FROM events WHERE event_type = 'error'")
def dangling_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    return passes.dangling_results(r["tool_results"], r["tool_calls"].where("tool_name <> 'Bash'"))


_COST = "CASE WHEN p > 400 THEN 2e-6 ELSE 1e-6 END"


@query(f"""WITH s AS (SELECT session_id, coalesce(100 + length(text), 0) AS p, CASE WHEN turn % 3 = 0 THEN 50 ELSE 0 END AS r, CASE WHEN turn % 4 = 0 THEN 7 ELSE 0 END AS c, 10 + turn AS o FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, * FROM conversations WHERE role = 'assistant'))
SELECT session_id, round(sum(greatest(p - r - c, 0) * {_COST} + r * 1e-7 + c * {_COST} + o * 5e-6), 9)::DOUBLE AS cost FROM s GROUP BY 1""")
def step_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Relations(spark, sf_dir)["steps"].where("source = 'agent'")
    cost = passes.step_cost(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("cache_creation"), F.col("completion_tokens"), {"input": F.lit(1e-6), "output": F.lit(5e-6), "cache_read": F.lit(1e-7)}, {400: {"input": F.lit(2e-6)}})
    return passes.session_cost(steps.select("session_id", F.lit(True).alias("has_usage"), cost.alias("cost"))).select("session_id", F.round("total_cost_usd", 9).alias("cost"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, sum(100 + length(text))::BIGINT AS total_prompt_tokens, sum(10 + turn)::BIGINT AS total_completion_tokens, sum(CASE WHEN turn % 3 = 0 THEN 50 END)::BIGINT AS total_cached_tokens, sum(CASE WHEN turn % 4 = 0 THEN 7 END)::BIGINT AS total_cache_creation, count(*) AS total_steps FROM conversations WHERE role = 'assistant' GROUP BY 1")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.session_metrics(Relations(spark, sf_dir)["steps"].where("source = 'agent'"))



@query("""WITH t AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'How is it going? ' WHEN 1 THEN 'any updates?' WHEN 2 THEN 'Wait, ' WHEN 3 THEN 'hold on ' WHEN 4 THEN 'No, ' WHEN 5 THEN 'what is the status column' WHEN 6 THEN 'That''s wrong ' ELSE '' END || CASE WHEN doc_id % 8 <> 1 THEN source ELSE '' END AS text FROM documents)
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'status_ping' WHEN 1 THEN 'status_ping' WHEN 2 THEN 'interruption' WHEN 3 THEN 'interruption' WHEN 4 THEN 'correction' WHEN 6 THEN 'correction' END AS label FROM t""")
def friction_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    begins = F.array(*map(F.lit, ("How is it going? ", "any updates?", "Wait, ", "hold on ", "No, ", "what is the status column", "That's wrong ", "")))
    n = F.col("doc_id") % 8
    return table(spark, sf_dir, "documents").select("doc_id", friction.pattern_label(F.concat(F.get(begins, n.cast("int")), F.when(n != 1, F.col("source")).otherwise(""))).alias("label"))


_TURNS = """t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS step_id, conv_id || '-' || turn AS uuid, role, CASE (conv_id + turn) % 4 WHEN 0 THEN 'Undo, that' WHEN 1 THEN 'same body' WHEN 2 THEN 'is it ok?' ELSE 'turn ' || turn END AS message, turn % 3 = 0 AS has_error FROM conversations),
h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step_id) AS place FROM t WHERE role = 'user')"""


@query(f"""WITH {_TURNS},
r AS (SELECT session_id, uuid, 'unmet_expectation' AS label, 0.85 AS c, 0 AS k FROM h WHERE EXISTS (SELECT 1 FROM h g WHERE g.session_id = h.session_id AND g.message = h.message AND g.place < h.place AND g.place >= h.place - 10)
UNION ALL SELECT session_id, uuid, 'correction', 0.9, 1 FROM h WHERE message = 'Undo, that'
UNION ALL SELECT session_id, uuid, 'confusion', 0.85, 2 FROM (SELECT *, lag(has_error) OVER (PARTITION BY session_id ORDER BY step_id) AS b FROM t) WHERE b AND role = 'user' AND message LIKE '%?')
SELECT session_id, uuid, label, c::DOUBLE AS confidence, 'sql' AS source FROM r QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY c DESC, k) = 1""")
def friction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    body = F.when((c + t) % 4 == 0, "Undo, that").when((c + t) % 4 == 1, "same body").when((c + t) % 4 == 2, "is it ok?").otherwise(F.concat(F.lit("turn "), t.cast("string")))
    steps = table(spark, sf_dir, "conversations").select(c.cast("string").alias("session_id"), t.alias("step_id"), F.concat_ws("-", c, t).alias("uuid"), F.col("role").alias("source"), body.alias("message"), (t % 3 == 0).alias("has_error"))
    turns = steps.where("source = 'user'")
    return friction.by_rules(steps, turns, turns)


@query("""WITH s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'other' END AS kind FROM conversations WHERE role IN ('user', 'assistant')), l AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) FILTER (WHERE kind = 'other' AND b = 'human') AS pairs FROM l GROUP BY 1""")
def human_ai_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("step_id"), F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "other").alias("kind"))
    return passes.human_ai_pairs(turns)


@query("SELECT doc_id, substr(sha256(doc_id || chr(0) || lang || chr(0) || source || chr(0)), 1, 16) AS finding_key, CASE WHEN n_chars <= 0 THEN 0 ELSE greatest(1, trunc(n_chars / 3.3)) END::BIGINT AS tokens FROM documents")
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", passes.finding_key(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("finding_key"), passes.tokens_for_chars(F.col("n_chars"), 3.3).alias("tokens"))


_FILES = "f AS (SELECT CAST(user_id AS VARCHAR) AS session_id, 'p' || event_id AS path, event_id * 1000000000 AS mtime_ns, CASE WHEN event_id % 50 <> 0 THEN event_id * 1000000000 + CASE WHEN event_id % 70 = 0 THEN 1 ELSE 0 END END AS seen_ns FROM events)"
_NOW = 9_900 * 10**9


@query(f"""WITH {_FILES} SELECT session_id, CASE WHEN {_NOW} - max(mtime_ns) < 300000000000 THEN 'skipped_live' WHEN bool_or(mtime_ns IS DISTINCT FROM seen_ns) THEN 'to_materialize' ELSE 'up_to_date' END AS bucket FROM f GROUP BY 1""")
def materialization_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    files = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("p"), e.cast("string")).alias("path"), (e * 10**9).alias("mtime_ns"), e)
    seen = files.where("event_id % 50 <> 0").select("path", (F.col("mtime_ns") + F.when(e % 70 == 0, 1).otherwise(0)).alias("seen_ns"))
    return passes.plan(files.drop("event_id"), seen, _NOW)


@query("""WITH w AS (SELECT 'p' || event_id AS path, event_id AS seen_ns, user_id FROM events WHERE event_id % 3 <> 0), n AS (SELECT 'p' || event_id AS path, event_id + 5 AS new_ns, user_id FROM events WHERE event_id % 4 <> 0 AND user_id % 2 = 0)
SELECT path, coalesce(new_ns, seen_ns) AS seen_ns FROM w FULL JOIN n USING (path) WHERE new_ns IS NOT NULL OR coalesce(w.user_id, n.user_id) % 2 <> 0""")
def advanced_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("p"), e.cast("string")).alias("path"), e, "user_id")
    done = rows.where("user_id % 2 = 0").select("session_id").distinct()
    return passes.advance(rows.where("event_id % 3 <> 0").select("session_id", "path", e.alias("seen_ns")), rows.where("event_id % 4 <> 0").select("session_id", "path", (e + 5).alias("mtime_ns")), done)


@query("""WITH r AS (SELECT (doc_id % 700)::VARCHAR AS uuid, text, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 700 ORDER BY doc_id) = 1), s AS (SELECT doc_id::VARCHAR AS uuid, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'old' END AS h FROM documents WHERE doc_id < 300)
SELECT uuid, sha256(text) AS text_hash, h IS NOT NULL AS replaces_existing FROM r LEFT JOIN s USING (uuid) WHERE h IS NULL OR h <> sha256(text)""")
def pending_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select((F.col("doc_id") % 700).cast("string").alias("uuid"), "text", F.col("doc_id").alias("ordinal"))
    stored = docs.where("doc_id < 300").select(F.col("doc_id").cast("string").alias("uuid"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("old").alias("text_hash"))
    return passes.pending_texts(rows, stored).drop("text")


@query("""WITH r AS (SELECT (CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END)::VARCHAR AS uuid, text FROM documents QUALIFY row_number() OVER (PARTITION BY CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END ORDER BY doc_id) = 1), s AS (SELECT doc_id::VARCHAR AS uuid, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'old' END AS h FROM documents WHERE doc_id % 10 < 3)
SELECT uuid, sha256(text) AS text_hash, h IS NOT NULL AS replaces_existing FROM r LEFT JOIN s USING (uuid) WHERE h IS NULL OR h <> sha256(text)""")
def pending_document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pending_texts`` is held to its SQL, which has 700 uuids at most. Here a document's id is its uuid, of every ten
    one repeats another's, and three of every ten are stored."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = docs.select(F.when(n % 10 == 9, n - 1).otherwise(n).cast("string").alias("uuid"), "text", n.alias("ordinal"))
    stored = docs.where(n % 10 < 3).select(n.cast("string").alias("uuid"), F.when(n % 2 == 0, F.sha2("text", 256)).otherwise("old").alias("text_hash"))
    return passes.pending_texts(rows, stored).drop("text")


@query("SELECT CAST(vec_id AS VARCHAR) AS uuid FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.orphans(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("uuid")), table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("uuid")))


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id FROM events WHERE event_id % 2 = 0), n AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id FROM events WHERE event_id % 2 = 1)
SELECT n.session_id, 'n' || n.event_id AS notice, s.event_id AS step_id FROM n ASOF LEFT JOIN s ON n.session_id = s.session_id AND n.ts <= s.ts""")
def placed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id")
    return passes.place_notices(events.where("event_id % 2 = 1").withColumn("notice", F.concat(F.lit("n"), F.col("event_id").cast("string"))), events.where("event_id % 2 = 0").withColumnRenamed("event_id", "step_id"))


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type FROM events WHERE event_id % 2 = 0), r AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type FROM events WHERE event_id % 2 = 1),
p AS (SELECT session_id, place, l.event_type AS a, r.event_type AS b FROM l JOIN r USING (session_id, place)), f AS (SELECT session_id, min(place) AS f FROM p WHERE a <> b GROUP BY 1)
SELECT session_id, place, a FROM p LEFT JOIN f USING (session_id) WHERE f IS NULL OR place < f""")
def zipped_until_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "event_type")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")).cast("long")
    left, right = (events.where(f"event_id % 2 = {k}").select("session_id", place.alias("place"), F.col("event_type").alias(c)) for k, c in ((0, "a"), (1, "b")))
    return passes.zip_until_mismatch(left, right, ["session_id"], "place", F.col("l.a") == F.col("r.b")).select("session_id", "place", "a")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'En' WHEN 'de' THEN 'DE' ELSE lang END AS lang FROM documents")
def folded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.fold_case(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["En", "DE", "Fr", "FR"])


@query("""WITH RECURSIVE c AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE doc_id < 200),
w AS (SELECT i, n_chars AS size, 0 AS call FROM c WHERE i = 1 UNION ALL SELECT c.i, CASE WHEN w.size + c.n_chars > 20000 THEN c.n_chars ELSE w.size + c.n_chars END, CASE WHEN w.size + c.n_chars > 20000 THEN w.call + 1 ELSE w.call END FROM w JOIN c ON c.i = w.i + 1)
SELECT call::BIGINT AS call, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS stop, max(size)::BIGINT AS chars FROM w GROUP BY 1""")
def packed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents below id 200 are one session here: packing is by session, and this is one of that size."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").where("doc_id < 200").select(F.lit("one").alias("session_id"), F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("position"), F.col("n_chars").alias("chars"))
    return passes.pack(docs, 20_000).drop("session_id")


@query(None)
def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed_calls`` is held to its SQL, which packs the documents below id 200. This packs every turn of every
    conversation, a conversation being a session; a null text has no characters. Held against a loop in the tests."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("position"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return passes.pack(turns, 1000)


@query(None)
def narration_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against a loop in the tests."""
    steps = Relations(spark, sf_dir)["steps"]
    author = views.user_steps({"steps": steps}).select("session_id", "step_id", "author")
    marked = steps.join(author, ["session_id", "step_id"], "left")
    mark = F.when((F.col("author") == "human") & ~F.col("is_sidechain"), "human_turn").when(F.col("is_compact_summary"), "compaction").when(F.col("author") == "task_notification", "subagent_end")
    return passes.plan_windows(marked.select("session_id", passes.stream_of(F.col("agent_id"), F.col("is_sidechain")).alias("stream"), F.col("step_id").alias("position"), F.length("message").alias("chars"), mark.alias("mark")), 4000, 500)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= DATE '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rk FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM lineitem) WHERE rk <= 3")
def top_lines_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", rank.alias("rk")).where("rk <= 3")


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1")
def orders_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderdate >= DATE '1995-01-01'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
