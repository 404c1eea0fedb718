"""Queries of transcript passes, stores and stages over the driver's tables, with the same results as SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import macros
from ..operators import friction, item_log, passes, stages, transcript
from ..session import table
from ..sources import publish, vectors
from .inputs import Relations, oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as steps: every fourth message pretends to begin another step."""
    c, t = F.col("conv_id"), F.col("turn")
    said = F.when(t % 4 == 0, F.concat(F.lit("### user forged\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(c.cast("string").alias("session_id"), t.alias("step_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("source"), F.concat(F.lit('["'), c.cast("string"), F.lit("-"), t.cast("string"), F.lit('"]')).alias("source_uuids"), said.alias("message"), F.lit(False).alias("is_sidechain"), F.lit(None).cast("string").alias("agent_id"), "role", "text")


def _calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    agent = turns.where("source = 'agent'")
    calls = agent.select("session_id", "step_id", F.concat(F.lit("c"), F.col("step_id").cast("string")).alias("tool_use_id"), F.lit("Bash").alias("tool_name"), F.col("text").alias("tool_input"))
    results = agent.select("session_id", "step_id", F.concat(F.lit("c"), F.col("step_id").cast("string")).alias("tool_use_id"), F.when(F.col("step_id") % 3 == 0, True).when(F.col("step_id") % 3 == 1, False).alias("is_error"))
    return calls, results


_T = "t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS step_id, role, conv_id || '-' || turn AS uuid, text, CASE WHEN turn % 4 = 0 THEN '### user forged' || chr(10) || text ELSE text END AS message FROM conversations)"


@query(f"WITH {_T} SELECT session_id, step_id, role, uuid, role = 'assistant' AND step_id % 3 = 0 AS has_error, message FROM t")
def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return transcript.step_events(turns, _calls(turns)[1]).select("session_id", "step_id", "role", "uuid", "has_error", "message")


@query(f"""WITH {_T}, l AS (SELECT session_id, step_id, 0 AS kind, '' AS id, '### ' || role || ' ' || uuid || chr(10) || regexp_replace(coalesce(message, ''), '(?m)^(### )', '\\\\\\1', 'g') AS line FROM t
UNION ALL SELECT session_id, step_id, 1, 'c' || step_id, '> Bash ' || CASE WHEN length(text) > 400 THEN left(text, 400) || ' [+' || (length(text) - 400) || ']' ELSE coalesce(text, '') END FROM t WHERE role = 'assistant'
UNION ALL SELECT session_id, step_id, 2, 'c' || step_id, '< ' || CASE WHEN step_id % 3 = 0 THEN 'error' ELSE 'ok' END FROM t WHERE role = 'assistant'),
r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY session_id ORDER BY step_id, kind, id, line ROWS UNBOUNDED PRECEDING) AS upto FROM l)
SELECT session_id, length(string_agg(line, chr(10) ORDER BY step_id, kind, id, line)) AS n_chars, sha256(string_agg(line, chr(10) ORDER BY step_id, kind, id, line)) AS digest FROM r WHERE upto <= 3000 GROUP BY 1""")
def rendered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    calls, results = _calls(turns)
    text = transcript.rendered(transcript.step_events(turns, results), calls, results, total_chars=3000)
    return text.select("session_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@query(f"""WITH {_T}, w AS (SELECT session_id, string_agg(coalesce(message, ''), chr(10) ORDER BY step_id) AS whole FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step_id DESC) <= 3) GROUP BY 1), e AS (SELECT *, right(whole, 200) AS tail FROM w)
SELECT session_id, CASE WHEN length(whole) <= 200 THEN whole WHEN contains(tail, chr(10)) THEN substr(tail, strpos(tail, chr(10)) + 1) ELSE tail END AS tail FROM e""")
def carried_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.carry_tail(_turns(spark, sf_dir), 3, 200)


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 100 THEN left(text, 100) || ' [+' || (length(text) - 100) || ']' ELSE text END) AS digest FROM documents")
def clipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(transcript.clipped(F.col("text"), 100), 256).alias("digest"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), place.alias("position"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), "conv_id")


_P = "p AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, conv_id || '-' || turn AS uuid FROM conversations)"


@query(f"WITH {_P} SELECT session_id, CASE conv_id % 3 WHEN 0 THEN coalesce(max(CASE WHEN uuid = conv_id || '-1' THEN position + 1 END), least(1, count(*))) WHEN 1 THEN least(3, count(*)) ELSE 0 END::BIGINT AS position FROM p GROUP BY session_id, conv_id")
def resume_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _placed(spark, sf_dir)
    c = F.col("conv_id")
    told = steps.select("session_id", "conv_id").distinct().where(c % 3 < 2).select("session_id", F.when(c % 3 == 0, F.concat(c.cast("string"), F.lit("-1"))).otherwise("gone").alias("last_uuid"), F.when(c % 3 == 0, 1).otherwise(3).alias("n_steps"))
    return transcript.resume_positions(steps.drop("conv_id"), told)


@query(f"""WITH {_P}, s AS (SELECT DISTINCT session_id, conv_id FROM p)
SELECT session_id, 0 AS index, coalesce((SELECT position FROM p WHERE p.session_id = s.session_id AND uuid = conv_id || '-0' AND EXISTS (SELECT 1 FROM p q WHERE q.session_id = s.session_id AND q.uuid = s.conv_id || '-1')), 0)::BIGINT AS start, coalesce((SELECT position + 1 FROM p WHERE p.session_id = s.session_id AND uuid = s.conv_id || '-1'), 2)::BIGINT AS stop, EXISTS (SELECT 1 FROM p WHERE p.session_id = s.session_id AND uuid = s.conv_id || '-1') AS by_uuid FROM s
UNION ALL SELECT session_id, 1, 2, 5, false FROM s""")
def located_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _placed(spark, sf_dir)
    c = F.col("conv_id").cast("string")
    each = steps.select("session_id", "conv_id").distinct()
    first = each.select("session_id", F.lit(0).alias("index"), F.concat(c, F.lit("-0")).alias("first_uuid"), F.concat(c, F.lit("-1")).alias("last_uuid"), F.lit(2).alias("n_steps"))
    second = each.select("session_id", F.lit(1).alias("index"), F.lit("gone").alias("first_uuid"), F.concat(c, F.lit("-1")).alias("last_uuid"), F.lit(3).alias("n_steps"))
    return transcript.located_windows(steps.drop("conv_id"), first.unionByName(second))


@query(f"WITH steps AS ({oracle_text('steps')}) SELECT model_name AS model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS input_tokens, sum(completion_tokens)::BIGINT AS output_tokens, sum(CASE WHEN prompt_tokens > 500 THEN prompt_tokens ELSE 0 END)::BIGINT AS long_input_tokens, count(*) FILTER (WHERE prompt_tokens > 500) AS long_calls FROM steps WHERE source = 'agent' GROUP BY 1")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Relations(spark, sf_dir)["steps"].where("source = 'agent'")
    return transcript.usage_sums(steps.select(F.col("model_name").alias("model"), F.col("prompt_tokens").alias("input_tokens"), F.col("completion_tokens").alias("output_tokens")), 500)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS line, event_type FROM events),
ends AS (SELECT session_id, line FROM (SELECT *, lag(line, 1, -1) OVER (PARTITION BY session_id ORDER BY line) AS before FROM e WHERE event_type = 'signup') c WHERE EXISTS (SELECT 1 FROM e WHERE e.session_id = c.session_id AND event_type = 'view' AND e.line > c.before AND e.line < c.line))
SELECT session_id, line, (SELECT count(*) FROM ends WHERE ends.session_id = e.session_id AND ends.line < e.line) AS request FROM e""")
def request_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("line"), (F.col("event_type") == "signup").alias("is_count"), (F.col("event_type") == "view").alias("is_output"))
    return transcript.request_numbers(items).select("session_id", "line", "request")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, event_type FROM events), w AS (SELECT session_id, 'call-' || event_id AS call_id, event_id AS opened, event_id + 300 AS closed FROM e WHERE event_type = 'click')
SELECT session_id, event_id AS line, min(call_id) AS call_id FROM e JOIN w USING (session_id) WHERE event_type = 'purchase' AND opened < event_id AND event_id < closed GROUP BY ALL HAVING count(*) = 1""")
def nested_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("line"), "event_type")
    windows = events.where("event_type = 'click'").select("session_id", F.concat(F.lit("call-"), F.col("line").cast("string")).alias("call_id"), F.col("line").alias("opened"), (F.col("line") + 300).alias("closed"))
    return transcript.nested_outcomes(windows, events.where("event_type = 'purchase'").drop("event_type")).select("session_id", "line", "call_id")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS line, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'error'),
i AS (SELECT *, k % 7 AS c, event_type = 'view' AND k % 3 = 0 AS alone, event_type = 'click' OR (event_type = 'view' AND k % 3 <> 0) AS put_out FROM e),
g AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM i),
n AS (SELECT *, event_type = 'signup' AND bool_or(put_out) OVER (PARTITION BY session_id, gap) AS ends FROM g),
r AS (SELECT *, count(*) FILTER (WHERE ends) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS request, count(*) FILTER (WHERE alone) OVER (PARTITION BY session_id ORDER BY line) AS run FROM n),
o AS (SELECT session_id, line, CASE WHEN lag(event_type) OVER w = 'click' THEN lag(request) OVER w ELSE request END AS made_in, first_value(k % 3 <> 0) OVER (PARTITION BY session_id, c, event_type ORDER BY line) AS failed, event_type FROM r WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY session_id, c ORDER BY line)),
t AS (SELECT r.*, CASE WHEN r.event_type = 'purchase' THEN made_in ELSE request END AS of_request, failed FROM r LEFT JOIN o USING (session_id, line) WHERE r.event_type IN ('view', 'purchase')),
s AS (SELECT session_id, line, 'user' AS source, 'said ' || k AS message, NULL AS of_request, 0 AS n_calls, 0 AS n_failed FROM t WHERE alone
 UNION ALL SELECT session_id, min(line), 'agent', coalesce(string_agg('said ' || k, chr(10) || chr(10) ORDER BY line) FILTER (WHERE event_type = 'view'), ''), of_request, count(*) FILTER (WHERE event_type = 'purchase'), count(*) FILTER (WHERE event_type = 'purchase' AND failed) FROM t WHERE NOT alone GROUP BY session_id, run, of_request)
SELECT s.session_id, row_number() OVER (PARTITION BY s.session_id ORDER BY s.line) AS step_id, source, message, r.line + 1 AS prompt_tokens, n_calls, n_failed FROM s LEFT JOIN r ON r.ends AND r.session_id = s.session_id AND r.request = s.of_request""")
def converted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = item_log.convert_items(_item_lines(spark, sf_dir))
    flags = got["tool_results"].groupBy("session_id", "step_id").agg(F.count("*").alias("n_calls"), F.sum(F.col("is_error").cast("long")).alias("n_failed"))
    return got["steps"].join(flags, ["session_id", "step_id"], "left").select("session_id", "step_id", "source", "message", "prompt_tokens", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


def _item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of items: views are messages, clicks calls, purchases their outputs, signups token counts."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, call = F.col("event_type"), F.concat(F.lit("c"), (F.col("k") % 7).cast("string"))
    said = F.array(F.struct(F.concat(F.lit("said "), F.col("k").cast("string")).alias("text")))
    payload = F.struct(
        F.when(kind == "view", "message").when(kind == "click", "function_call").when(kind == "purchase", "function_call_output").when(kind == "signup", "token_count").otherwise("warning").alias("type"),
        F.when(kind == "view", F.when(F.col("k") % 3 == 0, "user").otherwise("assistant")).alias("role"), F.when(kind == "view", said).alias("content"),
        F.when(kind.isin("click", "purchase"), call).alias("call_id"), F.when(kind == "click", F.to_json(F.struct("k"))).alias("arguments"),
        F.when(kind == "purchase", F.concat(F.lit("Exit code: "), (F.col("k") % 3).cast("string"))).alias("output"),
        F.when(kind == "signup", F.struct(F.struct((F.col("event_id") + 1).alias("input_tokens")).alias("last_token_usage"))).alias("info"),
    )
    record = F.struct(F.when(kind.isin("signup", "error"), "event_msg").otherwise("response_item").alias("type"), payload.alias("payload"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.lit("main.jsonl").alias("source_file"), F.lit(0).alias("file_rank"), F.col("event_id").alias("line"), F.to_json(record).alias("value"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS line, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
w AS (SELECT *, lead(line) OVER (PARTITION BY session_id, k % 5 ORDER BY line) AS closed FROM e WHERE event_type IN ('click', 'purchase')),
x AS (SELECT session_id, line AS script, coalesce(closed, 9223372036854775807) AS closed, k % 3 AS turn, k % 5 AS c, row_number() OVER (PARTITION BY session_id, k % 5 ORDER BY line) AS nth FROM w WHERE event_type = 'click'),
m AS (SELECT e.session_id, e.line, count(*) AS n, min(script) AS script FROM e JOIN x ON x.session_id = e.session_id AND script < e.line AND e.line < x.closed AND (turn = 0 OR e.k % 3 = 0 OR turn = e.k % 3) WHERE event_type = 'view' GROUP BY 1, 2),
bad AS (SELECT DISTINCT x.session_id, x.script FROM x JOIN e ON x.session_id = e.session_id AND x.script < e.line AND e.line < x.closed AND (turn = 0 OR e.k % 3 = 0 OR turn = e.k % 3) AND event_type = 'view' JOIN m ON m.session_id = e.session_id AND m.line = e.line AND m.n > 1)
SELECT m.session_id, m.line, 'c' || c AS call_id, 'item ' || m.line AS item_id FROM m JOIN x ON x.session_id = m.session_id AND x.script = m.script WHERE n = 1 AND nth = 1 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.session_id = x.session_id AND bad.script = x.script)""")
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, none, k = F.col("event_type"), F.lit(None).cast("string"), F.col("k")
    turn = F.when(k % 3 != 0, (k % 3).cast("string"))
    items = e.where("event_type IN ('view', 'click', 'purchase')").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("line"), F.when(kind == "view", "item").when(kind == "click", "call").otherwise("output").alias("kind"),
        F.when(kind == "click", "custom_tool_call").alias("item_type"), F.when(kind == "click", "exec").alias("name"), F.when(kind != "view", F.concat(F.lit("c"), (k % 5).cast("string"))).alias("call_id"),
        F.when(kind == "view", turn).alias("turn_id"), F.when(kind == "click", turn).alias("call_turn"), F.when(kind == "purchase", "Script completed").alias("output"), none.alias("listed"),
        F.when(kind == "view", F.to_json(F.struct(F.lit("CommandExecution").alias("type"), F.concat(F.lit("item "), F.col("event_id").cast("string")).alias("id"), F.lit(0).alias("exit_code")))).alias("item"),
    )
    return item_log.outcomes(items)[1].select("session_id", "line", "call_id", "item_id")


@query("SELECT user_id, median(value) AS median FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 7 GROUP BY user_id HAVING count(*) = 7")
def probe_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.recent_median(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("SELECT 'doc-' || doc_id AS path, CASE doc_id % 9 WHEN 1 THEN 'gone' WHEN 2 THEN 'new' ELSE 'changed' END AS why FROM documents WHERE doc_id % 9 IN (1, 2, 3)")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id") % 9
    text = F.coalesce("text", F.lit(""))
    of = lambda text: docs.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    return publish.changed(of(text).where(n != 2).drop("doc_id"), of(F.when(n == 3, F.concat(text, F.lit("!"))).otherwise(text)).where(n != 1).drop("doc_id"))


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS finding, CASE WHEN doc_id % 5 = 1 THEN 'no_quote' WHEN doc_id % 5 = 2 THEN 'unknown_step' WHEN doc_id % 5 = 3 THEN 'not_said' WHEN trim(regexp_replace(substr(text, 5, 40), '\s+', ' ', 'g')) = '' THEN 'no_quote' END AS dropped FROM documents WHERE text IS NOT NULL""")
def cited_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("doc_id"), F.col("key")
    # No text holds its own digest; rows that repeat an id are findings of their own.
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.concat_ws("-", n.cast("string"), F.sha2("text", 256)).alias("key"))
    steps = docs.select(F.lit("s").alias("session_id"), key.alias("uuid"), F.col("text").alias("message"))
    quote = F.when(n % 5 == 1, " \n").when(n % 5 == 3, key).otherwise(F.regexp_replace(F.substring("text", 5, 40), " ", "\n  "))
    uuid = F.when(n % 5 == 2, F.concat(F.lit("gone-"), key)).otherwise(key)
    verdict = transcript.cited(docs.select(key.alias("finding"), F.lit("s").alias("session_id"), uuid.alias("uuid"), quote.alias("quote")).distinct(), steps)
    return docs.select(key.alias("finding"), n.cast("string").alias("name")).join(verdict, "finding").select(F.col("name").alias("finding"), "dropped")


@query("SELECT CAST(doc_id AS VARCHAR) AS session_id, doc_id % 7 <> 0 AND doc_id % 3 = 0 AND doc_id % 10 <> 4 AS marked, doc_id % 5 = 0 AND doc_id % 4 <> 3 AS again FROM documents WHERE (doc_id % 7 <> 0 AND doc_id % 3 = 0 AND doc_id % 10 <> 4) OR (doc_id % 5 = 0 AND doc_id % 4 <> 3)")
def retained_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    sid = n.cast("string").alias("session_id")
    stored = docs.select(sid, (n % 10).cast("string").alias("folder"), F.when(n % 7 == 0, "then").alias("removed_at"))
    marked = transcript.retained(stored, docs.where(n % 3 != 0).select(sid), spark.createDataFrame([("4",)], "folder string"))
    meta = docs.select(sid, (n % 5 != 0).alias("source_present"), F.when(n % 4 == 3, 11).when(n % 4 == 2, 10).alias("converter_schema"))
    again = transcript.to_convert_again(meta, docs.select(sid), 11)
    both = marked.withColumn("marked", F.lit(True)).join(again.withColumn("again", F.lit(True)), "session_id", "full")
    return both.select("session_id", F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce("again", F.lit(False)).alias("again"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("uuid"), F.lit("m").alias("model"), F.lit(64).alias("dim"), "embedding", F.lit(None).cast("timestamp").alias("embedded_at"))


@query("SELECT CAST(doc_id AS VARCHAR) AS uuid, source AS session_id, substr(text, 1, 200) AS snippet, round(list_cosine_similarity([x::DOUBLE FOR x IN e.embedding], [x::DOUBLE FOR x IN q.embedding]), 6) AS sim FROM embeddings e JOIN documents ON doc_id = e.vec_id, (SELECT embedding FROM embeddings ORDER BY CAST(vec_id AS VARCHAR) LIMIT 1) q WHERE e.vec_id IN (SELECT vec_id FROM embeddings, (SELECT embedding AS p FROM embeddings ORDER BY CAST(vec_id AS VARCHAR) LIMIT 1) ORDER BY 1 - list_cosine_similarity(embedding, p), CAST(vec_id AS VARCHAR) LIMIT 10)")
def searched_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    steps = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uuid"), F.col("source").alias("session_id"), F.col("text").alias("message"))
    return macros.search_steps(rows, steps, rows.orderBy("uuid").first()["embedding"], 10).select("uuid", "session_id", "snippet", F.round("sim", 6).alias("sim"))


@query("SELECT model, dim, count(*) AS n, count(DISTINCT uuid) AS uuids FROM (SELECT 'm' AS model, 64 AS dim, vec_id AS uuid FROM embeddings) GROUP BY ALL")
def vector_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    vectors.check_width(rows)
    halves = [rows.where(F.col("uuid").cast("long") % 2 == k) for k in (0, 1)]
    return vectors.together(halves).groupBy("model", "dim").agg(F.count("*").alias("n"), F.count_distinct("uuid").alias("uuids"))


@query("SELECT CAST(vec_id AS VARCHAR) AS uuid, 'm' AS model, 64 AS dim, [x::DOUBLE FOR x IN embedding][1] AS head FROM embeddings")
def view_message_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import views

    return views.message_embeddings({"vectors": _vectors(spark, sf_dir)}).select("uuid", "model", "dim", F.col("embedding")[0].cast("double").alias("head"))


@query("SELECT median(value) AS median, count(*) AS n FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 7)")
def median_of_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macros.median_of_last(table(spark, sf_dir, "events"), "value", "event_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN '' ELSE 't' || (turn % 5) END, turn::VARCHAR) AS ordinal, turn::VARCHAR AS uuid, role AS type, turn % 2 = 0 AS is_sidechain FROM conversations")
def ordered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    record = F.struct(t.cast("string").alias("uuid"), F.col("role").alias("type"), F.when(t % 3 != 0, F.concat(F.lit("t"), (t % 5).cast("string"))).alias("timestamp"), (t % 2 == 0).alias("isSidechain"))
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.lit("f").alias("source_file"), F.to_json(record).alias("value"))
    return passes.edges_of(lines).select("session_id", F.col("ordinal").cast("long").alias("ordinal"), "uuid", "type", "is_sidechain")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events),
c AS (SELECT DISTINCT session_id, k FROM e WHERE event_type = 'view'), r AS (SELECT session_id, k, event_id, event_type FROM e WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY event_id) = 1)
SELECT session_id, k::VARCHAR AS tool_use_id, 'call' AS kind, r.event_id::VARCHAR AS result FROM c LEFT JOIN r USING (session_id, k)
UNION ALL SELECT session_id, k::VARCHAR, 'orphan', event_id::VARCHAR FROM r ANTI JOIN c USING (session_id, k) WHERE event_type = 'error'""")
def attached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ordinal"), "event_type", (F.get_json_object("props", "$.k").cast("int") % 10).cast("string").alias("tool_use_id"))
    calls = events.where("event_type = 'view'").select("session_id", "tool_use_id").distinct()
    results = events.where("event_type <> 'view'").select("session_id", "tool_use_id", "ordinal", F.col("ordinal").cast("string").alias("content"), F.when(F.col("event_type") == "error", "Bash").alias("tool_name"))
    matched, orphans = passes.attach_results(calls, results)
    return matched.select("session_id", "tool_use_id", F.lit("call").alias("kind"), "result").unionByName(orphans.select("session_id", "tool_use_id", F.lit("orphan").alias("kind"), F.col("content").alias("result")))


@query("SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN doc_id % 4 IS DISTINCT FROM 3 THEN true ELSE false END AS stale, doc_id % 3 = 0 AND doc_id % 2 = 0 AS in_lake, least(power(2, doc_id % 9), 60) AS minutes FROM documents")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    meta = table(spark, sf_dir, "documents").select(n.cast("string").alias("session_id"), F.when(n % 4 == 3, 11).when(n % 4 == 2, 10).alias("converter_schema"), F.lit("m").alias("materialized_at"), n.alias("source_mtime_ns"), n)
    lake = meta.where(n % 3 == 0).withColumn("source_mtime_ns", F.when(n % 2 == 0, n).otherwise(-n - 1))
    fresh, _ = passes.fresh_in_lake(meta, lake)
    stale = passes.stale_generation(meta, 11).withColumn("stale", F.lit(True))
    rows = meta.select("session_id", passes.backoff_minutes(n % 9).alias("minutes")).join(stale, "session_id", "left").join(fresh.withColumn("in_lake", F.lit(True)), "session_id", "left")
    return rows.select("session_id", F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("in_lake", F.lit(False)).alias("in_lake"), "minutes")


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, min(event_id) AS seq, 'task' || (event_id % 20) AS task_id FROM events WHERE event_id % 3 = 0 GROUP BY user_id, event_id % 20")
def task_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    block = F.concat(F.lit("<task-notification>\n<task-id>task"), (e % 20).cast("string"), F.lit("</task-id></task-notification>"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), e.alias("seq"), F.when(e % 3 == 0, F.concat(F.lit("x "), block, F.lit(" <task-notification>none</task-notification>"))).otherwise("nothing").alias("payload"))
    return passes.task_notices(events).select("session_id", "seq", "task_id")


@query("SELECT 'lane' || (event_id % 4) AS lane, max(event_id) FILTER (WHERE event_type = 'view')::VARCHAR AS last_done, max(event_id) FILTER (WHERE event_type = 'error')::VARCHAR AS last_skipped FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def last_per_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    word = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "skipped").otherwise("started")
    lines = table(spark, sf_dir, "events").select(F.format_string("%010d", e).alias("ts"), e.alias("line"), F.concat(F.lit("lane=lane"), (e % 4).cast("string"), F.lit(" run "), word, F.lit(" ok")).alias("value"))
    rows = passes.last_per_lane(lines)
    return rows.select("lane", *(F.col(c).cast("long").cast("string").alias(c) for c in ("last_done", "last_skipped")))


@query("""WITH w AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS index FROM conversations), l AS (SELECT * FROM w WHERE index % 2 = 1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY 100 - index) <= 2)
SELECT * FROM l UNION SELECT session_id, max(index) FROM w GROUP BY 1""")
def selected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("stream"), F.col("turn").alias("index"))
    leads = windows.where("index % 2 = 1").withColumn("rank", 100 - F.col("index"))
    return passes.select_windows(leads.unionAll(leads), windows, 2).select("session_id", "index")


_LINES = ("How's it going?", "any updates?", "hold on a second", "No, that is not it", "That's wrong", "please go on", "")
_SAID = "CASE turn % 8 " + " ".join(f"WHEN {k} THEN '{t.replace(chr(39), chr(39) * 2)}'" for k, t in enumerate(_LINES)) + " ELSE substr(text, 1, 280) END"


@query(f"""WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || turn AS uuid, {_SAID} AS m FROM conversations)
SELECT session_id, uuid, CASE m WHEN 'How''s it going?' THEN 'status_ping' WHEN 'any updates?' THEN 'status_ping' WHEN 'hold on a second' THEN 'interruption' ELSE 'correction' END AS label FROM h
WHERE length(m) BETWEEN 1 AND 300 AND (m IN ('How''s it going?', 'any updates?', 'hold on a second') OR regexp_matches(m, '(?i)^\\s*(no[,\\s.!]|nope[,\\s.!]?|nah[,\\s.!]?|that.?s\\s+(wrong|not\\s+(right|it|what)|incorrect)|wrong\\b)'))""")
def conversation_friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns over whole turns: planted lines and the conversations' own words."""
    t = F.col("turn") % 8
    said = reduce(lambda c, x: c.when(t == x[0], x[1]), list(enumerate(_LINES))[1:], F.when(t == 0, _LINES[0])).otherwise(F.substring("text", 1, 280))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.lit(None).cast("timestamp_ntz").alias("ts"), said.alias("message"))
    return friction.by_pattern(friction.candidates(turns)).select("session_id", "uuid", "label")


@query(f"WITH f AS ({oracle_text('user_friction')}) SELECT label, count(*) AS n, count(DISTINCT session_id) AS sessions FROM f WHERE label <> 'none' AND ts >= (SELECT max(ts) FROM f) - INTERVAL 2 DAY GROUP BY 1")
def friction_counts_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two days of the friction rows themselves, so that the window cuts some and keeps others."""
    rows = Relations(spark, sf_dir)["user_friction"]
    return macros.friction_counts(rows, 2, F.lit(rows.agg(F.max("ts")).first()[0])).select("label", "n", "sessions")


def _answers(texts: list[str]) -> list[str | None]:
    """Stands for a model: its answer follows from the text's length."""
    out: list[str | None] = []
    for t in texts:
        k = len(t) % 9
        if k == 7:
            out.append(stages.REFUSED)
        elif k == 8:
            out.append(None)
        else:
            out.append(json.dumps({"work_category": [*stages.CATEGORIES, "made up"][k], "goal": t[:10], "confidence": 1.5 if len(t) % 10 == 9 else 0.5}))
    return out


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, text, length(text) % 9 AS k FROM documents WHERE text <> '' AND doc_id % 4 <> 1 AND doc_id % 10 <> 3)
SELECT session_id, CASE k WHEN 0 THEN 'sde' WHEN 1 THEN 'admin' WHEN 2 THEN 'strategy_business' WHEN 3 THEN 'events' WHEN 4 THEN 'thought_leadership' WHEN 5 THEN 'other' ELSE 'unknown' END AS work_category, CASE WHEN k < 6 THEN left(text, 10) END AS goal, CASE WHEN k < 6 THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM d WHERE k = 7 OR (k < 6 AND length(text) % 10 <> 9)""")
def classified_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    sessions = docs.select(n.cast("string").alias("session_id"), "text", F.when(n % 4 == 1, "turn_audit").otherwise("interactive").alias("kind"), n.alias("newest"))
    done = docs.where(n % 10 == 3).select(n.cast("string").alias("session_id"))
    return stages.classify(sessions, done, _answers).withColumn("confidence", F.col("confidence").cast("double"))
