"""Raw transcript records to steps, calls, results, events, edges and blobs.

Records are rows of ``session_id``, ``source_file``, ``file_rank``, ``line`` and ``value`` (the JSON line). The first
dialect names its records by ``uuid`` and groups an agent's turn by ``message.id``; the second is a flat log of items.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .passes import first_by_uuid
from .views import latest

_BLOCK = "array<struct<type: string, text: string, thinking: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"
_RECORD = "type string, uuid string, parentUuid string, timestamp string, isSidechain boolean, agentId string, isCompactSummary boolean, message struct<id: string, role: string, model: string, content: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>"


def records(lines: DataFrame) -> DataFrame:
    """Parsed records of the first dialect; lines that are no JSON object are dropped."""
    parsed = lines.where(F.ltrim("value").startswith("{")).withColumn("r", F.from_json("value", _RECORD)).where("r.type IS NOT NULL")
    return parsed.select("session_id", "source_file", "file_rank", "line", "value", F.col("r.uuid").alias("uuid"), F.col("r.timestamp").alias("timestamp"), "r")


def convert(lines: DataFrame) -> dict[str, DataFrame]:
    """``steps``, ``tool_calls`` and ``tool_results`` of the first dialect.

    Records with one message id are one step, at the first's place: texts joined by a blank line, the last usage. A call
    id counts once in a session. A result belongs to its call's step; a repeated one is dropped, and one without a call
    is its own step if it names a tool."""
    ordered = first_by_uuid(records(lines)).where("r.type IN ('user', 'assistant')")
    content = F.col("r.message.content")
    is_list = F.ltrim(content).startswith("[") & F.from_json(content, _BLOCK).isNotNull()
    blocks = ordered.select("session_id", "ordinal", "uuid", "timestamp", "r", F.when(is_list, F.from_json(content, _BLOCK)).otherwise(F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), _BLOCK)).alias("blocks"))
    texts = F.filter(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: F.length(F.btrim(t, F.lit(" \t\r\n"))) > 0)
    spoken = blocks.withColumn("text", F.array_join(texts, "\n\n"))
    # A record without a message id is a step of its own.
    agent = spoken.where("r.type = 'assistant'").withColumn("turn", F.coalesce("r.message.id", F.concat(F.lit("record:"), F.col("ordinal").cast("string"))))
    usage = F.col("r.message.usage")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    turns = agent.groupBy("session_id", "turn").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by("timestamp", "ordinal").alias("timestamp"),
        F.array_join(F.filter(parts, lambda t: t != ""), "\n\n").alias("message"),
        F.min_by("r.message.model", F.when(F.col("r.message.model").isNotNull(), F.col("ordinal"))).alias("model_name"),
        F.max_by(usage, F.when(usage.isNotNull(), F.col("ordinal"))).alias("usage"),
        F.min_by(F.struct(F.coalesce("r.isSidechain", F.lit(False)).alias("side"), F.col("r.agentId").alias("agent")), "ordinal").alias("who"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "uuid"))), lambda x: x["uuid"]).alias("uuids"),
    )
    number = lambda c: F.coalesce(F.col(f"usage.{c}"), F.lit(0))
    prompt = F.when(F.col("usage").isNotNull(), number("input_tokens") + number("cache_read_input_tokens") + number("cache_creation_input_tokens"))
    agent_steps = turns.select("session_id", "ordinal", "timestamp", F.lit("agent").alias("source"), "model_name", "message", "who.side", F.lit(False).alias("compact"), prompt.alias("prompt_tokens"), F.col("usage.output_tokens").alias("completion_tokens"), F.col("usage.cache_read_input_tokens").alias("cached_tokens"), F.col("usage.cache_creation_input_tokens").alias("cache_creation"), "who.agent", "uuids")
    null = lambda kind: F.lit(None).cast(kind)
    user_steps = spoken.where("r.type = 'user' AND text <> ''").select("session_id", "ordinal", "timestamp", F.lit("user").alias("source"), null("string").alias("model_name"), F.when(is_list, F.col("text")).otherwise(content).alias("message"), F.coalesce("r.isSidechain", F.lit(False)).alias("side"), F.coalesce("r.isCompactSummary", F.lit(False)).alias("compact"), *(null("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "cache_creation")), F.col("r.agentId").alias("agent"), F.array("uuid").alias("uuids"))

    used = agent.select("session_id", "turn", "ordinal", F.posexplode("blocks").alias("place", "b")).where("b.type = 'tool_use' AND b.id IS NOT NULL")
    calls = latest(used, ["session_id", F.col("b.id")], F.asc("ordinal"), F.asc("place")).join(turns.select("session_id", "turn", F.col("ordinal").alias("step_at"), F.col("timestamp").alias("step_time")), ["session_id", "turn"]).select("session_id", "step_at", F.col("step_time").alias("timestamp"), F.struct("ordinal", "place").alias("rank"), F.col("b.name").alias("tool_name"), F.col("b.id").alias("tool_use_id"), F.when(F.ltrim("b.input").startswith("{"), F.col("b.input")).otherwise(F.to_json(F.struct(F.col("b.input").alias("input")))).alias("tool_input"))
    given = spoken.where("r.type = 'user'").select("session_id", "ordinal", "timestamp", "uuid", F.coalesce("r.isSidechain", F.lit(False)).alias("side"), F.col("r.agentId").alias("agent"), F.posexplode("blocks").alias("place", "b")).where("b.type = 'tool_result' AND b.tool_use_id IS NOT NULL")
    first = latest(given, ["session_id", F.col("b.tool_use_id")], F.asc("ordinal"), F.asc("place")).withColumn("tool_use_id", F.col("b.tool_use_id"))
    matched = first.join(calls.select("session_id", "tool_use_id", "step_at", F.col("timestamp").alias("step_time"), F.col("tool_name").alias("called")), ["session_id", "tool_use_id"], "left")
    orphan = matched.where("step_at IS NULL AND b.name IS NOT NULL")
    orphan_steps = orphan.select("session_id", "ordinal", "timestamp", F.lit("agent").alias("source"), null("string").alias("model_name"), F.lit("").alias("message"), "side", F.lit(False).alias("compact"), *(null("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "cache_creation")), "agent", F.array("uuid").alias("uuids"))

    every = agent_steps.unionByName(user_steps).unionByName(orphan_steps)
    numbered = every.withColumn("step_id", F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal", "source")).cast("long"))
    ids = numbered.where("source = 'agent'").select("session_id", F.col("ordinal").alias("step_at"), "step_id")
    steps = numbered.select("session_id", "step_id", F.to_timestamp_ntz(F.substring("timestamp", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"), "source", "model_name", "message", F.col("side").alias("is_sidechain"), F.col("compact").alias("is_compact_summary"), "prompt_tokens", "completion_tokens", "cached_tokens", "cache_creation", F.when(F.col("source") == "agent", F.lit(1)).cast("long").alias("llm_call_count"), F.to_json("uuids").alias("source_uuids"), F.col("agent").alias("agent_id"), null("string").alias("images"))
    orphan_calls = orphan.select("session_id", F.col("ordinal").alias("step_at"), "timestamp", F.struct("ordinal", "place").alias("rank"), F.col("b.name").alias("tool_name"), "tool_use_id", F.lit("{}").alias("tool_input"))
    time = F.to_timestamp_ntz(F.substring("timestamp", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts")
    all_calls = calls.unionByName(orphan_calls).join(ids, ["session_id", "step_at"])
    results = matched.where("step_at IS NOT NULL OR b.name IS NOT NULL").withColumn("step_at", F.coalesce("step_at", "ordinal")).withColumn("timestamp", F.coalesce("step_time", "timestamp")).join(ids, ["session_id", "step_at"])
    return {
        "steps": steps,
        "tool_calls": all_calls.select("session_id", "step_id", time, "tool_name", "tool_use_id", "tool_input"),
        "tool_results": results.select("session_id", "step_id", time, "tool_use_id", F.col("b.content").alias("content"), F.col("b.is_error").alias("is_error"), exit_code("b.content", "b.is_error", F.coalesce("called", "b.name")).alias("exit_code"), null("boolean").alias("interrupted"), null("string").alias("images")),
    }


def exit_code(content: str, is_error: str, tool: Column) -> Column:
    """Of a failed shell command, as its output begins with it; other tools have none."""
    return F.when(F.col(is_error) & (tool == "Bash"), F.nullif(F.regexp_extract(content, r"^\s*Exit code (\d+)", 1), F.lit("")).cast("long"))


# -- events beside the messages

MAX_BYTES, MAX_STRING, MAX_ITEMS, MAX_DEPTH = 8192, 2048, 32, 8
#: Kept records, and keys that are columns or noise.
SYSTEM_SUBTYPES = ("stop_hook_summary", "api_error", "compact_boundary", "model_refusal_fallback")
WHOLE_TYPES = ("cost-state", "mode", "permission-mode")
ENVELOPE = {"type", "subtype", "uuid", "parentUuid", "timestamp", "isSidechain", "toolUseID", "sessionId", "userType", "entrypoint", "cwd", "version", "gitBranch", "slug", "isMeta", "attachment", "rendered"}
SECOND_EVENTS = ("turn_aborted", "error", "stream_error", "context_compacted", "warning")


_BOUNDED = T.StructType([T.StructField("payload", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_truncated", T.BooleanType())])
_BLOB = T.StructType([T.StructField("sha256", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("bytes", "width", "height")), T.StructField("data", T.BinaryType())])


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _cut(value, depth: int = 0):
    if isinstance(value, (dict, list)) and depth >= MAX_DEPTH:
        value = _text(value)
    if isinstance(value, str):
        return value if len(value) <= MAX_STRING else value[:MAX_STRING] + "…"
    if isinstance(value, dict):
        return {k: _cut(v, depth + 1) for k, v in value.items()}
    return [_cut(v, depth + 1) for v in value[:MAX_ITEMS]] if isinstance(value, list) else value


def bounded(payload: dict) -> tuple[str, int, bool]:
    """The payload as JSON text of at most ``MAX_BYTES``, its size before, and whether anything was cut."""
    whole = _text(payload)
    size = len(whole.encode())
    if size <= MAX_BYTES:
        return whole, size, False
    short = _text(_cut(payload))
    if len(short.encode()) > MAX_BYTES:
        short = _text({"truncated_preview": whole.encode()[:MAX_BYTES].decode(errors="ignore")})
    return short, size, True


@F.pandas_udf(_BOUNDED)
def _bound_first(values: pd.Series) -> pd.DataFrame:
    out = []
    for value in values:
        record = json.loads(value)
        payload = {k: v for k, v in record.items() if k not in ENVELOPE}
        attachment = record.get("attachment")
        if isinstance(attachment, dict):
            payload |= {k: v for k, v in attachment.items() if k not in ("type", "toolUseID")}
        out.append(bounded(payload))
    return pd.DataFrame(out, columns=["payload", "payload_bytes", "payload_truncated"])


@F.pandas_udf(_BOUNDED)
def _bound_second(values: pd.Series) -> pd.DataFrame:
    payloads = (json.loads(v).get("payload") for v in values)
    return pd.DataFrame([bounded({k: v for k, v in p.items() if k != "type"} if isinstance(p, dict) else {}) for p in payloads], columns=["payload", "payload_bytes", "payload_truncated"])


def _numbered_events(kept: DataFrame, bound, tool_use_id: Column, parent: Column, side: Column) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("file_rank", "line")) - 1
    rows = kept.select("session_id", seq.cast("long").alias("seq"), F.get_json_object("value", "$.timestamp").alias("ts"), "event_type", "subtype", "uuid", parent.alias("parent_uuid"), tool_use_id.alias("tool_use_id"), side.alias("is_sidechain"), "source_file", bound("value").alias("p"))
    return rows.select(*rows.columns[:-1], "p.payload", "p.payload_bytes", "p.payload_truncated")


def session_events(lines: DataFrame) -> DataFrame:
    """Kept records of the first dialect that are no messages, numbered in record order."""
    at = lambda p: F.get_json_object("value", f"$.{p}")
    kind, attached = at("type"), at("attachment.type")
    subtype = F.when((kind == "system") & at("subtype").isin(*SYSTEM_SUBTYPES), at("subtype")).when((kind == "attachment") & ((attached == "queued_command") | attached.startswith("hook_")), attached)
    rows = lines.select("*", kind.alias("event_type"), subtype.alias("subtype"), at("uuid").alias("uuid")).where(F.col("event_type").isin(*WHOLE_TYPES) | F.col("subtype").isNotNull())
    return _numbered_events(rows, _bound_first, F.coalesce(at("toolUseID"), at("attachment.toolUseID")), at("parentUuid"), F.coalesce(at("isSidechain").cast("boolean"), F.lit(False)))


# -- the second dialect


def item_ids(lines: DataFrame) -> DataFrame:
    """Lines with ``uuid``: the payload's id, else type and ordinal, else type and line; an id that an earlier record has
    gives way to type and line."""
    at = lambda p: F.get_json_object("value", f"$.{p}")
    kind = F.coalesce(F.nullif(at("type"), F.lit("")), F.lit("record"))
    by_line = F.concat(kind, F.lit(":L"), F.col("line").cast("string"))
    own = F.coalesce(F.nullif(at("payload.id"), F.lit("")), F.when(at("ordinal").rlike("^-?[0-9]+$"), F.concat(kind, F.lit(":"), at("ordinal"))), by_line)
    again = F.row_number().over(Window.partitionBy("session_id", "own").orderBy("file_rank", "line")) > 1
    return lines.select("session_id", "source_file", "file_rank", "line", "value", own.alias("own"), by_line.alias("by_line")).select("session_id", "source_file", "file_rank", "line", "value", F.when(again, F.col("by_line")).otherwise(F.col("own")).alias("uuid"))


def item_edges(lines: DataFrame) -> DataFrame:
    """An edge for every record, in file order."""
    at = lambda p: F.get_json_object("value", f"$.{p}")
    kind, item = F.coalesce(F.nullif(at("type"), F.lit("")), F.lit("record")), at("payload.type")
    edge_type = F.when(kind == "response_item", F.when(item == "message", F.coalesce(F.nullif(at("payload.role"), F.lit("")), F.lit("message"))).otherwise(item)).when(kind == "event_msg", F.concat(F.lit("event"), F.coalesce(F.concat(F.lit(":"), item), F.lit("")))).otherwise(at("type"))
    return item_ids(lines).select("session_id", "uuid", F.lit(None).cast("string").alias("parent_uuid"), F.when(item == "message", at("payload.id")).alias("message_id"), edge_type.alias("type"), at("timestamp").alias("ts"), F.lit(False).alias("is_sidechain"), (kind == "compacted").alias("is_compact_summary"), "source_file", "file_rank", "line")


def item_events(lines: DataFrame) -> DataFrame:
    at = lambda p: F.get_json_object("value", f"$.{p}")
    kind, item = at("type"), at("payload.type")
    rows = item_ids(lines).select("*", kind.alias("event_type"), F.when((kind == "event_msg") & item.isin(*SECOND_EVENTS), item).alias("subtype"))
    none = F.lit(None).cast("string")
    return _numbered_events(rows.where("event_type = 'compacted' OR subtype IS NOT NULL"), _bound_second, none, none, F.lit(False))


def item_metrics(lines: DataFrame) -> DataFrame:
    """Totals of the last token count that states them; zero counts as not stated, a stated cost of zero as stated."""
    at = lambda p: F.get_json_object("value", f"$.payload.{p}")
    usage = "info.total_token_usage"
    rows = lines.where((F.get_json_object("value", "$.type") == "event_msg") & (at("type") == "token_count") & at(usage).startswith("{"))
    number = lambda p: F.nullif(at(f"{usage}.{p}").cast("long"), F.lit(0))
    told = rows.select("session_id", F.struct("file_rank", "line").alias("at"), F.struct(number("input_tokens").alias("total_prompt_tokens"), number("output_tokens").alias("total_completion_tokens"), number("cached_input_tokens").alias("total_cached_tokens"), F.coalesce(at("info.total_cost"), at("info.cost_usd")).cast("double").alias("total_cost_usd")).alias("m"))
    return told.groupBy("session_id").agg(F.max_by("m", "at").alias("m")).select("session_id", "m.*")


# -- attachments


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height of a PNG, GIF or JPEG image, as far as its header tells."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
            at += 2 + length
    return None, None


@F.pandas_udf(_BLOB)
def decoded_blob(texts: pd.Series) -> pd.DataFrame:
    """What a strict base64 text holds; all null where it is none or empty."""
    out = []
    for text in texts:
        try:
            data = base64.b64decode(text or "", validate=True)
        except (binascii.Error, ValueError):
            data = b""
        width, height = image_size(data)
        out.append((hashlib.sha256(data).hexdigest(), len(data), width, height, data) if data else (None,) * 5)
    frame = pd.DataFrame(out, columns=["sha256", "bytes", "width", "height", "data"])
    return frame.astype({c: "Int64" for c in ("bytes", "width", "height")})


def blobs(attachments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (a row for each attachment that is one) and blobs (a row for each content) of rows with ``media_type``
    and ``text``."""
    found = attachments.withColumn("b", decoded_blob("text")).where("b.sha256 IS NOT NULL").drop("text")
    return found.select(*(c for c in found.columns if c != "b"), "b.sha256", "b.bytes", "b.width", "b.height"), found.groupBy("b.sha256").agg(F.first("b.data").alias("data"))
