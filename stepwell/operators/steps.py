"""Typed rows of the steps, calls and results of trajectories.

``steps`` of a trajectory is an array of JSON texts; one list of expressions types each kind of row, whichever reader
the trajectory came from. Keys of calls and results are taken out before the second explode, so that a step's message
is not copied to each of its calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_columns import elements, text_at


def naive(text: Column) -> Column:
    """A timestamp without a zone: an offset in the text is dropped, an unreadable one is null."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), " ", "T")).cast("timestamp_ntz")


def message_text(step: Column | str) -> Column:
    """A message is a string, or an array of parts whose texts are joined by a blank line. What it is, the step's own
    field tells: read as an array it is null if it is a string, even one that holds JSON. Only messages that begin
    with a bracket are read so."""
    raw = text_at(step, "$.message")
    parts = F.from_json(step, "message array<struct<text: string>>")["message"]
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")) & parts.isNotNull(), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")).otherwise(raw)


def _each(trajectories: DataFrame) -> DataFrame:
    return trajectories.select("session_id", F.explode("steps").alias("step"))


def steps(trajectories: DataFrame) -> DataFrame:
    at = lambda p: text_at("step", f"$.{p}")
    typed = {
        "step_id": at("step_id").cast("long"),
        "ts": naive(at("timestamp")),
        "source": at("source"),
        "model_name": at("model_name"),
        "message": message_text("step"),
        "is_sidechain": F.coalesce(at("extra.is_sidechain").cast("boolean"), F.lit(False)),
        "is_compact_summary": F.coalesce(at("extra.is_compact_summary").cast("boolean"), F.lit(False)),
        "prompt_tokens": at("metrics.prompt_tokens").cast("long"),
        "completion_tokens": at("metrics.completion_tokens").cast("long"),
        "cached_tokens": at("metrics.cached_tokens").cast("long"),
        "cache_creation": F.coalesce(at("metrics.extra.cache_creation_input_tokens"), at("metrics.extra.cache_write_input_tokens")).cast("long"),
        "llm_call_count": at("llm_call_count").cast("long"),
        "source_uuids": at("extra.source_uuids"),
        "agent_id": at("extra.agent_id"),
        "images": at("extra.images"),
    }
    return _each(trajectories).select("session_id", *(c.alias(n) for n, c in typed.items()))


def _inner(trajectories: DataFrame, path: str, name: str) -> DataFrame:
    keys = _each(trajectories).select("session_id", text_at("step", "$.step_id").cast("long").alias("step_id"), naive(text_at("step", "$.timestamp")).alias("ts"), elements("step", path).alias("inner"))
    return keys.select("session_id", "step_id", "ts", F.explode("inner").alias(name))


def tool_calls(trajectories: DataFrame) -> DataFrame:
    rows = _inner(trajectories, "$.tool_calls", "call")
    return rows.select("session_id", "step_id", "ts", text_at("call", "$.function_name").alias("tool_name"), text_at("call", "$.tool_call_id").alias("tool_use_id"), text_at("call", "$.arguments").alias("tool_input"))


def tool_results(trajectories: DataFrame) -> DataFrame:
    """Flags that the transcript does not state stay null. ``content`` is text where the JSON is a string."""
    rows = _inner(trajectories, "$.observation.results", "res")
    at = lambda p: text_at("res", f"$.{p}")
    return rows.select("session_id", "step_id", "ts", at("source_call_id").alias("tool_use_id"), at("content").alias("content"), at("extra.is_error").cast("boolean").alias("is_error"), at("extra.exit_code").cast("long").alias("exit_code"), at("extra.interrupted").cast("boolean").alias("interrupted"), at("extra.images").alias("images"))
