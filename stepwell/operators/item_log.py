"""The second dialect, a flat log of items, to steps, calls and results.

No loop walks the log. What a walk would have to remember is a window over a session's items in order: the request that
an item belongs to, the turn that is open, the reasoning just before, the call that an output answers, and the scripts
that are open around a nested call. Lines are parsed once; Python sees only outputs, arguments and nested items that are JSON.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .convert import item_ids
from .steps import naive
from .transcript import request_numbers

_ITEM = "type string, timestamp string, payload struct<type: string, role: string, content: array<string>, summary: array<string>, call_id: string, name: string, arguments: string, input: string, output: string, id: string, action: string, turn_id: string, model: string, info: struct<last_token_usage: struct<input_tokens: bigint, output_tokens: bigint, cached_input_tokens: bigint, cache_write_input_tokens: bigint>>, item: string, internal_chat_message_metadata_passthrough: struct<turn_id: string>>"

#: Record and item types, headers of outputs, kinds of parts of an output.
CALLS = ("function_call", "custom_tool_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")
TURN_OPENS = ("task_started", "turn_started")
TURN_CLOSES = ("task_complete", "turn_complete", "turn_aborted")
SCRIPT_TOOL, COMMAND_TOOL = "exec", "exec_command"
STATUS_ITEMS = ("FileChange", "CollabAgentToolCall")
NESTED_ITEMS = ("McpToolCall", "CommandExecution")
EXIT_HEADER, HEADER_CHARS = r"(?m)^(?:Process exited with code|Exit code:) (-?\d+)\b", 512
SCRIPT_HEADER = r"\AScript (completed|failed|running)\b"
TEXT_PARTS, IMAGE_PARTS = {"text", "input_text"}, {"image", "input_image"}
OTHER_PARTS = {"audio", "input_audio", "resource", "resource_link", "encrypted_content"}
IMAGE_TYPES = {"image/png", "image/jpeg", "image/gif", "image/webp"}
IMAGE_OMITTED = "[image omitted]"


# -- texts of outputs and arguments


def _json(text):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _image_text(part: dict) -> str:
    data, kind = (part.get("data"), part.get("mimeType") or part.get("mime_type")) if part["type"] == "image" else (part.get("image_url"), None)
    if not isinstance(data, str):
        return IMAGE_OMITTED
    if not data.startswith("data:") and "://" in data:
        return f"[image: {data}]"
    url = re.fullmatch(r"data:([^;,]+)[^,]*;base64,(.*)", data, re.DOTALL)
    if url:
        kind, data = url.groups()
    try:
        held = base64.b64decode("".join(data.split()), validate=True) if kind in IMAGE_TYPES else b""
    except (binascii.Error, ValueError):
        held = b""
    return f"[image sha256:{hashlib.sha256(held).hexdigest()} {kind} {len(held)} bytes]" if held else IMAGE_OMITTED


def parts_text(parts) -> str | None:
    """Texts of an output's parts by line; null if it is no list of such parts."""
    if not isinstance(parts, list) or not parts:
        return None
    lines = []
    for part in parts:
        kind = part.get("type") if isinstance(part, dict) else None
        if not isinstance(kind, str) or kind not in TEXT_PARTS | IMAGE_PARTS | OTHER_PARTS:
            return None
        said = part.get("text")
        lines.append(_image_text(part) if kind in IMAGE_PARTS else said if kind in TEXT_PARTS and isinstance(said, str) else json.dumps(part, ensure_ascii=False))
    return "\n".join(lines)


def output_text(raw: str) -> str | None:
    """What an output that looks like JSON says: its parts, or its ``output``; itself if it is neither."""
    value = _json(raw)
    if isinstance(value, dict):
        said = value.get("output")
        return (json.dumps(value, ensure_ascii=False) if value else None) if said is None else _text(said)
    parts = parts_text(value)
    return raw if parts is None else parts


def arguments_text(raw: str | None) -> str:
    """Arguments as a JSON object: text that is no JSON is its ``input``, another value its ``value``, nothing is empty."""
    if raw is None:
        return "{}"
    try:
        value = json.loads(raw) or {}
    except ValueError:
        value = {"input": raw}
    return json.dumps(value if isinstance(value, dict) else {"value": value}, ensure_ascii=False, separators=(",", ":"))


def search_text(raw: str | None) -> str:
    action = _json(raw or "{}")
    action = action if isinstance(action, dict) else {}
    told = {"action_type": action.get("type", "")} | {k: action[k] for k in ("query", "queries", "url") if k in action}
    return json.dumps(told, ensure_ascii=False, separators=(",", ":"))


def nested_call(raw: str) -> tuple[str, str, str | None]:
    """Tool, arguments and result text of a call that a script made, as its completed item tells them."""
    item = json.loads(raw)
    if item.get("type") == "CommandExecution":
        command = item.get("command")
        if isinstance(command, list) and all(isinstance(c, str) for c in command):
            shell = len(command) == 3 and command[1] in ("-c", "-lc")
            command = command[2] if shell else shlex.join(command)
        said = item.get("aggregated_output")
        return COMMAND_TOOL, json.dumps({"cmd": command}, ensure_ascii=False, separators=(",", ":")), said if isinstance(said, str) else None
    given, result, error = item.get("arguments"), item.get("result"), item.get("error")
    tool = f"mcp__{item.get('server')}__{item.get('tool')}"
    given = arguments_text(given if given is None or isinstance(given, str) else json.dumps(given, ensure_ascii=False))
    if isinstance(result, dict):
        parts = result.get("content")
        if "Err" in result:
            return tool, given, _text(result["Err"])
        if not isinstance(parts, list):
            return tool, given, _text(result)
        said = parts_text(parts)
        return tool, given, said if said is not None else _text(parts) if parts else ""
    message = error.get("message") if isinstance(error, dict) else None
    return tool, given, message if isinstance(message, str) else None if error is None else _text(error)


_output_text = F.pandas_udf(lambda s: s.map(output_text, na_action="ignore"), T.StringType())
_arguments_text = F.pandas_udf(lambda s: s.map(arguments_text), T.StringType())
_search_text = F.pandas_udf(lambda s: s.map(search_text), T.StringType())


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("tool_name", "tool_input", "content")]))
def _nested_call(items: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([nested_call(i) for i in items], columns=["tool_name", "tool_input", "content"])


def _said(parts: Column, bare: bool) -> Column:
    """The texts in a list of objects; with ``bare``, strings of the list are texts, too."""
    one = lambda p: F.when(F.ltrim(p).startswith("{"), F.get_json_object(p, "$.text")).otherwise(p if bare else F.lit(None))
    return F.filter(F.transform(parts, one), lambda t: t.isNotNull())


# -- items in order


def items(lines: DataFrame) -> DataFrame:
    """Lines that steps are made of, each with its place in the session, request, turn, the reasoning just before it, and,
    for an output, the call that it answers: the last item of that call id, if it is a call."""
    p, kind = "r.payload", F.col("r.payload.type")
    reply = F.col("r.type") == "response_item"
    event = F.col("r.type") == "event_msg"
    named = F.coalesce(F.col(f"{p}.call_id"), F.lit("")) != ""
    kinds = (
        F.when(reply & (kind == "message"), "message").when(reply & (kind == "reasoning"), "reasoning").when(reply & (kind == "web_search_call"), "search")
        .when(reply & kind.isin(*CALLS) & named, "call").when(reply & kind.isin(*OUTPUTS), "output")
        .when(event & (kind == "token_count"), "count").when(event & kind.isin(*TURN_OPENS), "opens").when(event & kind.isin(*TURN_CLOSES), "closes")
        .when(event & (kind == "item_completed"), "item").when(F.col("r.type") == "turn_context", "context")
    )
    read = item_ids(lines).withColumn("r", F.from_json("value", _ITEM)).withColumn("kind", kinds).where("kind IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("file_rank", "line")).cast("long")
    # An output that is a list speaks by its first text; that it is one, and no text that looks so, its field tells.
    listed = F.when((F.col("kind") == "output") & F.col(f"{p}.output").startswith("["), F.from_json("value", "payload struct<output: array<string>>")["payload"]["output"])
    rows = read.select(
        "session_id", place.alias("line"), "uuid", "kind", F.col("r.timestamp").alias("timestamp"), kind.alias("item_type"),
        F.coalesce(f"{p}.role", F.lit("user")).alias("role"), F.coalesce(F.array_join(_said(F.col(f"{p}.content"), False), ""), F.lit("")).alias("text"),
        F.nullif(F.array_join(_said(F.col(f"{p}.summary"), True), "\n"), F.lit("")).alias("summary"), F.nullif(f"{p}.call_id", F.lit("")).alias("call_id"),
        F.coalesce(f"{p}.name", F.lit("")).alias("name"), F.when(kind == "custom_tool_call", F.col(f"{p}.input")).otherwise(F.col(f"{p}.arguments")).alias("given"),
        F.col(f"{p}.output").alias("output"), F.when(listed.isNotNull(), F.coalesce(F.get(_said(listed, False), F.lit(0)), F.lit(""))).alias("listed"),
        F.col(f"{p}.id").alias("id"), F.col(f"{p}.action").alias("action"), F.col(f"{p}.turn_id").alias("turn_id"),
        F.when(F.col("kind") == "context", F.col(f"{p}.model")).alias("model"), F.when(F.col("kind") == "count", F.col(f"{p}.info.last_token_usage")).alias("usage"),
        F.col(f"{p}.item").alias("item"), F.col(f"{p}.internal_chat_message_metadata_passthrough.turn_id").alias("call_turn"),
    )
    k = F.col("kind")
    answers = rows.withColumn("is_count", k == "count").withColumn("is_output", k.isin("search", "call") | ((k == "message") & (F.col("role") == "assistant")))
    numbered = request_numbers(answers).withColumn("usage", F.when(F.col("ends"), F.col("usage")))
    # Reasoning holds until the next item that could take it.
    takes = k.isin("reasoning", "message", "search", "call", "output")
    by_taker = Window.partitionBy("session_id", "takes").orderBy("line")
    after = takes & (F.lag("kind").over(by_taker) == "reasoning")
    reasoned = numbered.withColumn("takes", takes).withColumn("reasoning", F.when(after, F.lag("summary").over(by_taker))).withColumn("reasoning_uuid", F.when(after, F.lag("uuid").over(by_taker)))
    modelled = reasoned.withColumn("model", F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line"))).over(Window.partitionBy("session_id")))
    # The item before with the same call id.
    keyed = modelled.withColumn("key", F.when(k.isin("call", "output"), F.col("call_id")))
    by_call = Window.partitionBy("session_id", "key").orderBy("line")
    call = F.struct("line", "timestamp", "request", "name", "given", "reasoning")
    met = (k == "output") & F.col("key").isNotNull() & (F.lag("kind").over(by_call) == "call")
    return keyed.withColumn("call", F.when(met, F.lag(call).over(by_call))).drop("takes", "key", "is_count", "is_output", "ends")


# -- outcomes


def _item_outcomes(rows: DataFrame) -> DataFrame:
    """Completed items that say how a call went; ``item_id``, ``is_error``, ``exit_code``, ``type``."""
    read = "type string, id string, status string, exit_code bigint, result struct<isError: boolean, Err: string>"
    done = rows.where("kind = 'item'").withColumn("i", F.from_json("item", read)).where("i.id IS NOT NULL")
    status, code, kind = F.col("i.status"), F.col("i.exit_code"), F.col("i.type")
    failed, completed = F.coalesce(status == "failed", F.lit(False)), F.coalesce(status == "completed", F.lit(False))
    nonzero, zero = F.coalesce(code != 0, F.lit(False)), F.coalesce(code == 0, F.lit(False))
    tool_failed = failed | F.coalesce(F.col("i.result.isError"), F.lit(False)) | F.col("i.result.Err").isNotNull()
    error = F.when(kind == "CommandExecution", F.when(failed | nonzero, True).when(completed | zero, False)).when(kind == "McpToolCall", F.when(tool_failed, True).when(completed, False)).when(kind.isin(*STATUS_ITEMS), F.when(failed, True).when(completed, False))
    out = done.select("session_id", "line", F.nullif("turn_id", F.lit("")).alias("turn"), "item", F.col("i.id").alias("item_id"), kind.alias("type"), error.alias("is_error"), F.when(kind == "CommandExecution", code).alias("exit_code"))
    return out.where("type = 'CommandExecution' OR is_error IS NOT NULL")


def _script_windows(rows: DataFrame) -> DataFrame:
    """Scripts by their first line: ``call_id``, ``turn``, ``opened``, ``closed`` (null if nothing closes it), and whether
    it is the first of its call id."""
    script = (F.col("item_type") == "custom_tool_call") & (F.col("name") == SCRIPT_TOOL)
    ends = rows.where("kind IN ('call', 'output') AND call_id IS NOT NULL").withColumn("script", script).where("script OR kind = 'output'")
    by_call = Window.partitionBy("session_id", "call_id").orderBy("line")
    placed = ends.select("session_id", "call_id", "script", F.nullif("call_turn", F.lit("")).alias("turn"), F.col("line").alias("opened"), F.lead("line").over(by_call).alias("closed"), F.min(F.when(F.col("script"), F.col("line"))).over(Window.partitionBy("session_id", "call_id")).alias("first"))
    return placed.where("script").select("session_id", "call_id", "turn", "opened", "closed", (F.col("first") == F.col("opened")).alias("is_first"))


def _attributed(windows: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the one script that was open in their turn (``script``: where it opened), and scripts with whether an
    item could have been another's, too (``ambiguous``).

    Items and scripts do not meet in a join, which would pair every script of a session with every item. How many are
    open is a running count, and where just one is, the running sum of their places is its place."""
    ends = F.explode(F.array(F.struct(F.col("opened").alias("line"), F.lit(1).alias("d")), F.struct(F.coalesce("closed", F.lit(2**62)).alias("line"), F.lit(-1).alias("d")))).alias("e")
    marks = windows.select("session_id", "turn", "opened", ends).select("session_id", "turn", "opened", "e.*")
    both = marks.unionByName(done.withColumn("d", F.lit(0)), allowMissingColumns=True)
    everywhere = Window.partitionBy("session_id").orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    in_turn = Window.partitionBy("session_id", "turn").orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    free = F.col("turn").isNull()

    def so_far(value: Column) -> Column:
        """Sum up to here over what this row's turn is open to: all, if it has none, else its own and those without one."""
        own_or_free = F.sum(value).over(in_turn) + F.coalesce(F.sum(F.when(free, value)).over(everywhere), F.lit(0))
        return F.when(free, F.sum(value).over(everywhere)).otherwise(own_or_free)

    placed = F.coalesce(F.col("opened"), F.lit(0)) * F.col("d")
    counted = both.withColumn("n", so_far(F.col("d"))).withColumn("place", so_far(placed.cast("decimal(38,0)")))
    doubtful = counted.withColumn("doubts", so_far(F.when((F.col("d") == 0) & (F.col("n") > 1), 1).otherwise(0)))
    found = doubtful.where("d = 0 AND n = 1").select(*done.columns, F.col("place").cast("long").alias("script"))
    unsure = doubtful.where("d <> 0").groupBy("session_id", F.col("opened").alias("script")).agg((F.max("doubts") > F.min("doubts")).alias("ambiguous"))
    return found, unsure


def outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How calls went (session_id, call_id, is_error, exit_code), and the calls that scripts made (session_id, call_id of
    the script, line, item_id, item).

    An item named as a call is that call's; another belongs to the script that alone was open then in its turn. A
    script's output says by its header whether it failed; its exit code is its items' first other than zero, else zero. Another output's
    header or metadata tells its exit code. An item's word goes before an output's, and any failure makes an error."""
    done = _item_outcomes(rows)
    calls = rows.where("kind = 'call'").groupBy("session_id", F.col("call_id").alias("item_id")).agg(F.min("line").alias("called"))
    foreign = done.join(calls, ["session_id", "item_id"], "left").where("called IS NULL OR called > line").drop("called")
    windows = _script_windows(rows)
    found, unsure = _attributed(windows, foreign)
    code = F.col("exit_code")
    made = found.groupBy("session_id", "script").agg(F.max("is_error").alias("item_error"), F.coalesce(F.min_by("exit_code", F.when(code != 0, F.col("line"))), F.max(F.when(code == 0, code))).alias("item_code"))
    scripts = windows.where("is_first").select("session_id", "call_id", F.col("opened").alias("script")).join(unsure, ["session_id", "script"]).join(made, ["session_id", "script"], "left")

    said = rows.where("kind = 'output' AND call_id IS NOT NULL").select("session_id", "call_id", "line", "output", F.coalesce("listed", "output").alias("said"))
    told = said.join(scripts, ["session_id", "call_id"], "left").withColumn("ours", F.coalesce(F.col("script") < F.col("line"), F.lit(False)))
    header = F.regexp_extract("said", SCRIPT_HEADER, 1)
    stated = F.when(F.col("output").startswith("{"), F.get_json_object("output", "$.metadata.exit_code")).otherwise(F.regexp_extract(F.substring("said", 1, HEADER_CHARS), EXIT_HEADER, 1))
    stated = F.when(stated.rlike("^-?[0-9]+$"), stated.try_cast("long"))
    failed = header == "failed"
    mine = F.when(failed & F.col("ambiguous"), F.struct(F.lit(True).alias("is_error"), F.lit(None).cast("long").alias("exit_code"))).when(header.isin("failed", "completed") & ~F.col("ambiguous"), F.struct((failed | F.coalesce("item_error", F.lit(False))).alias("is_error"), F.col("item_code").alias("exit_code")))
    other = F.when(stated.isNotNull(), F.struct((stated != 0).alias("is_error"), stated.alias("exit_code")))
    spoken = told.withColumn("o", F.when(F.col("ours"), mine).otherwise(other)).where("o IS NOT NULL").groupBy("session_id", "call_id").agg(F.min_by("o", "line").alias("o"))
    by_item = done.groupBy("session_id", F.col("item_id").alias("call_id")).agg(F.max("is_error").alias("i_error"), F.min_by("exit_code", F.when(code.isNotNull(), F.col("line"))).alias("i_code"))
    both = by_item.join(spoken, ["session_id", "call_id"], "full")
    ended = both.select("session_id", "call_id", F.when(F.col("i_error") | F.col("o.is_error"), True).otherwise(F.coalesce("i_error", "o.is_error")).alias("is_error"), F.coalesce("i_code", "o.exit_code").alias("exit_code"))
    nested = found.where(F.col("type").isin(*NESTED_ITEMS)).join(scripts.where("NOT ambiguous").select("session_id", "script", "call_id"), ["session_id", "script"])
    # An id that is a call anywhere in the session is no nested call.
    return ended, nested.join(calls, ["session_id", "item_id"], "left_anti").select("session_id", "call_id", "line", "item_id", "item")


# -- steps


def convert_items(lines: DataFrame) -> dict[str, DataFrame]:
    """``steps``, ``tool_calls`` and ``tool_results`` of the second dialect.

    Each message of another role than the assistant's is a step. Between two of them, what belongs to one request is one
    step: its messages joined by a blank line and its calls, in the order in which they were made. A call is there once
    its output is; an output without a call is a call of its own. Token counts are those of the count that ends the
    request, zero as not stated. A step names the records of its calls by call id, its request's messages and searches,
    and the reasoning of either.
    The parsed items are written once to the shared folder. Empty and unreadable lines, and items of other types, make no step; without any the three tables are empty."""
    rows = written(items(lines), "items")
    k = F.col("kind")
    assistant = (k == "message") & (F.col("role") == "assistant")
    message = (k == "message") & (F.col("role") != "assistant")
    assigns = (k.isin("call", "search") | ((k == "output") & F.col("call").isNull())).cast("int")
    order = F.coalesce(F.sum(assigns).over(Window.partitionBy("session_id", "request").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = F.sum(message.cast("int")).over(Window.partitionBy("session_id").orderBy("line"))
    emitted = rows.withColumn("order", order).withColumn("run", run).where("kind IN ('message', 'search', 'output')")
    from_call = lambda c: F.coalesce(F.col(f"call.{c}"), F.col(c))
    own = F.when(F.col("id").rlike(r"\S"), F.col("id")).otherwise(F.concat(F.lit("api_call_"), (F.col("request") + 1).cast("string"), F.lit("_web_search_"), F.col("order").cast("string")))
    events = emitted.select(
        "session_id", "line", "uuid", "kind", "run", "role", "text", "model", "output", "action", assistant.alias("assistant"), message.alias("alone"),
        from_call("request").alias("request"), from_call("timestamp").alias("timestamp"), F.when(F.col("call").isNotNull(), F.col("call.reasoning")).otherwise(F.col("reasoning")).alias("reasoning"),
        F.coalesce("call.line", "line").alias("made"), F.when(k == "search", "web_search_call").otherwise(F.coalesce("call.name", "name")).alias("tool_name"),
        F.when(k == "search", own).otherwise(F.coalesce("call_id", F.lit(""))).alias("tool_use_id"), F.col("call.given").alias("given"),
    )
    # Counts of the request that a call was made in, which its output may come after.
    usages = rows.where("usage IS NOT NULL").select("session_id", "request", "usage")
    at = F.col("line")
    null = lambda kind: F.lit(None).cast(kind)
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("assistant") & (F.col("text") != ""), F.struct("line", "text")))), lambda x: x["text"])
    agents = events.where("NOT alone").groupBy("session_id", "run", "request").agg(
        F.min("line").alias("line"),
        F.coalesce(F.max_by("timestamp", F.when(F.col("assistant") & (F.col("timestamp") != ""), at)), F.min_by("timestamp", "line")).alias("timestamp"),
        F.array_join(texts, "\n\n").alias("message"),
        F.coalesce(F.max_by("reasoning", F.when(F.col("assistant") & F.col("reasoning").isNotNull(), at)), F.min_by("reasoning", F.when(F.col("reasoning").isNotNull(), at))).isNotNull().alias("reasoned"),
        F.first("model").alias("model_name"),
    )
    number = lambda c: F.nullif(F.col(f"usage.{c}"), F.lit(0))
    agents = agents.join(usages, ["session_id", "request"], "left").select("session_id", "run", "request", "line", "timestamp", F.lit("agent").alias("source"), "model_name", "message", "reasoned", number("input_tokens").alias("prompt_tokens"), number("output_tokens").alias("completion_tokens"), number("cached_input_tokens").alias("cached_tokens"), F.col("usage.cache_write_input_tokens").alias("cache_creation"), F.lit(1).cast("long").alias("llm_call_count"), null("string").alias("uuid"))
    users = events.where("alone").select("session_id", "line", "timestamp", F.when(F.col("role") == "user", "user").otherwise("system").alias("source"), F.col("text").alias("message"), F.lit(False).alias("reasoned"), "uuid")
    every = agents.unionByName(users, allowMissingColumns=True)
    numbered = every.withColumn("step_id", F.row_number().over(Window.partitionBy("session_id").orderBy("line")).cast("long")).withColumn("ts", naive(F.col("timestamp")))
    keys = numbered.where("source = 'agent'").select("session_id", "run", "request", "step_id", "ts", "reasoned")
    tools = events.where("kind <> 'message'").join(keys, ["session_id", "run", "request"])

    named = _named(rows, tools, keys)
    flag = lambda n: F.lit(False).alias(n)
    ids = F.when(F.col("uuid").isNotNull(), F.array("uuid")).otherwise(F.col("uuids"))
    steps = numbered.join(named, ["session_id", "step_id"], "left").select("session_id", "step_id", "ts", "source", "model_name", "message", flag("is_sidechain"), flag("is_compact_summary"), "prompt_tokens", "completion_tokens", "cached_tokens", "cache_creation", "llm_call_count", F.to_json(ids).alias("source_uuids"), null("string").alias("agent_id"), null("string").alias("images"))

    ended, made = outcomes(rows)
    first = made.join(tools.groupBy("session_id", F.col("tool_use_id").alias("call_id")).agg(F.min_by(F.struct("step_id", "ts", "made"), F.struct("step_id", "made")).alias("s")), ["session_id", "call_id"])
    earliest = Window.partitionBy("session_id", "item_id").orderBy("s.step_id", "s.made", "line")
    taken = first.join(tools.select("session_id", F.col("tool_use_id").alias("item_id")), ["session_id", "item_id"], "left_anti")
    nested = taken.withColumn("n", F.row_number().over(earliest)).where("n = 1").select("session_id", "s.step_id", "s.ts", F.col("item_id").alias("tool_use_id"), _nested_call("item").alias("c"))
    looks = F.ltrim(F.col("output")).startswith("{") | F.ltrim(F.col("output")).startswith("[")
    content = F.when(F.col("kind") == "output", F.when(looks, _output_text(F.when(looks, F.col("output")))).otherwise(F.col("output")))
    given = F.when(F.col("kind") == "search", _search_text("action")).otherwise(_arguments_text("given"))
    calls = tools.select("session_id", "step_id", "ts", "tool_name", "tool_use_id", given.alias("tool_input")).unionByName(nested.select("session_id", "step_id", "ts", "c.tool_name", "tool_use_id", "c.tool_input"))
    results = tools.select("session_id", "step_id", "ts", F.nullif("tool_use_id", F.lit("")).alias("tool_use_id"), content.alias("content")).unionByName(nested.select("session_id", "step_id", "ts", "tool_use_id", "c.content"))
    flagged = results.join(ended.withColumnRenamed("call_id", "tool_use_id"), ["session_id", "tool_use_id"], "left")
    return {"steps": steps, "tool_calls": calls, "tool_results": flagged.select("session_id", "step_id", "ts", "tool_use_id", "content", "is_error", "exit_code", null("boolean").alias("interrupted"), null("string").alias("images"))}


def _named(rows: DataFrame, tools: DataFrame, keys: DataFrame) -> DataFrame:
    """The records that agent steps are made of, as ``uuids`` by step: those of its call ids, in the order of the ids, then
    the request's messages and searches, then the reasoning before any of them if the step has reasoning."""
    by_call = rows.where("kind IN ('call', 'output') AND call_id IS NOT NULL").select("session_id", F.col("call_id").alias("tool_use_id"), "line", "uuid", "reasoning_uuid")
    called = tools.select("session_id", "step_id", "reasoned", "tool_use_id").distinct().join(by_call, ["session_id", "tool_use_id"])
    told = rows.where("kind = 'search' OR (kind = 'message' AND role = 'assistant')").select("session_id", "request", "line", "uuid", "reasoning_uuid")
    said = keys.join(told, ["session_id", "request"]).withColumn("tool_use_id", F.lit(None).cast("string"))
    both = called.select("session_id", "step_id", "reasoned", F.lit(0).alias("part"), "tool_use_id", "line", "uuid", "reasoning_uuid").unionByName(said.select("session_id", "step_id", "reasoned", F.lit(1).alias("part"), "tool_use_id", "line", "uuid", "reasoning_uuid"))
    # Of two reasonings that one call id took, the later counts.
    latest = both.withColumn("why", F.when(F.col("part") == 1, F.col("reasoning_uuid")).otherwise(F.max_by("reasoning_uuid", F.when(F.col("reasoning_uuid").isNotNull(), F.col("line"))).over(Window.partitionBy("session_id", "step_id", "part", "tool_use_id"))))
    why = latest.where("reasoned AND why IS NOT NULL").select("session_id", "step_id", F.lit(2).alias("part"), F.struct("part", "tool_use_id", "line").alias("at"), F.col("why").alias("uuid"))
    whole = latest.select("session_id", "step_id", "part", F.struct("part", "tool_use_id", "line").alias("at"), "uuid").unionByName(why)
    sorted_ids = F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "uuid"))), lambda x: x["uuid"])
    return whole.groupBy("session_id", "step_id").agg(F.array_distinct(sorted_ids).alias("uuids"))
