"""The transcript views, each a function of the relations it reads.

Relations are a mapping of name to DataFrame: ``steps``, ``tool_calls``, ``tool_results``, ``edges``, ``trajectories``,
``loss``, ``events`` as the readers give them. ``register`` makes every view a temporary view.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.authorship import VERDICT_NOT_OK, VERDICT_OK, is_interrupt, step_author
from ..functions.json_columns import elements, text_at

Relations = Mapping[str, DataFrame]
STEP_COLUMNS = ["session_id", "step_id", "ts", "source", "model_name", "message", "is_sidechain", "is_compact_summary", "prompt_tokens", "completion_tokens", "cached_tokens", "cache_creation", "llm_call_count", "source_uuids", "agent_id", "images"]
SPAWN_TOOLS = ("Task", "Agent")
CREATE_TOOLS = ("TaskCreate", "mcp__tasks__task_create")
UPDATE_TOOLS = ("TaskUpdate", "mcp__tasks__task_update")
COMMAND_NAME = "<command-name>/([A-Za-z0-9_:.-]+)</command-name>"
COMMAND_ARGS = "<command-args>([^<]*)</command-args>"

VIEWS: dict[str, Callable[[Relations], DataFrame]] = {}


def view(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
    VIEWS[f.__name__] = f
    return f


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


@view
def steps(r: Relations) -> DataFrame:
    return r["steps"].select(*STEP_COLUMNS)


@view
def sessions(r: Relations) -> DataFrame:
    span = r["steps"].groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count_if(F.col("source") == "agent").alias("agent_steps"), F.count("*").alias("step_count"))
    extra = F.col("agent.extra")
    return r["trajectories"].join(span, "session_id", "left").select(
        "session_id",
        F.col("agent.name").alias("agent"),
        F.col("agent.version").alias("agent_version"),
        F.coalesce(text_at(extra, "$.cwds[0]"), text_at(extra, "$.cwd")).alias("cwd"),
        F.coalesce(text_at(extra, "$.git_branches[0]"), text_at(extra, "$.git.branch")).alias("git_branch"),
        "started_at",
        "ended_at",
        "agent_steps",
        "step_count",
        F.col("agent.model_name").alias("model_name"),
        F.col("final_metrics.total_cost_usd").alias("total_cost_usd"),
        text_at(F.col("final_metrics.extra"), "$.reported_cost_usd").cast("double").alias("reported_cost_usd"),
        "trajectory_path",
        "corpus",
    )


@view
def messages(r: Relations) -> DataFrame:
    return r["edges"].select("uuid", "parent_uuid", "session_id", "ts", "type", "is_sidechain", F.coalesce("is_compact_summary", F.lit(False)).alias("is_compact_summary"), "message_id", "source_file")


@view
def tool_calls(r: Relations) -> DataFrame:
    return r["tool_calls"].select("session_id", "step_id", "ts", "tool_name", "tool_use_id", "tool_input")


@view
def tool_results(r: Relations) -> DataFrame:
    return r["tool_results"].select("session_id", "step_id", "ts", "tool_use_id", "content", "is_error", "exit_code", "interrupted", "images")


@view
def todo_events(r: Relations) -> DataFrame:
    """Items of one call keep their place in its list as the last tiebreak of ``snapshot_ix``."""
    items = r["tool_calls"].where("tool_name = 'TodoWrite'").select("session_id", "ts", "step_id", F.posexplode(elements("tool_input", "$.todos")).alias("place", "todo"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "step_id", "place"))
    return items.select("session_id", F.col("ts").alias("written_at"), "step_id", text_at("todo", "$.content").alias("subject"), text_at("todo", "$.status").alias("status"), text_at("todo", "$.activeForm").alias("active_form"), number.cast("long").alias("snapshot_ix"))


@view
def todo_state_current(r: Relations) -> DataFrame:
    return latest(todo_events(r), ["session_id", "subject"], F.desc("snapshot_ix")).select("session_id", "subject", "status", "active_form", "written_at")


def _calls(r: Relations, tools: tuple[str, ...], when: str, tool: str, **fields: str) -> DataFrame:
    return r["tool_calls"].where(F.col("tool_name").isin(*tools)).select("session_id", F.col("ts").alias(when), "step_id", "tool_use_id", F.col("tool_name").alias(tool), *(text_at("tool_input", path).alias(name) for name, path in fields.items()))


@view
def subagent_spawns(r: Relations) -> DataFrame:
    return _calls(r, SPAWN_TOOLS, "spawned_at", "spawn_tool", subagent_type="$.subagent_type", description="$.description", prompt="$.prompt", run_in_background="$.run_in_background")


@view
def task_creations(r: Relations) -> DataFrame:
    return _calls(r, CREATE_TOOLS, "created_at", "create_tool", subject="$.subject", description="$.description", active_form="$.activeForm", metadata="$.metadata")


@view
def task_updates(r: Relations) -> DataFrame:
    rows = _calls(r, UPDATE_TOOLS, "updated_at", "update_tool", task="$.taskId", id="$.id", status="$.status", add_blocked_by="$.addBlockedBy", owner="$.owner")
    return rows.select("session_id", "updated_at", "step_id", "tool_use_id", "update_tool", F.coalesce("task", "id").alias("task_id"), "status", "add_blocked_by", "owner")


@view
def tasks_state_current(r: Relations) -> DataFrame:
    """A creation's task id comes from its result's prose, its result's JSON, or its number within the session. Updates
    at one time are taken by step."""
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "step_id", "tool_use_id"))
    prose = F.nullif(F.regexp_extract("content", r"Task #(\d+)", 1), F.lit(""))
    # The ids are taken out of the results before these are shuffled to their calls.
    told = r["tool_results"].select("tool_use_id", F.coalesce(prose, text_at("content", "$.taskId")).alias("told_id"))
    creations = task_creations(r).join(told, "tool_use_id", "left").select("session_id", "created_at", "subject", "active_form", F.coalesce("told_id", number.cast("string")).alias("task_id"))
    status = latest(task_updates(r).where("task_id IS NOT NULL"), ["session_id", "task_id"], F.desc("updated_at"), F.desc("step_id")).select("session_id", "task_id", "status", "updated_at")
    return creations.join(status, ["session_id", "task_id"], "left").select("session_id", "task_id", "subject", "active_form", F.coalesce("status", F.lit("pending")).alias("status"), "created_at", F.col("updated_at").alias("last_updated_at"))


@view
def skill_invocations(r: Relations) -> DataFrame:
    skill = text_at("tool_input", "$.skill")
    by_tool = r["tool_calls"].where((F.col("tool_name") == "Skill") & skill.isNotNull()).select("session_id", "ts", "step_id", F.lit("tool").alias("source"), skill.alias("skill_id"), text_at("tool_input", "$.args").alias("args"), "tool_use_id")
    name = F.regexp_extract("message", COMMAND_NAME, 1)
    by_command = r["steps"].where((F.col("source") == "user") & F.col("message").like("%<command-name>/%") & (name != "")).select("session_id", "ts", "step_id", F.lit("slash_command").alias("source"), name.alias("skill_id"), F.nullif(F.regexp_extract("message", COMMAND_ARGS, 1), F.lit("")).alias("args"), F.lit(None).cast("string").alias("tool_use_id"))
    return by_tool.unionByName(by_command)


@view
def skill_usage(r: Relations) -> DataFrame:
    colon = F.instr("skill_id", ":")
    return skill_invocations(r).select("*", F.when(colon > 0, F.substring("skill_id", colon + 1, F.length("skill_id"))).otherwise(F.col("skill_id")).alias("skill_name"), F.when(colon > 0, F.split_part("skill_id", F.lit(":"), F.lit(1))).alias("plugin"), (colon == 0).alias("is_builtin"))


@view
def subagent_steps(r: Relations) -> DataFrame:
    return steps(r).where("is_sidechain")


@view
def subagents(r: Relations) -> DataFrame:
    fields = {"agent_id": "string", "agent_type": "string", "description": "string", "parent_tool_call_id": "string", "link_source": "string", "spawn_depth": "long", "parent_agent_id": "string"}
    declared = r["trajectories"].select("session_id", F.explode(elements("extra", "$.subagents")).alias("a")).select("session_id", *(text_at("a", f"$.{c}").cast(k).alias(c) for c, k in fields.items()))
    activity = r["steps"].where("agent_id IS NOT NULL").groupBy("session_id", "agent_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    spawns = subagent_spawns(r).select("session_id", F.col("tool_use_id").alias("parent_tool_call_id"), F.col("step_id").alias("parent_step_id"), "subagent_type", F.col("description").alias("spawn_description"))
    joined = declared.join(activity, ["session_id", "agent_id"], "left").join(spawns, ["session_id", "parent_tool_call_id"], "left")
    return joined.select("session_id", "agent_id", F.coalesce("agent_type", "subagent_type").alias("agent_type"), F.coalesce("description", "spawn_description").alias("description"), "parent_tool_call_id", "parent_step_id", "link_source", "spawn_depth", "parent_agent_id", "first_ts", "last_ts", F.coalesce("n", F.lit(0)).alias("step_count"))


@view
def images(r: Relations) -> DataFrame:
    keys = ["session_id", "step_id", "ts", "origin", "tool_use_id"]
    shown = r["tool_results"].withColumn("origin", F.lit("tool_result")).select(*keys, F.explode(elements("images", "$")).alias("img"))
    pasted = r["steps"].withColumns({"origin": F.lit("user_message"), "tool_use_id": F.lit(None).cast("string")}).select(*keys, F.explode(elements("images", "$")).alias("img"))
    sha = text_at("img", "$.sha256")
    path = F.concat(F.lit("blobs/sha256/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit("."), text_at("img", "$.extension"))
    return shown.unionByName(pasted).select(*keys, sha.alias("sha256"), text_at("img", "$.media_type").alias("media_type"), text_at("img", "$.bytes").cast("long").alias("size_bytes"), text_at("img", "$.width").cast("long").alias("width"), text_at("img", "$.height").cast("long").alias("height"), path.alias("blob_path"))


@view
def loss_reports(r: Relations) -> DataFrame:
    return r["loss"].select("session_id", "records_total", "records_converted", "records_captured", "records_dropped", "gaps_observed", "record_counts", "subagent_files_found", "subagent_files_convertible", "workflow_subagent_files_found", "report_path")


@view
def session_events(r: Relations) -> DataFrame:
    return r["events"].select("session_id", "seq", "ts", "event_type", "subtype", "uuid", "parent_uuid", "tool_use_id", F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"), "source_file", "payload", "payload_bytes", F.coalesce("payload_truncated", F.lit(False)).alias("payload_truncated"))


@view
def message_embeddings(r: Relations) -> DataFrame:
    return r["vectors"].select("uuid", "model", "dim", "embedding", "embedded_at")


def _author() -> Column:
    return F.when(F.col("is_compact_summary") & (F.col("source") == "user"), "harness").otherwise(step_author(F.col("source"), F.col("message")))


@view
def user_steps(r: Relations) -> DataFrame:
    return r["steps"].where("source = 'user'").select("session_id", "step_id", "ts", text_at("source_uuids", "$[0]").alias("uuid"), "is_sidechain", "is_compact_summary", _author().alias("author"), "message")


@view
def human_turns(r: Relations) -> DataFrame:
    return user_steps(r).where("author = 'human' AND NOT is_sidechain").select("session_id", "step_id", "ts", "uuid", "message")


@view
def session_outcomes(r: Relations) -> DataFrame:
    """Of the main chain. min_by and max_by take null values along, so what has none is left out by the key."""
    main = r["steps"].where("NOT is_sidechain").select("session_id", "step_id", "source", "message", _author().alias("author"))
    spoke = (F.col("source") == "agent") & (F.length("message") > 0)
    told = main.groupBy("session_id").agg(
        F.min_by("author", F.when((F.col("source") == "user") & F.col("author").isNotNull(), F.col("step_id"))).alias("first_author"),
        F.max_by("message", F.when(spoke, F.col("step_id"))).alias("last"),
        F.count_if(F.col("author") == "human").alias("human_turns"),
        F.count_if((F.col("author") == "harness") & is_interrupt(F.col("message"))).alias("interrupts"),
        F.count_if(F.col("author") == "stop_hook").alias("reviewer_blocks"),
    )
    kind = F.when(F.col("first_author") == "audit_prompt", "turn_audit").when(F.col("human_turns") <= 1, "one_shot_job").otherwise("interactive")
    outcome = F.when(F.col("last").rlike(VERDICT_OK), "pass").when(F.col("last").rlike(VERDICT_NOT_OK), "block").when(F.col("reviewer_blocks") > 0, "reviewer_blocked").when(F.col("interrupts") > 0, "interrupted").otherwise("clean_end")
    return told.select("session_id", kind.alias("kind"), outcome.alias("outcome"), "human_turns", "interrupts", "reviewer_blocks")


def register(r: Relations, names: list[str] | None = None) -> list[str]:
    """Temporary views of all that the relations at hand allow; the names registered."""
    out = []
    for name in names or VIEWS:
        try:
            VIEWS[name](r).createOrReplaceTempView(name)
            out.append(name)
        except KeyError:
            if names:
                raise
    return out
