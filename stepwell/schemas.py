"""The static catalog: views with their columns, and functions with their signatures. No Spark is needed to read it."""

from __future__ import annotations

_STEP = "session_id string, step_id long, ts timestamp_ntz, source string, model_name string, message string, is_sidechain boolean, is_compact_summary boolean, prompt_tokens long, completion_tokens long, cached_tokens long, cache_creation long, llm_call_count long, source_uuids json, agent_id string, images json"
#: The columns of each view, in order.
VIEWS: dict[str, str] = {
    "sessions": "session_id string, agent string, agent_version string, cwd string, git_branch string, started_at timestamp_ntz, ended_at timestamp_ntz, agent_steps long, step_count long, model_name string, total_cost_usd double, reported_cost_usd double, trajectory_path string, corpus string",
    "steps": _STEP,
    "subagent_steps": _STEP,
    "messages": "uuid string, parent_uuid string, session_id string, ts timestamp_ntz, type string, is_sidechain boolean, is_compact_summary boolean, message_id string, source_file string",
    "tool_calls": "session_id string, step_id long, ts timestamp_ntz, tool_name string, tool_use_id string, tool_input json",
    "tool_results": "session_id string, step_id long, ts timestamp_ntz, tool_use_id string, content json, is_error boolean, exit_code long, interrupted boolean, images json",
    "todo_events": "session_id string, written_at timestamp_ntz, step_id long, subject string, status string, active_form string, snapshot_ix long",
    "todo_state_current": "session_id string, subject string, status string, active_form string, written_at timestamp_ntz",
    "subagent_spawns": "session_id string, spawned_at timestamp_ntz, step_id long, tool_use_id string, spawn_tool string, subagent_type string, description string, prompt string, run_in_background string",
    "task_creations": "session_id string, created_at timestamp_ntz, step_id long, tool_use_id string, create_tool string, subject string, description string, active_form string, metadata json",
    "task_updates": "session_id string, updated_at timestamp_ntz, step_id long, tool_use_id string, update_tool string, task_id string, status string, add_blocked_by json, owner string",
    "tasks_state_current": "session_id string, task_id string, subject string, active_form string, status string, created_at timestamp_ntz, last_updated_at timestamp_ntz",
    "skill_invocations": "session_id string, ts timestamp_ntz, step_id long, source string, skill_id string, args string, tool_use_id string",
    "skill_usage": "session_id string, ts timestamp_ntz, step_id long, source string, skill_id string, args string, tool_use_id string, skill_name string, plugin string, is_builtin boolean",
    "subagents": "session_id string, agent_id string, agent_type string, description string, parent_tool_call_id string, parent_step_id long, link_source string, spawn_depth long, parent_agent_id string, first_ts timestamp_ntz, last_ts timestamp_ntz, step_count long",
    "images": "session_id string, step_id long, ts timestamp_ntz, origin string, tool_use_id string, sha256 string, media_type string, size_bytes long, width long, height long, blob_path string",
    "loss_reports": "session_id string, records_total long, records_converted long, records_captured long, records_dropped long, gaps_observed json, record_counts json, subagent_files_found long, subagent_files_convertible long, workflow_subagent_files_found long, report_path string",
    "session_events": "session_id string, seq long, ts timestamp_ntz, event_type string, subtype string, uuid string, parent_uuid string, tool_use_id string, is_sidechain boolean, source_file string, payload json, payload_bytes long, payload_truncated boolean",
    "user_steps": "session_id string, step_id long, ts timestamp_ntz, uuid string, is_sidechain boolean, is_compact_summary boolean, author string, message string",
    "human_turns": "session_id string, step_id long, ts timestamp_ntz, uuid string, message string",
    "session_outcomes": "session_id string, kind string, outcome string, human_turns long, interrupts long, reviewer_blocks long",
}
FUNCTIONS: dict[str, str] = {
    "ago": "interval", "model_used": "session_id", "cost_estimate": "session_id", "tool_rank": "last_n_days", "todo_velocity": "session_id", "subagent_fanout": "session_id", "semantic_search": "probe, k", "skill_rank": "last_n_days", "skill_source_mix": "last_n_days", "step_author": "source, message",
    "work_mix": "since_days", "friction_counts": "since_days", "friction_rate": "since_days", "friction_examples": "label, n", "conflicts_over_time": "since_days", "perceived_counts": "since_days", "perceived_rate": "since_days", "perceived_examples": "signal, n",
}


def columns(view: str) -> list[tuple[str, str]]:
    """Name and Spark type; JSON is text."""
    return [(n, {"json": "string", "long": "bigint"}.get(t, t)) for n, t in (c.split(" ") for c in VIEWS[view].split(", "))]


def examples() -> dict[str, str]:
    """A first query for each view."""
    return {v: f"SELECT {', '.join(n for n, _ in columns(v)[:4])} FROM {v} LIMIT 20" for v in VIEWS}
