"""Who wrote a user step: rules on how its message begins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The author that a message's beginning tells, the first match counting.
AUTHOR_PREFIXES = (
    ("audit_prompt", "You are auditing an agent turn"),
    ("stop_hook", "Stop hook feedback"),
    ("stop_hook", "SubagentStop hook feedback"),
    ("task_notification", "<task-notification>"),
    ("task_notification", "[SYSTEM NOTIFICATION"),
    ("harness", "[Request interrupted"),
    ("harness", "Continue from where you left off"),
    ("harness", "Your previous attempt hit a transient"),
    ("harness", "This session is being continued from a previous conversation"),
    ("harness", "Base directory for this skill:"),
    ("harness", "[Image: original "),
    ("harness", '{"type": "image"'),
    ("harness", "[Workflow harness"),
    ("harness", "[structured-output-enforce]"),
    ("harness", "<system-reminder>"),
    ("harness", "<user-prompt-submit-hook>"),
    ("harness", "UserPromptSubmit operation blocked by hook"),
    ("harness", "<fork-boilerplate>"),
    ("harness", "Another Claude session sent a message"),
    ("harness", "The coordinator sent a message"),
    ("harness", "A session-scoped Stop hook is now active"),
    ("harness", "Goal check-in:"),
    ("harness", "<command-name>"),
    ("harness", "<command-message>"),
    ("harness", "<command-args>"),
    ("harness", "<local-command-stdout>"),
    ("harness", "<local-command-stderr>"),
    ("harness", "<local-command-caveat>"),
    ("harness", "Caveat: The messages below were generated"),
    ("harness", "<bash-input>"),
    ("harness", "<bash-stdout>"),
    ("harness", "<bash-stderr>"),
    ("harness", "<environment_context>"),
    ("harness", "<codex_internal_context"),
    ("harness", "<user_instructions>"),
    ("harness", "# AGENTS.md instructions"),
    ("harness", "<turn_aborted>"),
    ("harness", "The following is the Codex agent history"),
)
INTERRUPTS = ("[Request interrupted", "<turn_aborted>")
STRIPPED = " \t\r\n"


def _begins(*prefixes: str) -> str:
    return rf"^[{STRIPPED}]*(?:" + "|".join(rf"\Q{p}\E" for p in prefixes) + ")"


def step_author(source: Column, message: Column) -> Column:
    """Null for a step that is not the user's, ``harness`` for an empty message, else the rules' author or ``human``.

    No rule's beginning is that of another, so each author's rules are one pattern and their order does not matter."""
    told = F.when(message.isNull() | message.rlike(rf"^[{STRIPPED}]*$"), "harness")
    for author in dict.fromkeys(a for a, _ in AUTHOR_PREFIXES):
        told = told.when(message.rlike(_begins(*(p for a, p in AUTHOR_PREFIXES if a == author))), author)
    return F.when(source.eqNullSafe(F.lit("user")), told.otherwise("human"))


def is_interrupt(message: Column) -> Column:
    return message.rlike(_begins(*INTERRUPTS))


#: How an audit's last message begins.
VERDICT_OK = r'^\s*(?:```(?:json)?\s*)?\{\s*"ok"\s*:\s*true'
VERDICT_NOT_OK = r'^\s*(?:```(?:json)?\s*)?\{\s*"ok"\s*:\s*false'
