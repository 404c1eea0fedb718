"""Deterministic tiers of friction labelling: patterns, then rules over a session's turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS = 300
PROBE_CHARS = 512
SHORT_CHARS = 30
REPEAT_TURNS = 10
#: Words that take something back, and the patterns of the first tier, the first match counting.
IMPERATIVES = ("stop", "redo", "revert", "rollback", "undo", "restart")
PATTERNS = {
    "status_ping": r"\bhow(?:'s|\s+is|\s+are|\s+it)?\s+(?:it|we|things|progress)\s+(?:going|coming|doing|looking|progressing|holding\s+up)\b"
    r"|\bhow'?s?\s+progress\b(?=\s*[?.!]?\s*$)|\bany\s+update(?:s)?\b(?=\s*[?.!]?\s*$)|\bstatus\s+update\b|\bwhere\s+(?:are\s+we|we['’]re)\s+(?:at|with)\b"
    r"|\b(?:are\s+you\s+)?still\s+(?:working|going|running|on\s+it)\b|\bwhat'?s?\s+(?:the|your)\s+eta\b|\bhow\s+(?:much\s+)?long\s+(?:until|till|more|left)\b",
    "interruption": r"^\s*(?:wait(?:\s*[.,!]|\s+a\s+(?:sec|second|moment|minute)|[\s$])|stop(?:\s*[.,!]|\s+(?:right\s+)?there|[\s$])|hold\s+on|hold\s+up|hang\s+on|actually[,\s]|before\s+you\s+(?:do|go)|pause\b|nvm\b|never\s*mind\b)",
    "correction": r"^\s*(?:no[,\s.!]|nope[,\s.!]?|nah[,\s.!]?|that'?s\s+(?:wrong|not\s+(?:right|it|what)|incorrect)|not\s+(?:that|what\s+i)|try\s+again|wrong\b|that'?s\s+not\s+)",
}


def candidates(human_turns: DataFrame) -> DataFrame:
    """Human turns with a uuid and 1 to 300 characters."""
    return human_turns.where(F.col("uuid").isNotNull() & F.length("message").between(1, MAX_CHARS))


def pattern_label(text: Column) -> Column:
    probe, out = F.substring(text, 1, PROBE_CHARS), None
    for label, pattern in PATTERNS.items():
        hit = probe.rlike(f"(?iU){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def by_pattern(turns: DataFrame) -> DataFrame:
    return turns.select("session_id", "uuid", "ts", pattern_label(F.col("message")).alias("label")).where("label IS NOT NULL").select("*", F.lit(0.9).alias("confidence"), F.lit("regex").alias("source"))


def by_rules(steps: DataFrame, turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """A repeated body within ten human turns, a short imperative, a question right after an error: of several the most
    confident, of equals the first named.

    ``steps`` is the main chain with ``has_error``; ``turns`` are the human ones of it."""
    order = Window.partitionBy("session_id").orderBy("step_id")
    asked = wanted.select("session_id", "uuid")
    body = F.lower(F.regexp_replace("message", r"\s+", " "))
    place = turns.where(F.length("message") > 0).withColumn("place", F.row_number().over(order)).withColumn("body", body)
    same = Window.partitionBy("session_id", "body").orderBy("place")
    repeated = place.withColumn("last", F.lag("place").over(same)).where(F.col("place") - F.col("last") <= REPEAT_TURNS)
    first = F.lower(F.rtrim(F.split_part(F.btrim("message", F.lit(" \t\r\n")), F.lit(" "), F.lit(1)), F.lit(".,!?")))
    short = turns.where((F.length("message") <= SHORT_CHARS) & first.isin(*IMPERATIVES))
    after = steps.withColumn("before", F.lag("has_error").over(order)).where(F.col("before") & (F.col("source") == "user") & F.rtrim("message").endswith("?"))
    rules = ((repeated, "unmet_expectation", 0.85), (short, "correction", 0.9), (after, "confusion", 0.85))
    out = None
    for k, (rows, label, confidence) in enumerate(rules):
        part = rows.select("session_id", "uuid", F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(-k).alias("rule"))
        out = part if out is None else out.unionByName(part)
    best = out.join(asked, ["session_id", "uuid"], "left_semi").groupBy("session_id", "uuid").agg(F.max_by("label", F.struct("confidence", "rule")).alias("label"), F.max("confidence").alias("confidence"))
    return best.withColumn("source", F.lit("sql"))
