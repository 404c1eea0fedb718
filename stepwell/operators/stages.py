"""Labelling stages around a model call that the caller gives.

A stage admits units (anti-join with what is labelled), asks the model in batches inside the tasks, checks the answers
against closed lists and against the ids that exist, and returns rows to append and what came of each unit. ``call``
takes a list of texts and gives, for each, an answer as JSON text, ``REFUSED``, or None where the call failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import friction as tiers
from .transcript import cited

Call = Callable[[list[str]], list[str | None]]
REFUSED = "<refused>"
BATCH = 8
#: The closed lists of labels.
CATEGORIES = ("sde", "admin", "strategy_business", "events", "thought_leadership", "other")
FRICTION_LABELS = ("status_ping", "unmet_expectation", "confusion", "interruption", "correction", "frustration", "none")
SIGNALS = ("correction", "repeated_request", "rejected_action", "contradictory_response", "acknowledged_mistake", "persistent_misunderstanding", "unresolved_outcome")
SEVERITIES = ("minor", "moderate", "major")
CONFLICT_KINDS = ("disagreement", "correction", "reversal", "impasse")
CONFLICT_SEVERITIES = ("low", "medium", "high")


def ask(units: DataFrame, call: Call, batch: int = BATCH) -> DataFrame:
    """``unit``, ``status`` (answered, refused or failed) and ``answer`` of units with ``text``. A call that raises fails
    its batch alone; nothing is asked twice but by a task that runs again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    answers = call(part["text"].tolist())
                except Exception:  # noqa: BLE001 - a provider's failure is a failed unit, to be tried again later
                    answers = [None] * len(part)
                for unit, answer in zip(part["unit"], answers, strict=True):
                    out.append((unit, "failed" if answer is None else "refused" if answer == REFUSED else "answered", None if answer == REFUSED else answer))
            yield pd.DataFrame(out, columns=["unit", "status", "answer"])

    return units.select("unit", "text").mapInPandas(run, "unit string, status string, answer string")


def admitted(sessions: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Sessions with a text that are not done, the newest first if only ``most`` are wanted."""
    out = sessions.where("text <> ''").join(done.select("session_id").distinct(), "session_id", "left_anti")
    return out if most is None else out.orderBy(F.desc_nulls_last("newest"), "session_id").limit(most)


def _asked(sessions: DataFrame, call: Call, schema: str) -> DataFrame:
    told = ask(sessions.select(F.col("session_id").alias("unit"), "text"), call)
    return told.select(F.col("unit").alias("session_id"), "status", F.from_json("answer", schema).alias("a"))


def _sure(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0, 1), F.lit(False))


def classify(sessions: DataFrame, done: DataFrame, call: Call, most: int | None = None) -> DataFrame:
    """``session_id``, ``work_category``, ``goal`` and ``confidence`` of interactive sessions; a refusal is a row of
    category unknown that is never asked again; a failure or an answer off the list gives no row."""
    told = _asked(admitted(sessions.where("kind = 'interactive'"), done, most), call, "work_category string, goal string, confidence double")
    ok = (F.col("status") == "answered") & F.col("a.work_category").isin(*CATEGORIES) & _sure(F.col("a.confidence"))
    refused = F.col("status") == "refused"
    return told.where(ok | refused).select("session_id", F.when(refused, "unknown").otherwise(F.col("a.work_category")).alias("work_category"), F.col("a.goal").alias("goal"), F.when(refused, 0.0).otherwise(F.col("a.confidence")).cast("float").alias("confidence"))


def conflicts(sessions: DataFrame, done: DataFrame, edges: DataFrame, call: Call) -> DataFrame:
    """Pairs of turns at odds; both must be turns of the session."""
    told = _asked(admitted(sessions.where("kind = 'interactive'"), done), call, "pairs array<struct<turn_a_uuid: string, turn_b_uuid: string, conflict_kind: string, severity: string, confidence: double>>")
    pairs = told.select("session_id", F.explode("a.pairs").alias("p")).select("session_id", "p.*").where(F.col("conflict_kind").isin(*CONFLICT_KINDS) & F.col("severity").isin(*CONFLICT_SEVERITIES) & _sure(F.col("confidence")))
    for c in ("turn_a_uuid", "turn_b_uuid"):
        pairs = pairs.join(edges.select("session_id", F.col("uuid").alias(c)).distinct(), ["session_id", c], "left_semi")
    return pairs.select("session_id", "turn_a_uuid", "turn_b_uuid", "conflict_kind", "severity", "confidence")


def perceived(sessions: DataFrame, done: DataFrame, pairs: DataFrame, human_turns: DataFrame, call: Call, least_pairs: int = 2) -> DataFrame:
    """Errors that a human turn tells of, in sessions of enough answered turns; the turn must be a human one of it."""
    enough = pairs.where(F.col("pairs") >= least_pairs).select("session_id")
    told = _asked(admitted(sessions, done).join(enough, "session_id", "left_semi"), call, "errors array<struct<turn_uuid: string, signal: string, severity: string, confidence: double>>")
    errors = told.select("session_id", F.explode("a.errors").alias("e")).select("session_id", "e.*").where(F.col("signal").isin(*SIGNALS) & F.col("severity").isin(*SEVERITIES) & _sure(F.col("confidence")))
    return errors.join(human_turns.select("session_id", F.col("uuid").alias("turn_uuid")).distinct(), ["session_id", "turn_uuid"], "left_semi").select("session_id", "turn_uuid", "signal", "severity", "confidence")


def label_friction(steps: DataFrame, turns: DataFrame, done: DataFrame, call: Call) -> DataFrame:
    """A label for each candidate turn that has none: by pattern, else by rule, else by the model; the source tells which.
    A refused turn is a row of label none."""
    wanted = tiers.candidates(turns).join(done.select("uuid").distinct(), "uuid", "left_anti")
    columns = ["session_id", "uuid", "label", "confidence", "source"]
    by_pattern = tiers.by_pattern(wanted).select(*columns)
    left = wanted.join(by_pattern.select("uuid"), "uuid", "left_anti")
    by_rule = tiers.by_rules(steps, turns, left).select(*columns)
    rest = left.join(by_rule.select("uuid"), "uuid", "left_anti")
    told = ask(rest.select(F.col("uuid").alias("unit"), F.col("message").alias("text")), call).select(F.col("unit").alias("uuid"), "status", F.from_json("answer", "label string, confidence double").alias("a"))
    refused = F.col("status") == "refused"
    ok = F.col("a.label").isin(*FRICTION_LABELS) & _sure(F.col("a.confidence"))
    by_model = told.where(refused | ok).join(rest.select("session_id", "uuid"), "uuid").select("session_id", "uuid", F.when(refused, "none").otherwise(F.col("a.label")).alias("label"), F.when(refused, 0.0).otherwise(F.col("a.confidence")).alias("confidence"), F.when(refused, "refused").otherwise("llm").alias("source"))
    return by_pattern.unionByName(by_rule).unionByName(by_model)


def narrate(windows: DataFrame, done: DataFrame, call: Call, most_chars: int = 2000) -> DataFrame:
    """Intent, actions and outcome of windows (session_id, stream, index, text) not told yet; long fields are cut, and a
    failed call gives no row, so that it is asked again."""
    key = F.to_json(F.struct("session_id", "stream", "index"), {"ignoreNullFields": "false"})
    keyed, known = windows.withColumn("unit", key), done.withColumn("unit", key).select("unit").distinct()
    wanted = keyed.join(known, "unit", "left_anti")
    told = ask(wanted, call).where("status = 'answered'").select("unit", F.from_json("answer", "intent string, actions string, outcome string").alias("a"))
    return wanted.join(told, "unit").select("session_id", "stream", "index", *(F.substring(f"a.{c}", 1, most_chars).alias(c) for c in ("intent", "actions", "outcome")))


def review(windows: DataFrame, steps: DataFrame, call: Call, skip: DataFrame, most_findings: int = 10, most_quotes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Findings whose every quote is said by the step that it names, and how many were dropped for what reason. ``skip``:
    sessions of kinds that are not reviewed. Of an answer the first findings and quotes count."""
    wanted = windows.join(skip.select("session_id"), "session_id", "left_anti")
    schema = "findings array<struct<heading: string, quotes: array<struct<uuid: string, quote: string>>>>"
    told = ask(wanted.select(F.to_json(F.struct("session_id", "index")).alias("unit"), "text"), call)
    found = told.select(F.get_json_object("unit", "$.session_id").alias("session_id"), "unit", F.posexplode(F.slice(F.from_json("answer", schema)["findings"], 1, most_findings)).alias("n", "f"))
    named = found.select("session_id", F.concat_ws("#", "unit", "n").alias("finding"), "f.heading", F.slice("f.quotes", 1, most_quotes).alias("quotes"))
    quotes = named.select("session_id", "finding", F.explode_outer("quotes").alias("q")).select("session_id", "finding", "q.uuid", "q.quote")
    verdict = cited(quotes, steps)
    kept = named.join(verdict.where("dropped IS NULL"), "finding").select("session_id", "finding", "heading")
    return kept, verdict.where("dropped IS NOT NULL").groupBy("dropped").agg(F.count("*").alias("n"))
