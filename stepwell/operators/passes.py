"""Dataflow passes between the raw records, the views and the label tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .views import latest

# -- raw records to artifacts


def first_by_uuid(records: DataFrame) -> DataFrame:
    """Of records with one uuid in a session the first in file order stays; those without a uuid all do. Ordered by the
    timestamp's text, missing first, then by file and line."""
    named = latest(records.where("uuid IS NOT NULL"), ["session_id", "uuid"], F.asc("file_rank"), F.asc("line"))
    kept = named.unionByName(records.where("uuid IS NULL"))
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id").orderBy(F.coalesce("timestamp", F.lit("")), "file_rank", "line")))


def bundle(parts: DataFrame) -> DataFrame:
    """Agent records of one message become one: texts joined by a blank line in order, the last usage, the first
    record's time; each tool call once, where it is first."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda x: x[c])
    return parts.groupBy("session_id", "message_id").agg(F.min("ordinal").alias("ordinal"), F.min_by("timestamp", "ordinal").alias("timestamp"), F.array_join(F.filter(order("text"), lambda t: F.length(t) > 0), "\n\n").alias("text"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("ordinal"))).alias("usage"), F.array_distinct(F.filter(order("tool_use_id"), lambda t: t.isNotNull())).alias("tool_use_ids"))


def attach_results(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with their first result, and the results that name no call (kept only if they name a tool)."""
    first = latest(results, ["session_id", "tool_use_id"], F.asc("ordinal"))
    matched = calls.join(first.select("session_id", "tool_use_id", F.col("content").alias("result")), ["session_id", "tool_use_id"], "left")
    return matched, first.join(calls, ["session_id", "tool_use_id"], "left_anti").where("tool_name IS NOT NULL")


def edges_of(records: DataFrame) -> DataFrame:
    """A row for every raw record, ordered within its session by time and uuid, missing ones first."""
    at = lambda p: F.get_json_object("value", f"$.{p}")
    flag = lambda p: F.coalesce(at(p).cast("boolean"), F.lit(False))
    rows = records.select("session_id", at("uuid").alias("uuid"), at("parentUuid").alias("parent_uuid"), at("message.id").alias("message_id"), at("type").alias("type"), at("timestamp").alias("ts"), flag("isSidechain").alias("is_sidechain"), flag("isCompactSummary").alias("is_compact_summary"), "source_file")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id").orderBy(F.coalesce("ts", F.lit("")), F.coalesce("uuid", F.lit("")))))


def session_metrics(steps: DataFrame) -> DataFrame:
    """Sums that are null where no step states the number."""
    return steps.groupBy("session_id").agg(*(F.sum(c).alias(f"total_{c}") for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "cache_creation")), F.count("*").alias("total_steps"))


def step_cost(prompt: Column, read: Column, creation: Column, completion: Column, rates: dict[str, Column], thresholds: dict[int, dict[str, Column]] | None = None) -> Column:
    """Text at the input rate, cache reads and creations at theirs (the input rate where there is none) and output.
    Above a threshold of prompt tokens its rates hold, the highest one exceeded counting; a rate it leaves out stays."""
    zero, held = F.lit(0), dict(rates)
    for limit in sorted(thresholds or {}):
        held = {k: F.when(prompt > limit, F.coalesce(thresholds[limit].get(k, v), v)).otherwise(v) for k, v in held.items()}
    read, creation = F.coalesce(read, zero), F.coalesce(creation, zero)
    text = F.greatest(F.coalesce(prompt, zero) - read - creation, zero)
    rate = lambda k: F.coalesce(held[k], held["input"]) if k in held else held["input"]
    return text * held["input"] + read * rate("cache_read") + creation * rate("cache_creation") + F.coalesce(completion, zero) * held["output"]


def session_cost(priced: DataFrame) -> DataFrame:
    """Null if any step with usage has no cost."""
    return priced.groupBy("session_id").agg(F.when(F.count_if(F.col("has_usage") & F.col("cost").isNull()) == 0, F.sum("cost")).alias("total_cost_usd"))


def reported_cost(events: DataFrame) -> DataFrame:
    """The last total of the main chain's cost states, in record order."""
    total = F.get_json_object("payload", "$.total").cast("double")
    states = events.where("event_type = 'cost-state' AND NOT coalesce(is_sidechain, false)").withColumn("total", total).where("total IS NOT NULL")
    return states.groupBy("session_id").agg(F.max_by("total", "seq").alias("reported_cost_usd"))


def census(records: DataFrame) -> DataFrame:
    """Records by type as a JSON object with sorted keys, and their number."""
    counts = records.groupBy("session_id", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("session_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))).alias("record_counts"), F.sum("n").alias("records_total"))


def dangling_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Results that name no call of their own step: what validation refuses."""
    return results.where("tool_use_id IS NOT NULL").join(calls.select("session_id", "step_id", "tool_use_id"), ["session_id", "step_id", "tool_use_id"], "left_anti").select("session_id", "step_id", "tool_use_id")


def zip_until_mismatch(left: DataFrame, right: DataFrame, keys: list[str], place: str, same: Column) -> DataFrame:
    """Pairs at equal places before the first that does not agree; ``same`` compares ``l.*`` with ``r.*``."""
    pairs = left.alias("l").join(right.alias("r"), [*keys, place]).withColumn("_same", same)
    first = F.min(F.when(~F.col("_same"), F.col(place))).over(Window.partitionBy(*keys))
    return pairs.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(place) < F.col("_first"))).drop("_same", "_first")


# -- what to do in a pass

QUIESCE_NS = 300 * 10**9


def plan(sessions: DataFrame, watermark: DataFrame, now_ns: int, quiesce_ns: int = QUIESCE_NS, force: bool = False) -> DataFrame:
    """``session_id`` and ``bucket``. ``sessions`` has a row for each source file: session_id, path, mtime_ns; the
    watermark path, seen_ns. A session still written to is live, even under force; then it is stale if a file is new or
    moved."""
    files = sessions.join(watermark, "path", "left")
    told = files.groupBy("session_id").agg(F.max("mtime_ns").alias("newest"), F.max(~F.col("mtime_ns").eqNullSafe(F.col("seen_ns"))).alias("stale"))
    return told.select("session_id", F.when(F.lit(now_ns) - F.col("newest") < quiesce_ns, "skipped_live").when(F.lit(force) | F.col("stale"), "to_materialize").otherwise("up_to_date").alias("bucket"))


def advance(watermark: DataFrame, files: DataFrame, done: DataFrame) -> DataFrame:
    """The next watermark: files of sessions that succeeded get their time; all others keep what is known of them,
    vanished ones too, unless their session succeeded without them."""
    now = files.join(done, "session_id", "left_semi").select("path", F.col("mtime_ns").alias("new_ns"))
    both = watermark.join(now, "path", "full").join(done.withColumn("done", F.lit(True)), "session_id", "left")
    return both.where("new_ns IS NOT NULL OR done IS NULL").select("path", F.coalesce("new_ns", "seen_ns").alias("seen_ns"))


def stale_generation(meta: DataFrame, schema: int) -> DataFrame:
    return meta.where(~F.col("converter_schema").eqNullSafe(F.lit(schema))).select("session_id")


def fresh_in_lake(meta: DataFrame, lake: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions that may be read from the lake (both stamps agree), and those that must come from files."""
    keys = ["session_id", "materialized_at", "source_mtime_ns"]
    held = lake.select(*keys)
    return meta.join(held, keys, "left_semi").select("session_id"), meta.join(held, keys, "left_anti").select("session_id")


def pending_texts(rows: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts to embed: the first of a uuid whose hash is not stored; a limit counts what is left after that."""
    first = latest(rows, ["uuid"], F.asc("ordinal")).withColumn("text_hash", F.sha2("text", 256))
    known = stored.select("uuid", F.col("text_hash").alias("stored_hash"))
    out = first.join(known, "uuid", "left").where("stored_hash IS NULL OR stored_hash <> text_hash").select("uuid", "text", "text_hash", F.col("stored_hash").isNotNull().alias("replaces_existing"))
    return out if limit is None else out.orderBy("uuid").limit(limit)


def orphans(stored: DataFrame, steps: DataFrame) -> DataFrame:
    """Vectors whose uuid no step names; refuses to call all of them orphans when there is no step at all."""
    if steps.limit(1).count() == 0:
        raise ValueError("no step is known, so no vector can be told to be an orphan")
    return stored.join(steps.select("uuid"), "uuid", "left_anti").select("uuid")


def admitted(sessions: DataFrame, cached: DataFrame, blocked: DataFrame, most: int | None = None) -> DataFrame:
    """Sessions not labelled yet and not blocked, the newest first."""
    out = sessions.join(cached, "session_id", "left_anti").join(blocked, "session_id", "left_anti")
    return out if most is None else out.orderBy(F.desc("newest"), "session_id").limit(most)


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempts), F.lit(60.0))


# -- reading sessions


def human_ai_pairs(turns: DataFrame) -> DataFrame:
    """Human turns that got an answer: between the main chain's spoken turns, each change from human to another kind
    that is no user's. ``turns`` has session_id, step_id, kind (human, other or null for what counts as neither)."""
    said = turns.where("kind IS NOT NULL").withColumn("before", F.lag("kind").over(Window.partitionBy("session_id").orderBy("step_id")))
    return said.groupBy("session_id").agg(F.count_if((F.col("kind") == "other") & (F.col("before") == "human")).alias("pairs"))


def stream_of(agent_id: Column, is_sidechain: Column) -> Column:
    """The stream that a step is narrated in; null is the main chain."""
    return F.when(is_sidechain, F.coalesce(agent_id, F.lit("unattributed")))


def finding_key(session_id: Column, heading: Column, anchor: Column) -> Column:
    nul = F.lit("\0")
    return F.substring(F.sha2(F.concat(session_id, nul, heading, nul, anchor, nul), 256), 1, 16)


def tokens_for_chars(chars: Column, ratio: float) -> Column:
    return F.when(chars <= 0, 0).otherwise(F.greatest(F.lit(1), (chars / ratio).cast("long"))).cast("long")


def fold_case(values: DataFrame, column: str, members: list[str]) -> DataFrame:
    """A value that equals exactly one member but for case becomes it; any other stays."""
    one = {}
    for m in members:
        one.setdefault(m.lower(), []).append(m)
    folded = F.coalesce(*(F.when(F.lower(column) == k, ms[0]) for k, ms in sorted(one.items()) if len(ms) == 1), F.col(column))
    return values.withColumn(column, F.when(F.col(column).isin(*members), F.col(column)).otherwise(folded))


def task_notices(events: DataFrame) -> DataFrame:
    """One row for each task named in a notification, where it is first."""
    blocks = events.select("session_id", "seq", F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<task-notification>(.*?)</task-notification>"), F.lit(1))).alias("block"))
    return latest(blocks.select("session_id", "seq", F.regexp_extract("block", "<task-id>([^<]*)</task-id>", 1).alias("task_id")).where("task_id <> ''"), ["session_id", "task_id"], F.asc("seq"))


def place_notices(notices: DataFrame, steps: DataFrame) -> DataFrame:
    """The first step that is not earlier than a notice: steps and notices are one ordered stream of a session, and each
    notice takes the next step's id, so nothing is joined by range."""
    stream = steps.select("session_id", "ts", F.lit(1).alias("kind"), "step_id", F.lit(None).cast("string").alias("notice")).unionByName(notices.select("session_id", "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("step_id"), "notice"))
    ahead = Window.partitionBy("session_id").orderBy("ts", "kind", "step_id").rowsBetween(0, Window.unboundedFollowing)
    return stream.withColumn("step_id", F.first("step_id", True).over(ahead)).where("kind = 0").select("session_id", "notice", "step_id")


def plan_windows(steps: DataFrame, max_chars: int, min_chars: int) -> DataFrame:
    """Windows of a stream: ``steps`` has session_id, stream, position, chars, mark. A mark closes a window that has
    the least size; else the size cap does before it is exceeded. A size is added up anew in each window, which no
    window function can do, so a stream is read in order by one task, a batch at a time."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, last, chars, index, out = None, 0, 0, 0, 0, []
        columns = ["session_id", "stream", "index", "start", "stop", "boundary", "chars"]

        def close(stop: int, boundary: str) -> None:
            out.append((*key, index, opened, stop, boundary, chars))

        for batch in batches:
            for session, stream, position, size, mark in batch.itertuples(index=False, name=None):
                mark, stream = (None if pd.isna(x) else x for x in (mark, stream))
                if (session, stream) != key:
                    if key is not None:
                        close(last + 1, "session_end")
                    key, opened, chars, index = (session, stream), position, 0, 0
                elif mark is not None and chars >= min_chars or chars > 0 and chars + size > max_chars:
                    close(position, mark if mark is not None and chars >= min_chars else "size_cap")
                    opened, chars, index = position, 0, index + 1
                chars, last = chars + size, position
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        if key is not None:
            close(last + 1, "session_end")
        yield pd.DataFrame(out, columns=columns)

    rows = steps.select("session_id", "stream", "position", "chars", "mark").repartition("session_id", "stream").sortWithinPartitions("session_id", "stream", "position")
    return rows.mapInPandas(cut, "session_id string, stream string, index long, start long, stop long, boundary string, chars long")


def pack(groups: DataFrame, max_chars: int) -> DataFrame:
    """Consecutive groups (session_id, position, chars) into calls of at most ``max_chars``; a larger group is its own."""
    marked = groups.select("session_id", F.lit(None).cast("string").alias("stream"), "position", "chars", F.lit(None).cast("string").alias("mark"))
    return plan_windows(marked, max_chars, max_chars + 1).select("session_id", F.col("index").alias("call"), "start", "stop", "chars")


def last_per_lane(lines: DataFrame) -> DataFrame:
    """The last completion and the last skip of each lane of a log; of lines at one time the later counts."""
    done, skipped = (F.regexp_extract("value", rf"lane=(\S+) .*\b{w}\b", 1) for w in ("completed", "skipped"))
    order = F.struct("ts", "line")
    rows = lines.select("ts", "line", F.nullif(done, F.lit("")).alias("done"), F.nullif(skipped, F.lit("")).alias("skipped")).withColumn("lane", F.coalesce("done", "skipped")).where("lane IS NOT NULL")
    return rows.groupBy("lane").agg(F.max_by("ts", F.when(F.col("done").isNotNull(), order)).alias("last_done"), F.max_by("ts", F.when(F.col("skipped").isNotNull(), order)).alias("last_skipped"))


def select_windows(leads: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """Windows that triage names, each once, the first ``most`` of a session in the order named, and the last of the
    main chain, in stream order."""
    first = leads.groupBy("session_id", "stream", "index").agg(F.min("rank").alias("rank"))
    named = first.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("rank", "stream", "index"))).where(F.col("n") <= most)
    last = windows.where("stream IS NULL").groupBy("session_id").agg(F.max("index").alias("index")).withColumn("stream", F.lit(None).cast("string"))
    keys = ["session_id", "stream", "index"]
    return named.select(*keys).unionByName(last.select(*keys)).distinct()
