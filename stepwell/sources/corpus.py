"""Readers of a corpus: one directory of artifacts for each session.

``<root>/sessions/<id>/`` holds ``trajectory.json``, ``edges.jsonl``, ``session_events.jsonl``, ``loss_report.json`` and,
written last, ``meta.json``. Any but the last may be stored with a ``.zst`` suffix, which Spark's JSON and text readers
open by themselves. Schemas are declared, never inferred: an unlisted key disappears and a missing one reads as null.
Parts whose shape varies stay JSON text. Only sessions with ``meta.json`` and a proper id contribute rows.

A session may hold the same rows typed, as five Parquet files; where ``meta.json`` names their version and all five are
there, its trajectory is not parsed.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.json_columns import text_at
from ..operators import steps as S

#: The columns of each artifact.
TRAJECTORY = "schema_version string, session_id string, agent struct<name: string, version: string, model_name: string, extra: string>, steps array<string>, final_metrics struct<total_prompt_tokens: bigint, total_completion_tokens: bigint, total_cached_tokens: bigint, total_cost_usd: double, total_steps: bigint, extra: string>, extra string"
EDGES = "uuid string, parent_uuid string, message_id string, type string, ts string, is_sidechain boolean, is_compact_summary boolean, source_file string, tool_use_ids string"
LOSS = "record_counts string, records_total bigint, records_converted bigint, records_captured bigint, records_dropped bigint, gaps_observed string, subagent_files_found bigint, subagent_files_convertible bigint, workflow_subagent_files_found bigint"
META = "session_id string, source_mtime_ns bigint, source_files string, harbor_version string, converter_version string, materialized_at string, agent string, columnar_schema bigint, converter_schema bigint, source_present boolean, source_removed_at string"
SESSION_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
MAX_SESSION_ID = 255
#: The typed files, their version, and the size of one that holds nothing.
TYPED = ("session", "steps", "tool_calls", "tool_results", "session_events")
TYPED_VERSION, EMPTY_PARQUET = 2, 16


def is_session_id(text: str) -> bool:
    return len(text) <= MAX_SESSION_ID and SESSION_ID.fullmatch(text) is not None


def session_id_ok(column: Column) -> Column:
    r"""The same rule on a column; ``\z``, as ``$`` would let a line end pass."""
    return column.rlike(rf"\A{SESSION_ID.pattern}\z") & (F.length(column) <= MAX_SESSION_ID)


def _path() -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"\.zst$", "")


def _session() -> Column:
    return F.regexp_extract(_path(), r"/sessions/([^/]+)/[^/]+$", 1)


def _literal(path: str) -> str:
    """A path whose special characters are no glob."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


class Corpus:
    """The relations of a corpus, as ``operators.views`` reads them."""

    NAMES = ("trajectories", "steps", "tool_calls", "tool_results", "edges", "events", "loss")

    def __init__(self, spark: SparkSession, root: str, name: str = "main") -> None:
        self.spark, self.root, self.name = spark, root.rstrip("/"), name

    def _read(self, artifact: str, kind: str, schema: str, without: frozenset[str] = frozenset(), **options: str) -> DataFrame:
        """Rows with ``_session`` and ``_path``; no row where no session has the artifact."""
        paths = self._paths(artifact, without)
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, _session string, _path string")
        rows = self.spark.read.format(kind).schema(schema).options(**options).load(paths)
        return rows.select("*", _session().alias("_session"), _path().alias("_path"))

    def _found(self, name: str) -> dict[str, tuple[str, int]]:
        """Path and size of an artifact by session."""
        jvm = self.spark.sparkContext._jvm
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.root}/sessions/*/{name}")
        listed = glob.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
        return {s.getPath().getParent().getName(): (s.getPath().toString(), s.getLen()) for s in listed}

    def _paths(self, artifact: str, without: frozenset[str] = frozenset()) -> list[str]:
        """A glob for each spelling that is there; where a session has both, the compressed one counts, and the plain
        ones of the others are named one by one. So are all if some sessions are left out."""
        plain, packed = self._found(artifact), self._found(f"{artifact}.zst")
        if without & (plain.keys() | packed.keys()):
            return [_literal(path) for s, (path, _) in sorted((plain | packed).items()) if s not in without]
        out = [f"{self.root}/sessions/*/{artifact}.zst"] if packed else []
        if plain.keys() & packed.keys():
            return out + [_literal(path) for s, (path, _) in sorted(plain.items()) if s not in packed]
        return out + ([f"{self.root}/sessions/*/{artifact}"] if plain else [])

    @cached_property
    def typed(self) -> frozenset[str]:
        """Sessions that are read from their typed files; what is there is listed once."""
        whole: set[str] | None = None
        for name in TYPED:
            here = {s for s, (_, size) in self._found(f"{name}.parquet").items() if size > EMPTY_PARQUET}
            whole = here if whole is None else whole & here
            if not whole:
                return frozenset()
        return frozenset(r.session_id for r in self.meta().where(F.col("columnar_schema") == TYPED_VERSION).select("session_id").toLocalIterator() if r.session_id in whole)

    def _typed(self, name: str, schema: str) -> DataFrame | None:
        """Typed rows with ``session_id`` after the folder; files of other sessions, which may be torn, are not opened."""
        if not self.typed:
            return None
        rows = self.spark.read.schema(schema).parquet(*(f"{_literal(self.root)}/sessions/{s}/{name}.parquet" for s in sorted(self.typed)))
        return rows.withColumn("session_id", _session()).withColumn("_path", F.regexp_replace(_path(), r"[^/]+$", "trajectory.json"))

    def _with_typed(self, rows: DataFrame, name: str, view: str) -> DataFrame:
        typed = self._typed(name, ", ".join(f"{c} {kind}" for c, kind in schemas.columns(view)))
        return rows if typed is None else rows.unionByName(typed.select(*rows.columns))

    def meta(self) -> DataFrame:
        rows = self._read("meta.json", "json", META, multiLine="true")
        return rows.where(session_id_ok(F.col("_session"))).withColumn("session_id", F.col("_session")).drop("_session", "_path")

    def _complete(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.meta().select(F.col("session_id").alias("_session")), "_session", "left_semi").withColumnRenamed("_session", "session_id")

    def _parsed(self) -> DataFrame:
        rows = self._read("trajectory.json", "json", TRAJECTORY.replace("session_id string, ", ""), self.typed, multiLine="true")
        return self._complete(rows).withColumnRenamed("_path", "trajectory_path").withColumn("corpus", F.lit(self.name))

    def trajectories(self) -> DataFrame:
        """One row a session; ``steps`` of a typed session is null, as its rows are in ``steps()``."""
        rows = self._parsed()
        typed = self._typed("session", TRAJECTORY.replace("steps array<string>, ", ""))
        if typed is None:
            return rows
        return rows.unionByName(typed.withColumnRenamed("_path", "trajectory_path").withColumn("corpus", F.lit(self.name)), allowMissingColumns=True)

    def steps(self) -> DataFrame:
        return self._with_typed(S.steps(self._parsed()), "steps", "steps")

    def tool_calls(self) -> DataFrame:
        return self._with_typed(S.tool_calls(self._parsed()), "tool_calls", "tool_calls")

    def tool_results(self) -> DataFrame:
        return self._with_typed(S.tool_results(self._parsed()), "tool_results", "tool_results")

    def edges(self) -> DataFrame:
        return self._complete(self._read("edges.jsonl", "json", EDGES)).drop("_path").withColumn("ts", S.naive(F.col("ts")))

    def events(self) -> DataFrame:
        """A whole line is one JSON text, typed by the same expressions wherever it comes from; blank lines are none."""
        lines = self._complete(self._read("session_events.jsonl", "text", "value string", self.typed)).where(F.trim("value") != "")
        text = lambda c: text_at("value", f"$.{c}")
        parsed = lines.select("session_id", text("seq").cast("long").alias("seq"), S.naive(text("ts")).alias("ts"), *(text(c).alias(c) for c in ("event_type", "subtype", "uuid", "parent_uuid", "tool_use_id")), text("is_sidechain").cast("boolean").alias("is_sidechain"), text("source_file").alias("source_file"), text("payload").alias("payload"), text("payload_bytes").cast("long").alias("payload_bytes"), text("payload_truncated").cast("boolean").alias("payload_truncated"))
        return self._with_typed(parsed, "session_events", "session_events")

    def loss(self) -> DataFrame:
        return self._complete(self._read("loss_report.json", "json", LOSS, multiLine="true")).withColumnRenamed("_path", "report_path")

    def relations(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n)() for n in self.NAMES}
