"""A lake of versioned Parquet tables.

``<root>/v=<n>/<table>`` holds what version n wrote of a table, by corpus and part: a month for tables with a time, else a
bucket of sessions. ``<root>/_CURRENT/<n>.json`` maps each part to the version that holds it. A reader takes the newest map once, so
what it reads does not change under it; a writer writes new folders and then one new map. A map is written by one
rename-free create of a new file, which no two writers can do for one number.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of sessions of a table without a time.
BUCKETS = 64
#: Tables and their time column, if they have one.
TABLES = {"trajectories": None, "steps": "ts", "tool_calls": "ts", "tool_results": "ts", "edges": "ts", "events": "ts", "loss": None}


@dataclass
class Snapshot:
    number: int = 0
    #: By table and corpus: part -> version folder that holds it.
    tables: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.schemas, sort_keys=True).encode()).hexdigest()


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- snapshots

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_CURRENT")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        numbers = self._numbers()
        if number is None:
            if not numbers:
                return Snapshot()
            number = numbers[-1]
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/_CURRENT/{number}.json").collect())
        return Snapshot(**json.loads(text))

    def _publish(self, s: Snapshot) -> Snapshot:
        path = self._path(f"{self.root}/_CURRENT/{s.number}.json")
        out = self._fs.create(path, False)  # fails if another writer has made it
        out.write(bytearray(json.dumps(s.__dict__).encode()))
        out.close()
        return s

    # -- reading

    def read(self, table: str, corpus: str | None = None, at: Snapshot | None = None) -> DataFrame:
        return self._read(table, corpus, at or self.snapshot()).drop("_part")

    def _read(self, table: str, corpus: str | None, s: Snapshot, parts: set[str] | None = None) -> DataFrame:
        """Rows with ``_part``; of some parts alone if they are named. Filters on corpus and part prune folders."""
        schema = s.schemas[table]
        folders: dict[str, dict[str, list[str]]] = {}
        for c, held in s.tables.get(table, {}).items():
            for part, folder in held.items():
                if corpus in (None, c) and (parts is None or part in parts):
                    folders.setdefault(folder, {}).setdefault(c, []).append(part)
        out = None
        for folder, held in sorted(folders.items()):
            mine = reduce(or_, ((F.col("corpus") == c) & F.col("_part").isin(*names) for c, names in held.items()))
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{table}").where(mine)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    # -- writing

    def _part(self, table: str) -> Column:
        """Rows without a time are in the month "none", which no pruning on months of others drops by accident."""
        time = TABLES.get(table)
        if time:
            return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none"))
        return F.lpad(F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("string"), 3, "0")

    def _write(self, rows: DataFrame, table: str, folder: str, corpus: str) -> dict[str, str]:
        """Write rows as parts of a folder; the parts that are there then, which the folder's listing tells."""
        out = rows.withColumn("corpus", F.lit(corpus)).withColumn("_part", self._part(table))
        out.sortWithinPartitions("_part", "session_id").write.mode("append").partitionBy("corpus", "_part").option("compression", "zstd").parquet(f"{self.root}/{folder}/{table}")
        path = self._path(f"{self.root}/{folder}/{table}/corpus={corpus}")
        found = self._fs.listStatus(path) if self._fs.exists(path) else []
        return {s.getPath().getName().removeprefix("_part="): folder for s in found}

    def _next(self, base: Snapshot) -> tuple[int, str]:
        n = (self._numbers() or [0])[-1] + 1
        return n, f"v={n}"

    def _ddl(self, rows: DataFrame, held: str | None) -> str:
        """The columns of ``rows``, and those that other rows of the table have besides."""
        fields = {f.name: f.dataType for f in rows.schema}
        fields |= {f.name: f.dataType for f in T.StructType.fromDDL(held) if f.name not in fields} if held else {}
        return ", ".join([f"`{c}` {kind.simpleString()}" for c, kind in fields.items() if c not in ("corpus", "_part")] + ["corpus string", "_part string"])

    def load(self, relations: dict[str, DataFrame], corpus: str) -> Snapshot:
        """Replace all of a corpus; the other corpora keep their folders."""
        base = self.snapshot()
        n, folder = self._next(base)
        tables, schemas = {t: dict(c) for t, c in base.tables.items()}, dict(base.schemas)
        for table, rows in relations.items():
            tables.setdefault(table, {})[corpus] = self._write(rows, table, folder, corpus)
            schemas[table] = self._ddl(rows, schemas.get(table))
        return self._publish(Snapshot(n, tables, schemas))

    def sync(self, relations: dict[str, DataFrame], corpus: str, session_ids: DataFrame) -> Snapshot:
        """Replace the sessions named in ``session_ids``: all their rows go and what the relations hold of them comes.
        Doing it again changes nothing.

        Only parts that hold such sessions, or get rows of them, are written anew; the others keep their folders. Which
        parts hold them is read from the session ids alone."""
        base = self.snapshot()
        n, folder = self._next(base)
        tables, schemas = {t: dict(c) for t, c in base.tables.items()}, dict(base.schemas)
        ids = session_ids.select("session_id").distinct()
        for table, rows in relations.items():
            new = rows.drop("corpus").join(ids, "session_id", "left_semi")
            held = base.tables.get(table, {}).get(corpus, {})
            kept = dict(held)
            if held:
                old = self._read(table, corpus, base)
                mine = new.select(self._part(table).alias("_part")).unionByName(old.select("session_id", "_part").join(ids, "session_id", "left_semi").select("_part"))
                touched = {r._part for r in mine.distinct().collect()}
                # Rows of other sessions stay, whichever columns the new ones have.
                stay = self._read(table, corpus, base, touched).join(ids, "session_id", "left_anti").drop("corpus", "_part")
                new = stay.unionByName(new, allowMissingColumns=True)
                kept = {part: f for part, f in held.items() if part not in touched}
            tables.setdefault(table, {})[corpus] = kept | self._write(new, table, folder, corpus)
            schemas[table] = self._ddl(new, schemas.get(table))
        return self._publish(Snapshot(n, tables, schemas))

    def rebuild(self, corpora: dict[str, dict[str, DataFrame]]) -> Snapshot:
        """A lake of these corpora alone, published at once."""
        n, folder = self._next(self.snapshot())
        tables: dict[str, dict[str, dict[str, str]]] = {}
        schemas: dict[str, str] = {}
        for corpus, relations in corpora.items():
            for table, rows in relations.items():
                tables.setdefault(table, {})[corpus] = self._write(rows, table, folder, corpus)
                schemas[table] = self._ddl(rows, schemas.get(table))
        return self._publish(Snapshot(n, tables, schemas))

    def compact(self, keep: int = 2, part_bytes: int = 1 << 28) -> Snapshot:
        """Write every part anew in files of about ``part_bytes``, then drop the maps and folders that the last ``keep``
        maps don't name."""
        base = self.snapshot()
        n, folder = self._next(base)
        tables: dict[str, dict[str, dict[str, str]]] = {}
        for table, held in base.tables.items():
            for corpus, parts in held.items():
                files = {part: -(-self._bytes(table, corpus, part, f) // part_bytes) or 1 for part, f in parts.items()}
                # Sessions of a part are dealt out by its own size, so that a large part is no single task's.
                dealt = F.create_map(*(F.lit(x) for pair in files.items() for x in pair))[F.col("_part")] if files else F.lit(1)
                rows = self._read(table, corpus, base).repartition(sum(files.values()) or 1, "_part", F.pmod(F.xxhash64("session_id"), dealt))
                tables.setdefault(table, {})[corpus] = self._write(rows.drop("corpus"), table, folder, corpus)
        done = self._publish(Snapshot(n, tables, base.schemas))
        numbers = self._numbers()[-keep:]
        used = {f for k in numbers for held in self.snapshot(k).tables.values() for parts in held.values() for f in parts.values()}
        for k in self._numbers():
            if k not in numbers:
                self._fs.delete(self._path(f"{self.root}/_CURRENT/{k}.json"), False)
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v=") and name not in used:
                self._fs.delete(status.getPath(), True)
        return done

    def _bytes(self, table: str, corpus: str, part: str, folder: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.root}/{folder}/{table}/corpus={corpus}/_part={part}")).getLength()

    # -- checking

    def verify(self, relations: dict[str, DataFrame], corpus: str) -> DataFrame:
        """Sessions whose rows differ between the relations and the lake: table, session, counts on either side."""
        out = None
        for table, rows in relations.items():
            columns = [c for c in rows.columns if c != "corpus"]
            lake = self.read(table, corpus).select(*columns)
            both = hashes(rows.select(*columns)).alias("a").join(hashes(lake).alias("b"), F.col("a.session_id").eqNullSafe(F.col("b.session_id")), "full")
            bad = both.where(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h")))).select(F.lit(table).alias("table"), F.coalesce("a.session_id", "b.session_id").alias("session_id"), F.col("a.n").alias("artifact_rows"), F.col("b.n").alias("lake_rows"))
            out = bad if out is None else out.unionByName(bad)
        return out

    def changed_since(self, table: str, number: int) -> DataFrame:
        """Rows of now that a snapshot had not, by session hash: the change feed of pipelines that keep a position."""
        now, then = self.read(table), self.read(table, at=self.snapshot(number))
        keys = ["corpus", "session_id"]
        old = hashes(then, keys).select(*keys, F.col("h").alias("old_h"), F.col("n").alias("old_n"))
        moved = hashes(now, keys).join(old, keys, "left").where("old_h IS NULL OR old_h <> h OR old_n <> n").select(*keys)
        return now.join(moved, keys, "left_semi")

    def status(self) -> DataFrame:
        s = self.snapshot()
        rows = [(t, c, part, f, self._bytes(t, c, part, f)) for t, held in s.tables.items() for c, parts in held.items() for part, f in parts.items()]
        return self.spark.createDataFrame(rows, "table string, corpus string, part string, folder string, bytes long")


def hashes(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows and an order-free hash by session. A sum, so that two equal rows do not cancel out."""
    keys = keys or ["session_id"]
    payload = [F.to_json(F.struct(F.col(f.name))) if f.dataType.typeName() in ("struct", "map", "variant") else F.col(f.name) for f in rows.schema if f.name not in keys]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*payload).cast("decimal(38,0)")).alias("h"))
