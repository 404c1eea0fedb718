"""A store of vectors: versions of a Parquet table, of which readers take the newest complete one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns, and the mark of rows written before texts had a stamp.
SCHEMA = "uuid string, model string, dim int, embedding array<float>, embedded_at timestamp, text_hash string, truncated boolean"
UNSTAMPED = "<pre-stamp>"


class VectorStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Those that a finished write has closed."""
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """Vectors of one width; columns that an older version lacks are there, without a stamp. No version: no row."""
        held = self.versions()
        if not held:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.parquet(f"{self.root}/v={held[-1]}")
        missing = {"text_hash": F.lit(UNSTAMPED), "truncated": F.lit(False), "embedded_at": F.lit(None)}
        rows = rows.withColumns({c: v for c, v in missing.items() if c not in rows.columns})
        kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
        return rows.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))

    def _write(self, rows: DataFrame) -> None:
        n = (self.versions() or [0])[-1] + 1
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/v={n}")

    def replace(self, rows: DataFrame) -> None:
        """Vectors of these uuids go and the rows come: doing it again changes nothing."""
        check_width(rows)
        self._write(self.read().join(rows.select("uuid"), "uuid", "left_anti").unionByName(rows.select(*self.read().columns)))

    def prune(self, keys: DataFrame) -> None:
        """Drop the vectors whose uuid no key names; refuses when there is no key."""
        if keys.limit(1).count() == 0:
            raise ValueError("no key is known, so no vector can be told to be an orphan")
        self._write(self.read().join(keys.select("uuid").distinct(), "uuid", "left_semi"))

    def compact(self, files: int = 1, keep: int = 1) -> None:
        """One version of few files; older ones than the last ``keep`` go."""
        if self.versions():
            self._write(self.read().repartition(files))
        for n in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/v={n}"), True)


def check_width(rows: DataFrame) -> None:
    bad = rows.where((F.size("embedding") != F.col("dim")) | F.col("uuid").isNull()).limit(1).count()
    if bad or rows.select("dim").distinct().limit(2).count() > 1:
        raise ValueError("vectors must have a uuid and one width")


def together(stores: list[DataFrame]) -> DataFrame:
    """The vectors of several stores; they must be of one model and one width."""
    rows = reduce(DataFrame.unionByName, stores)
    if rows.select("model", "dim").distinct().limit(2).count() > 1:
        raise ValueError("the stores hold vectors of several models or widths")
    return rows
