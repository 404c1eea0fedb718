"""Micro-batch forms of the passes: file streams in, state tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lake import Lake


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Files that arrive in a folder; each is read once, as the checkpoint keeps what has been."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tool_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls by tool and window of event time. Rows later than the watermark are dropped, which bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "tool_name").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool_name", "n")


def quiet_sessions(writes: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of writes of a session with no gap of the quiet period: what is done being written."""
    return writes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("writes")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "writes")


def first_by_id(rows: DataFrame, key: str = "uuid", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once; its state goes when the watermark has passed it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sync_lake(stream: DataFrame, lake: Lake, table: str, corpus: str, checkpoint: str):
    """Replace, in each batch, the sessions that it holds. A batch that runs again replaces the same rows by the same,
    so rows are in the lake exactly once. Stops when what is there has been read."""

    def upsert(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            lake.sync({table: batch}, corpus, batch)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
