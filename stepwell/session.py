"""Session settings, and what workers need to import this package."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build(app: str = "stepwell", cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that results rely on (UTC) and those for one machine."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return share_code(builder.config(map=settings).getOrCreate())


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies; on a cluster, ship it with --py-files instead."""
    env = spark.sparkContext.environment
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark  # they find it already; another environment would be other workers beside those that run
    if str(ROOT) not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one is made only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/stepwell-{os.getuid()}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` as a table in the shared folder, for what several branches read: it is computed once, each branch reads
    its own columns of it, and a lost executor does not compute it again."""
    folder = f"{shared_folder(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
