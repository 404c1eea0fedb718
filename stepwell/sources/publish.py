"""Writing a corpus: session folders, blobs, and the digests that tell whether a source has changed meanwhile."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .corpus import session_id_ok

#: Names of the corpora that everybody has, by their place below the home folder.
RESERVED = {"~/.claude": "default", "~/.codex/sessions": "codex"}
SLUG_CHARS, DIGEST_CHARS = 32, 8
META = "meta.json"


def slug(root: str) -> str:
    """A folder name for a corpus: its own name, as far as it can be read, and a digest of where it lies."""
    place = Path(root).expanduser().resolve()
    for known, name in RESERVED.items():
        if place == Path(known).expanduser().resolve():
            return name
    digest = hashlib.sha256(str(place).encode()).hexdigest()[:DIGEST_CHARS]
    return "-".join(filter(None, [re.sub("[^a-z0-9]+", "-", place.name.lower()).strip("-")[:SLUG_CHARS], digest]))


def _locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """A whole file or none: written beside its place under a name that no other task has, then moved."""
    beside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as out:
        out.write(data)
    fs.move(beside, path)


def _done(rows: DataFrame, write) -> int:
    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def publish(sessions: DataFrame, root: str) -> int:
    """Write sessions (``session_id``, ``artifacts``: name -> text, ``meta.json`` among them) to their folders; how many.

    Readers pass over a folder without ``meta.json``: it goes first and comes last, so nobody sees old and new artifacts
    together, and a task that is lost halfway leaves a folder that its second run completes. Artifacts that a session no
    longer has go. Sessions with an improper id, without ``meta.json`` or null are left out; repeated ids are an error."""
    ok = sessions.where(session_id_ok(F.col("session_id")) & F.coalesce(F.map_contains_key("artifacts", META), F.lit(False)))
    ids = Window.partitionBy("session_id")
    once = ok.withColumn("n", F.count("*").over(ids)).select(F.when(F.col("n") == 1, F.col("session_id")).otherwise(F.raise_error(F.concat(F.lit("two sessions are named "), "session_id")).cast("string")).alias("session_id"), "artifacts")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _locate(root)
        for batch in batches:
            for sid, given in zip(batch.session_id, batch.artifacts, strict=True):
                texts, folder = dict(given), f"{base.rstrip('/')}/sessions/{sid}"
                fs.create_dir(folder, recursive=True)
                held = [i.path for i in fs.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.File]
                for path in sorted(held, key=lambda p: not p.endswith(f"/{META}")):
                    if path.rpartition("/")[2] not in texts.keys() - {META}:
                        fs.delete_file(path)
                for name in sorted(texts, key=lambda n: n == META):
                    _put(fs, f"{folder}/{name}", texts[name].encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return _done(once, write)


def store_blobs(blobs: DataFrame, root: str) -> int:
    """Write contents (``sha256``, ``data``) below ``blobs/sha256`` unless they are there; how many were not. A file of
    another size under the name is torn and is replaced. A content that is not what its name says is an error."""
    named = blobs.where("data IS NOT NULL").select(F.when(F.sha2("data", 256) == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error(F.lit("a blob is not what its name says")).cast("string")).alias("sha256"), "data")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _locate(root)
        for batch in batches:
            n = 0
            for name, data in zip(batch.sha256, batch.data, strict=True):
                folder = f"{base.rstrip('/')}/blobs/sha256/{name[:2]}"
                if fs.get_file_info(f"{folder}/{name}").size != len(data):
                    fs.create_dir(folder, recursive=True)
                    _put(fs, f"{folder}/{name}", bytes(data))
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return _done(named, write)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``bytes`` and ``sha256`` of source files; what is named may be a glob."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are not what they were when they were read, gone or new ones among them: what is made of them is refused."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    why = F.when(F.col("b.path").isNull(), "gone").when(F.col("a.path").isNull(), "new").when(~(F.col("a.sha256").eqNullSafe(F.col("b.sha256")) & F.col("a.bytes").eqNullSafe(F.col("b.bytes"))), "changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), why.alias("why")).where("why IS NOT NULL")


def recent_median(samples: DataFrame, key: str, order: str, value: str, last: int = 7) -> DataFrame:
    """The median of each key's last samples; none while there are fewer."""
    newest = samples.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= last)
    return newest.groupBy(key).agg(F.count("*").alias("_n"), F.median(value).alias("median")).where(F.col("_n") == last).select(key, "median")
