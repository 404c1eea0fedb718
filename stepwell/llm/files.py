"""Binary files in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def run_folder(spark: SparkSession, kind: str, folder: str | None = None) -> str:
    """A new folder for one run's files, below ``folder`` or the session's shared folder."""
    return f"{(folder or shared_folder(spark)).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def unused(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that differ from those taken, whatever the case of letters."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def create(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a file to write, its folder made."""
    fs, path = locate(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs, path


def remove(uri: str) -> None:
    """Delete a folder that this run has written and no longer reads."""
    fs, path = locate(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` as a written table: its true size is known, and a lost executor does not compute it again."""
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
