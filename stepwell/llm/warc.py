"""WARC archives: written with revisit records for equal payloads, read back and assembled to captures.

Writing. Payload digests and sizes are taken first; only rows of digest and page id meet to find, for each payload that
occurs more than once, the page that keeps it. Then each task streams its pages to archives, a gzip member a record, and
each capture is three records: the request and the metadata name the response or revisit record in WARC-Concurrent-To.
An archive is named after its task's attempt, and only those that a finished attempt reported are read.

Reading. A task reads an archive as a stream of records. The records of a capture meet through their concurrent-to
identifiers and become one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256_000_000
_SPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "captures.stepwell.invalid")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_originals(pages: DataFrame, least: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), ``digest`` and ``original``: of the rows with an equal payload of at
    least ``least`` bytes, the largest page id if it is another page's, else null.

    Digests are counted before they are shuffled, so a payload that a third of all pages share is one row a task; rows
    of page id and digest alone are joined with those that occur more than once."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    shared = slim.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(shared, "digest").where("original IS NOT NULL AND NOT page_id <=> original").distinct().select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "original")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def _record(kind: str, record_id: str, uri: str | None, content_type: str, block: bytes, date: str, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe="%/:?#[]@!$&'()*+,;=~-._")))
    head += [*more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def capture_records(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, own_id: str, date: str) -> bytes:
    """The response or revisit, request and metadata records of one page."""
    together = ("WARC-Concurrent-To", f"<urn:uuid:{own_id}>")
    digest32 = ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if original is None:
        first = _record("response", own_id, url, "application/http;msgtype=response", http + payload, date, digest32)
    else:
        first = _record("revisit", own_id, url, "application/http;msgtype=response", http, date, digest32, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{record_id(original, digest)}>"))
    ask = _record("request", str(uuid.uuid5(_SPACE, own_id + "/request")), url, "application/http;msgtype=request", request_head(url), date, together)
    fields = {"page-id": page_id, "payload-length": len(payload), "refers-to-page": original, "no-uri": 1 if url is None else None, "uri": None if url is None else base64.b64encode(url.encode()).decode()}
    about = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()
    return first + ask + _record("metadata", str(uuid.uuid5(_SPACE, own_id + "/metadata")), url, "application/warc-fields", about, date, together)


def request_head(url: str | None) -> bytes:
    """The request for a page: path and query as target, the host beside it; ``*`` stands for a host that the url lacks."""
    try:
        parts = urlsplit(url or "")
        host, path, query = parts.netloc.rpartition("@")[2], parts.path, parts.query
    except ValueError:
        host, path, query = "", url or "", ""
    keep = "%/:@!$&'()*+,;=~-._"
    target = quote(path, safe=keep) + ("?" + quote(query, safe=keep + "?") if query else "")
    named = quote(host, safe="[]:.-_~%")
    return f"GET {target if target.startswith('/') else '/' + target} HTTP/1.1\r\nHost: {named or '*'}\r\n\r\n".encode()


def record_id(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(_SPACE, f"{page_id}/{digest}"))


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Write a capture for every row of ``pages``; the archives' locations.

    Null html is an empty payload, a null url leaves the target out. Repeated rows are captures of their own. Of rows
    with equal payloads and a null id the named ones win. An empty table gives no archive. Ids must be whole numbers;
    other columns are not read.
    """
    folder = files.run_folder(spark, "warc", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size, n, before = TaskContext.get(), None, 0, 0, None
        for batch in batches:
            for page_id, url, payload, digest, original in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is not None and size > ARCHIVE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    name, size, n = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", 0, n + 1
                    fs, at = files.create(name)
                    out = fs.open_output_stream(at, compression=None)
                    yield pa.RecordBatch.from_pylist([{"path": name}])
                key = page_id.as_py(), digest.as_py()
                own = record_id(*key) if key != before else str(uuid.uuid4())
                before = key
                size += out.write(capture_records(key[0], url.as_py(), payload.as_py(), key[1], original.as_py(), own, date))
        if out is not None:
            out.close()

    rows = with_originals(pages, least, id_col, url_col, html_col).select("page_id", "url", "payload", "digest", "original")
    return sorted(r.path for r in rows.sortWithinPartitions("page_id", "digest").mapInArrow(run, "path string").collect())  # a row for each archive


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream of gzip members."""
    with gzip.GzipFile(fileobj=source) as f:
        while True:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            yield head, f.read(int(head["content-length"]))


_COLUMNS = {"archive": "string", "record_id": "string", "concurrent_to": "string", "kind": "string", "refers_to_record": "string", "payload_digest": "string", "payload_bytes": "long", "payload": "binary", "block": "binary"}


def read_records(spark: SparkSession, archives: list[str], with_payload: bool = True) -> DataFrame:
    """A row for every record; digests and sizes of payloads that are there are taken from the payload itself. No archive
    gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c, kinds[k]) for c, k in _COLUMNS.items()])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held: list[dict] = []
                size = 0
                fs, at = files.locate(archive)
                with fs.open_input_stream(at, compression=None) as source:
                    for head, block in records(source):
                        row = {"archive": archive, "record_id": head["warc-record-id"], "concurrent_to": head.get("warc-concurrent-to"), "kind": head["warc-type"], "refers_to_record": head.get("warc-refers-to")}
                        if row["kind"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            row |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload if with_payload else None}
                        elif row["kind"] == "revisit":
                            row["payload_digest"] = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        else:
                            row["block"] = block
                        held.append(row)
                        size += len(block) if with_payload else 500
                        if size > 16_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    # Names travel as rows, not in every task's closure.
    return spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, len(archives))).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in _COLUMNS.items()))


def captures(rows: DataFrame) -> DataFrame:
    """One nested row for each capture of ``read_records``: ``page_id``, ``url``, the ``response`` or revisit, the
    ``request`` and the ``metadata``. A capture's records lie in one archive, so repeated rows stay apart. Records
    without their response give a row whose ``response`` is null; a missing request or metadata record is null."""
    own = F.coalesce("concurrent_to", "record_id")
    field = lambda name: F.nullif(F.regexp_extract(F.col("metadata.block").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    main = F.col("kind").isin("response", "revisit")
    nested = (
        rows.groupBy("archive", own.alias("capture"))
        .agg(
            F.first(F.when(main, F.struct("record_id", "kind", "refers_to_record", "payload_digest", "payload_bytes", "payload")), True).alias("response"),
            F.first(F.when(F.col("kind") == "request", F.struct("record_id", "block")), True).alias("request"),
            F.first(F.when(F.col("kind") == "metadata", F.struct("record_id", "block")), True).alias("metadata"),
        )
        .withColumns({"page_id": field("page-id").cast("long"), "url": F.unbase64(field("uri")).cast("string"), "refers_to": field("refers-to-page").cast("long"), "length": field("payload-length").cast("long")})
    )
    return nested.withColumn("payload_bytes", F.coalesce("response.payload_bytes", "length")).drop("length")


def digests(assembled: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of every capture; null where a
    record that tells it is missing."""
    return assembled.select("page_id", "payload_bytes", F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), "refers_to")
