"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are encoded once and the ids kept in a table of the shared folder, beside each task's counts of its ids. These are
added up over all documents and ids get ranks, most frequent first (ties by id), so that frequent ids take one byte.
The encoded documents are dealt by ranges of their id and sorted, and each task streams its documents to one shard
file, block by block. A shard is named after its range and the attempt that wrote it, and only the file that a finished
attempt reported is read, so a task that runs again leaves no doubt.

A file is a run of blocks. A block is a header of four little-endian unsigned 32-bit integers (magic, documents, ids,
data bytes), then the document ids (signed 64-bit), a byte for each that is 1 for a null id, the number of ids of each
document (unsigned 32-bit), the control bytes (two bits a value, four values a byte: its length in bytes less one), and
the data bytes. ``ranks.bin`` beside the shards holds the id of each rank as unsigned 32-bit integers.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as B
from . import files

MAGIC = 0x31565342
END_ID = 2
#: Words that a worker remembers before it starts anew; about 110 MB.
CACHE_WORDS = 500_000


# -- coding


def _length_tables() -> tuple[np.ndarray, np.ndarray]:
    """By control byte: the lengths of its four values, and their sum."""
    lengths = ((np.arange(256)[:, None] >> (2 * np.arange(4))[None, :]) & 3) + 1
    return lengths.astype(np.uint8), lengths.sum(axis=1)


LENGTHS, LENGTH_SUMS = _length_tables()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values; the last control byte is filled up with zero bits."""
    v = np.ascontiguousarray(values, "<u4")
    code = ((v > 0xFF).astype(np.uint8) + (v > 0xFFFF)) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= code[:, None]]
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    four = padded.reshape(-1, 4)
    return four[:, 0] | (four[:, 1] << 2) | (four[:, 2] << 4) | (four[:, 3] << 6), data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    at = ends - lengths
    held = np.concatenate([data, np.zeros(4, np.uint8)])
    out = held[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= held[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(out, doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> None:
    control, data = pack(ranks)
    out.write(np.array([MAGIC, len(doc_ids), len(ranks), len(data)], "<u4").tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(counts.astype("<u4").tobytes())
    out.write(control.tobytes())
    out.write(data.tobytes())


def read_blocks(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, ids per document, and ranks of each block."""
    while head := source.read(16):
        magic, docs, n, size = np.frombuffer(head, "<u4").tolist()
        if magic != MAGIC:
            raise ValueError("no block begins here")
        part = lambda count, kind: np.frombuffer(source.read(count * np.dtype(kind).itemsize), kind)
        doc_ids, null, counts = part(docs, "<i8"), part(docs, "u1"), part(docs, "<u4")
        control, data = part(-(-n // 4), "u1"), part(size, "u1")
        yield [None if x else d for d, x in zip(doc_ids.tolist(), null.tolist(), strict=True)], counts.astype(np.int64), unpack(control, data, n)


# -- encoding


@functools.cache
def _word_splitter(last: int) -> re.Pattern:
    """The split pattern of lower-cased word vocabularies; words come first, as nothing else can start where one does."""
    letters, numbers = B.char_class("L", last), B.char_class("N", last)
    return re.compile(f"[{letters}]+|{B.CONTRACTIONS}|[{numbers}]|[^{B.WHITE_SPACE}{letters}{numbers}]+")


class _Remembered(dict):
    """What was made of words. Looking up a new one makes it; at ``most`` words it starts anew."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.make(word)
        return out


class WordEncoder:
    """Whole texts to ids as the tokenizer library gives them; the ids of pre-tokens are remembered.

    It knows vocabularies whose normaliser is NFC, white space to a space, lower case. Texts with special strings, and
    those whose lower-cased form is no NFC text, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.stand_in = {b: c for c, b in B.byte_chars().items()}
        self.size = max(self.library.get_vocab_size(), 1 + max(self.library.get_vocab().values()))
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.model = self.library.model.tokenize
        self.words = _Remembered(self._word_ids, CACHE_WORDS)

    def _word_ids(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else "".join(map(self.stand_in.__getitem__, word.encode()))
        return array("H" if self.kind.itemsize == 2 else "I", [t.id for t in self.model(shown)]).tobytes()

    def _pieces(self, text: str) -> list[str]:
        astral = not text.isascii() and len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return _word_splitter(sys.maxunicode if astral else 0xFFFF).findall(text)

    def _normalised(self, text: str) -> str | None:
        """The text as the normaliser leaves it but for white space; None if the library has to do it."""
        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # The library lowers each character by itself, so a final sigma is like any other.
        text = text.replace("Σ", "σ").lower()
        return text if text.isascii() or unicodedata.is_normalized("NFC", text) else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``kind``."""
        plain = self._normalised(text)
        if plain is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.words.__getitem__, self._pieces(plain)))


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def id_kind(path: str) -> np.dtype:
    """Two bytes where they hold every id of the vocabulary, else four."""
    return _encoder(path).kind


def encoded(docs: DataFrame, path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every row (binary: little-endian, unsigned, of ``id_kind``); null text: the end id alone.
    Beside them each task gives a row whose ``counts`` (binary: little-endian signed 64-bit) tell how often it gave each
    id; it is null elsewhere, and in that row the others are. An empty table gives no row."""
    tail = b"" if end_id is None else np.array([end_id], id_kind(path)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        kind, counts, any_row = encoder.kind, np.zeros(encoder.size, np.int64), False
        if end_id is not None and end_id >= encoder.size:
            raise ValueError(f"the end id {end_id} is beyond the vocabulary")

        def rows(doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
            held = pa.array(ids, pa.binary())
            np.add(counts, np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(counts)), out=counts)
            return pa.RecordBatch.from_arrays([doc_ids, held, pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "counts"])

        for batch in batches:
            ids, size, start = [], 0, 0
            for text in batch.column(1):
                ids.append(encoder.encode(text.as_py() or "") + tail)
                size += len(ids[-1])
                if size > 16_000_000:
                    yield rows(batch.column(0).slice(start, len(ids)), ids)
                    ids, size, start = [], 0, start + len(ids)
            any_row = any_row or batch.num_rows > 0
            yield rows(batch.column(0).slice(start, len(ids)), ids)
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def id_counts(rows: DataFrame) -> DataFrame:
    """``id`` and ``n`` over the ``counts`` of ``encoded``; each task adds up first, so what is shuffled is bounded by the
    vocabulary."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                n = np.frombuffer(counts.as_buffer(), "<i8")
                total = total + n if len(total) else n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return rows.where("counts IS NOT NULL").select("counts").mapInArrow(add_up, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -- files


@dataclass(frozen=True)
class Shard:
    path: str
    documents: int
    ids: int
    start: int


@dataclass(frozen=True)
class TokenFiles:
    """The files of one run, in ascending order of their documents."""

    folder: str
    shards: list[Shard]


def write(spark: SparkSession, docs: DataFrame, path: str, folder: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> TokenFiles:
    """Encode every row of ``docs`` and write the ids in ascending order of ``id_col``.

    Null ids come first; rows with one id come in order of a hash of their ids. A null text is the end id alone. An
    empty table gives no shard. The id column must be a whole number; other columns are not read.
    """
    folder = files.run_folder(spark, "tokens", folder)
    kind = id_kind(path)
    encoded(docs, path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    table = spark.read.parquet(f"{folder}/encoded")
    rows = table.where("ids IS NOT NULL").select("doc_id", "ids")
    counted = sorted(((r.n, r.id) for r in id_counts(table).collect()), key=lambda x: (-x[0], x[1]))  # bounded by the vocabulary
    by_rank = np.array([i for _, i in counted], "<u4")
    fs, at = files.create(f"{folder}/ranks.bin")
    with fs.open_output_stream(at) as out:
        out.write(by_rank.tobytes())
    rank_of = np.zeros(1 + int(by_rank.max(initial=0)), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, out, n_docs, n_ids = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.svb", None, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids = [np.frombuffer(x.as_buffer(), kind) for x in part.column(1)]
                if out is None:
                    fs, at = files.create(name)
                    out = fs.open_output_stream(at)
                write_block(out, part.column(0).to_pylist(), np.array([len(x) for x in ids]), ranks.value[np.concatenate(ids)])
                n_docs, n_ids = n_docs + len(ids), n_ids + sum(map(len, ids))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": name, "documents": n_docs, "ids": n_ids}])

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("ids")
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "ids")
    written = ordered.mapInArrow(run, "shard long, path string, documents long, ids long")
    out, start = [], 0
    for r in sorted(written.collect(), key=lambda r: r.shard):  # a row for each shard
        out.append(Shard(r.path, r.documents, r.ids, start))
        start += r.ids
    return TokenFiles(folder, out)


def read(spark: SparkSession, token_files: TokenFiles, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) and, if
    asked for, ``ids`` of every document, decoded from the files; a task reads shards, block by block. Repeated rows and
    null ids come as they were written; no shard gives no row."""
    folder = token_files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if by_rank is None:
                    fs, at = files.locate(f"{folder}/ranks.bin")
                    with fs.open_input_file(at) as f:
                        by_rank = np.frombuffer(f.read(), "<u4")
                fs, at = files.locate(path)
                with fs.open_input_stream(at) as source:
                    for doc_ids, counts, ranks in read_blocks(source):
                        ids, ends = by_rank[ranks], np.cumsum(counts)
                        each = np.split(ids, ends[:-1])
                        columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                        start += len(ids)
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    shards = [(x.path, x.start) for x in token_files.shards]
    return spark.createDataFrame(shards, "path string, start long").repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
