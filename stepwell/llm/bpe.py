"""Byte-pair encoding with contiguous rank arrays.

A text is cut into pre-tokens (the split pattern of byte-level vocabularies), and each distinct pre-token is encoded
once per worker and remembered in a bounded cache. A short pre-token is a row of a matrix: its part boundaries and the
ranks of its adjacent pairs lie in contiguous arrays, the smallest rank of each row is looked for, the boundary inside
that pair is deleted and the two neighbouring ranks are refreshed, until no row has a known pair. Many words go
through each numpy step together. Pre-tokens beyond ``LONG`` bytes, where repeated scans would be quadratic, use a heap
over a linked list, which picks the same merges (smallest rank, leftmost first).

Special strings of the vocabulary that occur inside a text become their ids, as the tokenizer library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of more bytes are encoded with a heap.
LONG = 48
#: Words a worker remembers before it starts anew; about 120 MB.
CACHE_WORDS = 300_000
#: Characters tokenised together.
CHUNK_CHARS = 1_500_000
_NO_RANK = np.int32(2**31 - 1)

#: The White_Space property, and the contractions of the split pattern.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@functools.cache
def char_class(major: str, last: int = sys.maxunicode) -> str:
    """The ranges of a general category's characters up to ``last``, as the inside of a character class of ``re``."""
    ranges, start = [], None
    for code in range(last + 2):
        inside = code <= last and unicodedata.category(chr(code))[0] == major
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(ranges)


@functools.cache
def splitter(last: int = sys.maxunicode) -> re.Pattern:
    """The split pattern for texts without characters beyond ``last``. ``re`` tests a class of few ranges far faster.
    Words come first, as no other alternative can start where one does."""
    letters, numbers = char_class("L", last), char_class("N", last)
    return re.compile(f" ?[{letters}]+|{CONTRACTIONS}| ?[{numbers}]+| ?[^{WHITE_SPACE}{letters}{numbers}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")


def split_text(text: str) -> list[str]:
    astral = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
    return splitter(sys.maxunicode if astral else 0xFFFF).findall(text)


@functools.cache
def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class RankTable:
    """Pairs of token ids with their merge rank and result: open addressing over two flat arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NO_RANK, np.int32)
        self.merged_by_rank = merged.astype(np.int32)
        left, rank = pairs.astype(np.int64), np.arange(len(pairs), dtype=np.int32)
        at = self._slot(left)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at] == -1
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = left[put], rank[put]
            left, rank, at = left[~put], rank[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(-7046029254386353131)) >> np.int64(64 - self.bits)) & np.int64((1 << self.bits) - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; ``_NO_RANK`` where there is none. A negative id has no pair."""
        key = (left.astype(np.int64) << 20) | right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], _NO_RANK)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        chars = byte_chars()
        vocab = model["vocab"]
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = np.full(256, -1, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab.get(c, -1)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64).reshape(-1)
        self.table = RankTable(pairs, np.array([vocab[a + b] for a, b in merges], np.int32))
        self.pair_rank: dict[int, int] | None = None
        self._pairs = pairs

    # -- words -> ids

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(raw)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LONG)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(rows, max(1, len(rows) // 20_000)):
                if len(part):
                    ids, n = self._merge_rows([raw[i] for i in part], lengths[part])
                    for k, i in enumerate(part):
                        out[i] = ids[k, : n[k]].astype("<u4")
        for i in np.flatnonzero(lengths > LONG):
            out[i] = np.array(self._merge_long(raw[i]), "<u4")
        return out

    def _merge_rows(self, raw: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(raw), int(lengths.max())
        flat = np.frombuffer(b"".join(raw), np.uint8)
        parts = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1)[None, :] < lengths[:, None]
        parts[inside] = self.byte_id[flat]
        ranks = self.table.lookup(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width)
        done, left = np.zeros((n, width + 1), np.int32), lengths.copy()
        rows, columns = np.arange(n), np.arange(width + 1)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            open_ = best < _NO_RANK
            if not open_.all():
                done[rows[~open_]] = parts[~open_]
                rows, parts, ranks, at, best = rows[open_], parts[open_], ranks[open_], at[open_], best[open_]
            if not len(rows):
                return done, left
            here = np.arange(len(rows))
            gone = columns[None, :] > at[:, None]
            parts[here, at] = self.table.merged_by_rank[best]
            parts[:, :-1] = np.where(gone[:, :-1], parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(gone[:, :-2], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NO_RANK
            left[rows] -= 1
            ranks[here, at] = self.table.lookup(parts[here, at], parts[here, np.minimum(at + 1, width)])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.table.lookup(parts[before, at[before] - 1], parts[before, at[before]])

    def _merge_long(self, raw: bytes) -> list[int]:
        if self.pair_rank is None:
            self.pair_rank = {int(p): r for r, p in enumerate(self._pairs)}
        rank, merged = self.pair_rank, self.table.merged_by_rank
        ids = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank.get((ids[x] << 20) | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    # -- texts

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a text, in order."""
        split = split_text
        if self.special_split is None or not any(s in text for s in self.special):
            return split(text)
        out: list[str] = []
        for k, part in enumerate(self.special_split.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                # A word equal to a special string cannot come out of the split between special strings.
                out.extend(split(part))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class WordCache(dict):
    """What a worker knows of pre-tokens: word -> ``make(ids)``. Bounded: it starts anew when it is full."""

    def __init__(self, bpe: ByteBpe, make, known: dict | None = None, most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.bpe, self.make, self.known, self.most = bpe, make, known or {}, most
        self._start()

    def _start(self) -> None:
        self.clear()
        self.update(self.known)
        for s, i in self.bpe.special.items():
            self[s] = self.make(np.array([i], "<u4"))

    def learn(self, chunks: list[list[str]]) -> None:
        """Afterwards every word of the chunks can be looked up."""
        words = set().union(*chunks)
        new = list(words - self.keys())
        if len(self) + len(new) > self.most + len(self.known):
            self._start()
            new = list(words - self.keys())
        for word, ids in zip(new, self.bpe.encode_words(new), strict=True):
            self[word] = self.make(ids)


def chunks(texts: Iterable[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts of about ``most`` characters; null is the empty text."""
    held, size = [], 0
    for t in texts:
        t = t or ""
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.cache
def load(path: str) -> ByteBpe:
    """One vocabulary per worker process."""
    return ByteBpe(path)


@functools.cache
def _id_bytes(path: str) -> WordCache:
    return WordCache(load(path), np.ndarray.tobytes)


#: What ``encode_decode`` can return of a text.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, outputs: Iterable[str] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the chosen ``outputs`` of every row of ``docs``: the ids of the whole text as the tokenizer
    library gives them without added special tokens, and what those ids decode to with special tokens kept.

    ``ids_sha256`` is over the decimal ids joined by commas. One row out for each row in, repeated rows included; a null
    text counts as empty (no ids, empty decoded text), a null id stays null, other columns are not read.
    """
    outputs = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = load(path), _id_bytes(path)
        decimal = list(map(str, range(len(bpe.token_bytes))))
        token = bpe.token_bytes.__getitem__
        for batch in batches:
            out: dict[str, list] = {c: [] for c in outputs}
            for texts in chunks(batch.column(1).to_pylist()):
                split = [bpe.pieces(t) for t in texts]
                cache.learn(split)
                for pieces in split:
                    ids = np.frombuffer(b"".join(map(cache.__getitem__, pieces)), "<u4").tolist()
                    for c, values in out.items():
                        if c == "n_tokens":
                            values.append(len(ids))
                        elif c == "ids":
                            values.append(ids)
                        elif c == "ids_sha256":
                            values.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                        else:
                            decoded = b"".join(map(token, ids)).decode("utf-8", "replace")
                            values.append(decoded if c == "decoded" else hashlib.sha256(decoded.encode()).hexdigest())
            kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[OUTPUTS[c]]) for c, v in out.items())], [id_col, *outputs])

    slim = docs.select(docs[id_col], docs[text_col].cast("string"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs))


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the decoded text of an array of ids in ``text_col``, which must be a new column; a null array gives null,
    an empty one the empty text; an empty table gives no row."""
    if text_col.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {text_col} already")

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return rows.withColumn(text_col, decode(F.col(ids_col)))
