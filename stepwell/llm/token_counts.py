"""Token counts by a map-side two-tier lookup.

First tier: a table of the token counts of frequent pre-tokens, broadcast once. It is made from the vocabulary, whose
entries are the strings that were frequent enough to be merged, so its size is bounded by the vocabulary, whatever the
corpus holds. Second tier: pre-tokens that miss it are encoded in the worker, once, and kept in the worker's bounded
cache. Pre-tokens never leave the task that read them, so nothing is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe as B


def frequent_lengths(path: str) -> dict[str, int]:
    """Vocabulary entries that are one pre-token, with the number of tokens they are encoded to."""
    bpe, words = B.load(path), []
    for raw in bpe.token_bytes:
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        if word and word not in bpe.special and B.split_text(word) == [word]:
            words.append(word)
    return dict(zip(words, map(len, bpe.encode_words(words)), strict=True))


@functools.cache
def _cache(path: str) -> B.WordCache:
    return B.WordCache(B.load(path), len)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    Counts are those of the tokenizer library for the whole text, without added special tokens; special strings inside
    a text count one each. One row out for each row in, repeated rows included; a null text counts as empty (0, 0,
    false), a null id stays null, other columns are not read.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = B.load(path), _cache(path)
        if not cache.known:
            cache.known = frequent.value
            cache._start()
        for batch in batches:
            sizes, counts = [], []
            for texts in B.chunks(batch.column(1).to_pylist()):
                split = [bpe.pieces(t) for t in texts]
                cache.learn(split)
                sizes += [len(t.encode()) for t in texts]
                counts += [sum(map(cache.__getitem__, pieces)) for pieces in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(docs[id_col], docs[text_col].cast("string"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
