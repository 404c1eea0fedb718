"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Counting. Every task counts the words of its training documents and the counts are summed by a 64-bit hash of the word
(at a billion distinct words two share one with a probability of some per cent). Words above a count that at most
``Settings.frequent_words`` words reach make up a table that is broadcast; most tokens are looked up there. The others
are joined, by hash, with the counts.

Model. Its units are the end of a document, the most frequent words, and a class for each ending of all other words (a
hash of a word's last three bytes), so the context tells something of every word, however rare. Two context units
predict the next: score(w | u, v) = r_w . (c1 * q_u + c2 * q_v) + b_w. It is trained in numpy against noise from the
counts, whose logarithms the biases start from. Every task trains on its documents and the parameters are merged, weighted
by tokens; sums are of whole numbers, so their order does not matter. A first round takes a fifth of the training
documents (by a hash of the text), the second goes on with the others, so each document is learned from once.

Scoring. Batched matrix products of the contexts of many documents with all units give the normalisers, which a worker
remembers, within a bound, by context; the log-probabilities are normalised exactly. A word of a class gets, besides, its
share of the class by its count (0.5 is added to counts, one share is for unseen words).
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .language_id import training

END = 0


@dataclass(frozen=True)
class Settings:
    part: int = 1
    parts: int = 5
    #: Bound of the broadcast table of counts: 17 bytes a word.
    frequent_words: int = 200_000
    #: Units: single words, and classes of all others.
    words: int = 1000
    endings: int = 1000
    #: Per cent of the training documents that the first of the two rounds takes.
    first_share: int = 20
    dimensions: int = 16
    noise: int = 64
    batch: int = 2048
    rate: float = 0.1
    #: Contexts whose normaliser a worker remembers.
    contexts: int = 1 << 22


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased; bytes.lower() and bytes.split() do exactly that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) - (1 << 63)


def ending(word: bytes, endings: int) -> int:
    """The class of a word, from 0 on: by its last three bytes before closing marks."""
    return xxhash.xxh32_intdigest(word.rstrip(b".,;:!?")[-3:]) % endings


def word_counts(docs: DataFrame, endings: int) -> DataFrame:
    """``h``, ``ending`` and ``n`` of the words of the first column. A task sends each word once for every 400,000
    different ones."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in counts], pa.int64()), pa.array([ending(w, endings) for w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["h", "ending", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > 400_000:
                    yield rows()
        yield rows()

    return docs.mapInArrow(add_up, "h long, ending int, n long").groupBy("h").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before each of documents one after another, whose beginnings are preceded by ends."""
    u = np.concatenate([[END], ids[:-1]])[: len(ids)]
    v = np.concatenate([[END, END], ids[:-2]])[: len(ids)]
    v[u == END] = END
    return u, v


def _add(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows, kind="stable")  # of two bytes, a radix sort
    rows = rows[order]
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[at], np.add.reduceat(values[order], at, axis=0)


class Learner:
    """The model in training: its parameters and the sums of squared gradients that their steps are scaled by."""

    def __init__(self, unigram: np.ndarray, settings: Settings) -> None:
        """``unigram``: counts of all units over all training documents."""
        self.settings, self.unigram = settings, unigram
        p = (unigram + 0.5) / (unigram + 0.5).sum()
        rng = np.random.default_rng(0)
        target, context = (rng.normal(0, 0.1, (len(p), settings.dimensions)).astype(np.float32) for _ in range(2))
        places = np.ones((2, settings.dimensions), np.float32) * np.array([[1.0], [0.5]], np.float32)
        self.params = [target, context, places, np.log(p).astype(np.float32)]
        self.squares = [np.full_like(x, 1e-5) for x in self.params]
        self.drawn_by = np.cumsum(p) / p.sum()
        self.log_noise = np.log(settings.noise * p).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.params + self.squares]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        parts = np.split(flat, np.cumsum([x.size for x in self.params + self.squares])[:-1])
        shaped = [np.array(x, np.float32).reshape(y.shape) for x, y in zip(parts, self.params + self.squares, strict=True)]
        self.params, self.squares = shaped[: len(self.params)], shaped[len(self.params) :]

    def _step(self, which: int, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        param, square = self.params[which], self.squares[which]
        square[rows] += gradient * gradient
        param[rows] -= np.float32(self.settings.rate) * gradient / np.sqrt(square[rows])

    def learn(self, units: np.ndarray, rng: np.random.Generator) -> None:
        """A pass, in random order, over the units of documents one after another, each with its end."""
        u, v = contexts(units)
        order = rng.permutation(len(units))
        for start in range(0, len(units), self.settings.batch):
            target, context, places, bias = self.params
            at = order[start : start + self.settings.batch]
            y, cu, cv = units[at], context[u[at]], context[v[at]]
            q = cu * places[0] + cv * places[1]
            drawn = np.minimum(np.searchsorted(self.drawn_by, rng.random(self.settings.noise)), len(bias) - 1)
            each = np.float32(1 / len(at))
            # Logistic errors of the true units (wanted: 1) and of the noise, shared by the batch (wanted: 0).
            e_true = (1 / (1 + np.exp(-((q * target[y]).sum(1) + bias[y] - self.log_noise[y]))) - 1) * each
            e_noise = 1 / (1 + np.exp(-(q @ target[drawn].T + bias[drawn] - self.log_noise[drawn]))) * each
            g_q = e_true[:, None] * target[y] + e_noise @ target[drawn]
            wanted = np.concatenate([y, drawn])
            rows, sums = _add(wanted, np.concatenate([np.column_stack([e_true[:, None] * q, e_true]), np.column_stack([e_noise.T @ q, e_noise.sum(0)])]))
            self._step(0, rows, sums[:, :-1])
            self._step(3, rows, sums[:, -1])
            self._step(1, *_add(np.concatenate([u[at], v[at]]), np.concatenate([g_q * places[0], g_q * places[1]])))
            self._step(2, slice(None), np.stack([(g_q * cu).sum(0), (g_q * cv).sum(0)]))


class Scorer:
    """Normalised log-probabilities of a learned model."""

    def __init__(self, params: list[np.ndarray], remembered: int) -> None:
        self.target, self.context, self.places, self.bias = params
        self.size = len(self.bias)
        self.keys = np.full(min(remembered, self.size**2), -1, np.int64)
        self.norms = np.zeros(len(self.keys), np.float32)

    def _queries(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.context[u] * self.places[0] + self.context[v] * self.places[1]

    def normalisers(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        key = u * np.int64(self.size) + v
        slot = key % len(self.keys)
        out, new = self.norms[slot], self.keys[slot] != key
        if new.any():
            wanted, place = np.unique(key[new], return_inverse=True)
            norms = np.empty(len(wanted), np.float32)
            for start in range(0, len(wanted), 128):
                part = wanted[start : start + 128]
                z = self._queries(part // self.size, part % self.size) @ self.target.T
                z += self.bias
                top = z.max()
                z -= top
                np.exp(z, out=z)
                norms[start : start + 128] = z.sum(axis=1)
                if not norms[start : start + 128].min() > 1e-25:
                    # A context whose scores all are far below another's: each by its own largest one.
                    z = (self._queries(part // self.size, part % self.size) @ self.target.T + self.bias).astype(np.float64)
                    norms[start : start + 128] = np.logaddexp.reduce(z, axis=1)
                else:
                    norms[start : start + 128] = np.log(norms[start : start + 128]) + top
            self.keys[wanted % len(self.keys)], self.norms[wanted % len(self.keys)] = wanted, norms
            # Two new contexts may share a place: the last one stays, so keys and norms are set alike.
            out[new] = norms[place]
        return out

    def log_probabilities(self, units: np.ndarray) -> np.ndarray:
        """Natural logarithms of each unit of documents one after another."""
        u, v = contexts(units)
        return (self._queries(u, v) * self.target[units]).sum(1) + self.bias[units] - self.normalisers(u, v)


def _pieces(column: pa.ListArray, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, row after the last, and ids of runs of rows with about ``most`` ids."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop, values[offsets[start] : offsets[stop]].astype(np.int64)
        start = stop


#: A worker's scorer of the last model, by the run's folder: what it remembers of contexts outlives a task.
_SCORERS: dict[str, Scorer] = {}
#: Merged parameters are sums of whole numbers: shares of this.
_UNIT = 1 << 40


def learn_from_all(rounds: list[DataFrame], learner: Learner) -> None:
    """A round for each of the tables (``own``: units of a document with its end). Tasks start from the parameters so far,
    which the mean of theirs by units follows; a round without a row changes nothing."""
    s = learner.settings
    for rows in rounds:
        total = rows.agg(F.sum(F.size("own").cast("long"))).first()[0]
        if not total:
            continue
        held = rows.sparkSession.sparkContext.broadcast((learner.unigram, learner.flat()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Learner(held.value[0], s)
            mine.load(held.value[1])
            rng, n, waiting, size = np.random.default_rng(TaskContext.get().partitionId()), 0, [], 0
            for batch in batches:
                for _, _, units in _pieces(batch.column(0)):
                    waiting.append(units)
                    size += len(units)
                    if size >= 400_000:
                        mine.learn(np.concatenate(waiting), rng)
                        n, waiting, size = n + size, [], 0
            if size:
                mine.learn(np.concatenate(waiting), rng)
                n += size
            if n:
                parts = np.rint(mine.flat() * (n / total * _UNIT)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array(parts)], ["at", "part"])

        sums = rows.select("own").mapInArrow(run, "at int, part long").groupBy("at").agg(F.sum("part").alias("part")).toArrow().sort_by("at")
        learner.load(np.array(sums["part"], np.float64) / _UNIT)


class _Codes(dict):
    """Words and their codes; a word that is looked up for the first time gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class Lookup:
    """What a worker knows of words: each has a code, and by code its place in the broadcast table (or the place behind the
    last one), its hash and its class. It starts anew before a chunk once it knows ``most`` words."""

    most = 400_000

    def __init__(self, hashes: np.ndarray, endings: int) -> None:
        self.hashes, self.endings, self.codes, self.n = hashes, endings, _Codes(), 0
        self.place, self.hash, self.ending = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, words: list[list[bytes]]) -> np.ndarray:
        """The codes of the words of texts one after another."""
        if len(self.codes) > self.most:
            self.codes.clear()
            self.n = 0
        out = np.fromiter(map(self.codes.__getitem__, itertools.chain.from_iterable(words)), np.int64, sum(map(len, words)))
        n, new = self.n, list(itertools.islice(self.codes, self.n, None))
        if n + len(new) > len(self.place):
            room = n + len(new) + self.most // 4
            self.place, self.hash, self.ending = (np.concatenate([x[:n], np.zeros(room - n, x.dtype)]) for x in (self.place, self.hash, self.ending))
        h = np.fromiter(map(word_hash, new), np.int64, len(new))
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        self.place[n : n + len(new)] = np.where(known, at, len(self.hashes))
        self.hash[n : n + len(new)] = h
        self.ending[n : n + len(new)] = np.fromiter((ending(w, self.endings) for w in new), np.int32, len(new))
        self.n = len(self.codes)
        return out


def _chunks(texts, most: int = 2_000_000) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for t in texts:
        t = t.as_py()
        held.append(tokens(t))
        size += len(t or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def score(docs: DataFrame, settings: Settings = Settings(), folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (both log10)
    of every row of ``docs``.

    Learned from the rows that aren't held out, repeated rows counting each; a null id counts as the empty text there.
    A null text is empty: its one token is the end. Without training rows every count is 0 and the model knows only its
    units. One row out for each row in; other columns are not read.
    """
    return fit(docs, settings, folder, id_col, text_col)[0]


def fit(docs: DataFrame, settings: Settings = Settings(), folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Learner]:
    """``score`` and the model it comes from."""
    spark, s = docs.sparkSession, settings
    folder = files.run_folder(spark, "lm", folder)
    held_out, is_training = training(id_col, s.part, s.parts)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out")).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    n_docs = docs.where(is_training).count()
    counts = files.stored(word_counts(docs.where(is_training).select(F.col(text_col).cast("string").alias("text")), s.endings), f"{folder}/counts")
    size = F.floor(F.log2("n"))
    by_size = {r["size"]: r["words"] for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()}  # 64 rows at most
    of_class = np.zeros((2, s.endings), np.int64)  # different words and tokens
    for r in counts.groupBy("ending").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():  # a row for each ending
        of_class[:, r["ending"]] = r["words"], r["n"]
    distinct, total = int(of_class[0].sum()) + (n_docs > 0), int(of_class[1].sum()) + n_docs
    least = 64
    while least and sum(words for k, words in by_size.items() if k >= least - 1) <= s.frequent_words:
        least -= 1
    rows = counts.where(size >= least).toArrow().sort_by("h")
    hashes, n, endings = (np.array(rows[c], np.int64) for c in ("h", "n", "ending"))

    # Units: the end, the endings, the single words; by place in the table 0 stands for a word's ending.
    own = np.lexsort((hashes, -n))[: s.words]
    unit_of = np.zeros(len(n) + 1, np.int32)
    unit_of[own] = 1 + s.endings + np.arange(len(own))
    np.subtract.at(of_class, (0, endings[own]), 1)
    np.subtract.at(of_class, (1, endings[own]), n[own])
    unigram = np.concatenate([[n_docs], of_class[1], n[own]]).astype(np.float64)
    log_share = np.log10(of_class[1] + 0.5 * (of_class[0] + 1))
    log_total = float(np.log10(total + 0.5 * (distinct + 1)))
    log_count = np.log10(np.append(n, 0) + 0.5)
    end_count, log_none = float(np.log10(n_docs + 0.5)), float(np.log10(0.5))
    known = spark.sparkContext.broadcast((hashes, unit_of, log_count, log_share))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unit_of, log_count, log_share = known.value
        lookup, last = Lookup(hashes, s.endings), len(hashes)
        number = itertools.count(TaskContext.get().partitionId() << 36)
        def summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[ends] - total[np.concatenate([[0], ends[:-1]])]

        for batch in batches:
            start = 0
            for words in _chunks(batch.column(1)):
                c = lookup(words)
                sizes = np.array([len(x) for x in words], np.int64)
                ends = np.cumsum(sizes)
                place, of = lookup.place[c], lookup.ending[c]
                logs, unit = log_count[place], unit_of[place]
                in_class, is_rare = unit == 0, place == last
                # Each document's units, and the end behind them.
                own = np.full(len(c) + len(words), END, np.int32)
                own[np.arange(len(c)) + np.repeat(np.arange(len(words)), sizes)] = np.where(in_class, 1 + of, unit)
                n_rare = summed(is_rare.astype(np.int64), ends)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], x]), pa.int32()), pa.array(v)) for x, v in ((ends + 1 + np.arange(len(words)), own), (np.cumsum(n_rare), lookup.hash[c[is_rare]]))]
                part = batch.slice(start, len(words))
                start += len(words)
                keys = list(itertools.islice(number, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(keys, pa.int64()), pa.array(sizes + 1), pa.array(sizes - n_rare + (n_docs > 0)), pa.array(summed(logs, ends) + end_count), pa.array(summed(np.where(in_class, logs - log_share[of], 0.0), ends)), *lists],
                    ["id", "held_out", "key", "row", "n_tokens", "n_known", "base", "others", "own", "rare"],
                )

    slim.mapInArrow(encoded, f"id {slim.schema[0].dataType.simpleString()}, held_out boolean, key long, row long, n_tokens long, n_known long, base double, others double, own array<int>, rare array<long>").write.option("compression", "zstd").parquet(f"{folder}/encoded")
    done = spark.read.parquet(f"{folder}/encoded")
    learner = Learner(unigram, s)
    learned, early = done.where("NOT held_out"), F.pmod(F.xxhash64("key"), F.lit(100)) < s.first_share
    learn_from_all([learned.where(early), learned.where(~early)], learner)
    model = spark.sparkContext.broadcast(learner.params)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[folder] = Scorer(model.value, s.contexts)
        scorer = _SCORERS[folder]
        for batch in batches:
            column, sums = batch.column(0), [np.zeros(0)]
            for start, stop, units in _pieces(column, 100_000):
                starts = column.offsets.to_numpy()[start:stop]
                sums.append(np.add.reduceat(scorer.log_probabilities(units), starts - starts[0], dtype=np.float64) / np.log(10))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sums)), *batch.columns[1:]], ["model", *names])

    kept = done.select("own", "id", "held_out", "row", "n_tokens", "n_known", "base", "others")
    names = kept.columns[1:]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema[1:])
    modelled = kept.mapInArrow(scored, f"model double, {kinds}").withColumn("model", F.col("model") + F.col("others"))
    # Words that are no training words keep the logarithm of 0.5 that ``encoded`` gave them.
    more = (
        done.select("row", F.explode("rare").alias("h"))
        .join(counts.where(size < least), "h")
        .groupBy("row")
        .agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 0.5) - log_none).alias("gain"))
    )
    gain = F.coalesce("gain", F.lit(0.0))
    return modelled.join(more, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * log_total).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    ), learner
