"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased texts give their character n-grams of one to three, hashed to a fixed number of buckets. Document
frequencies are taken over all training documents: each task adds up its own and the sums are bounded by the buckets.
The regression is fitted by follow-the-regularised-leader with elastic-net penalties on a bounded, stratified sample of
the labelled training documents (``Settings.sample_per_language``), whole texts and short passages of them alike; a part
of the sample is held back to find the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    orders: int = 3
    #: Bound of the sample that the regression is fitted on, for each language, in expectation; of equal texts it takes one.
    sample_per_language: int = 400
    #: Of more languages the model learns the most frequent ones.
    max_languages: int = 500
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002
    passage_chars: int = 60
    #: Of so many sampled documents one is for calibration.
    calibration_every: int = 5


_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def bucket_counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift, total = np.uint32(32 - settings.bits), np.zeros(1 << settings.bits, np.int64)
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, min(settings.orders, len(codes)) + 1):
        rolled = (rolled[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MULTIPLIERS[n % 5] + np.uint32(n)
        mixed = rolled ^ (rolled >> np.uint32(15))
        total += np.bincount((mixed * _MULTIPLIERS[0]) >> shift, minlength=len(total))
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    settings: Settings

    def features(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.features(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*bucket_counts(text, self.settings)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], calibration: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, settings: Settings) -> Model:
    """Examples are language, buckets, counts."""
    languages = sorted({x[0] for x in examples})
    k, s = len(languages), settings
    index = {lang: i for i, lang in enumerate(languages)}
    model = Model(languages, np.zeros((len(idf), k)), np.zeros(k), idf, 1.0, s)
    # The bias is the last row: a feature that is always 1.
    z, squares = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= s.l1, 0.0, -(zs - np.sign(zs) * s.l1) / ((s.beta + np.sqrt(squares[at])) / s.alpha + s.l2))

    order = np.random.default_rng(0)
    for _ in range(s.epochs):
        for i in order.permutation(len(examples)):
            lang, at, n = examples[i]
            y, at, x = index[lang], np.append(at, len(idf)), np.append(model.features(at, n), 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / s.alpha
            z[at] += g - sigma * w
            squares[at] += g * g
    w = weights(slice(None))
    model.weights, model.bias = w[:-1], w[-1]
    held = [(index[lang], model.logits(at, n)) for lang, at, n in calibration if lang in index]
    if held:
        loss = lambda t: -sum(float(np.log(max(1e-12, softmax(v / t)[y]))) for y, v in held)
        model.temperature = min(np.geomspace(0.05, 5, 40), key=loss)
    return model


def training(id_col: Column | str = "doc_id", part: int = 2, parts: int = 4) -> tuple[Column, Column]:
    """Whether a document is held out (crc32 of its id as text, modulo ``parts``, is ``part``), and the opposite. A null
    id counts as the empty text."""
    text = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    held_out = F.crc32(text.cast("binary")) % parts == part
    return held_out, ~held_out


def learn(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled documents that aren't held out. Without any, it knows no language. Null texts and labels
    teach nothing; equal texts of one language are one example."""
    train = docs.where(training(id_col)[1] & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    per_language = {r["lang"]: r["count"] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.max_languages).collect()}
    size = 1 << settings.bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[bucket_counts(text.as_py(), settings)[0]] += 1
                n += 1
        total[size] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    df = np.zeros(size + 1, np.int64)
    for r in train.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # bounded by the buckets
        df[r.bucket] = r.n
    idf = np.log((1 + df[size]) / (1 + df[:size])) + 1
    if not per_language:
        return Model([], np.zeros((size, 0)), np.zeros(0), idf, 1.0, settings)

    scale = 1_000_000
    share = F.create_map(*(x for lang, n in per_language.items() for x in (F.lit(lang), F.lit(int(min(1.0, settings.sample_per_language / n) * scale)))))
    # By the text alone, so that copies are drawn together and the first of them stands for all.
    drawn = F.pmod(F.xxhash64("text"), F.lit(scale)) < share[F.col("lang")]
    sample = train.where(drawn).groupBy("lang", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).select("lang", "text", F.pmod(F.xxhash64("key"), F.lit(settings.calibration_every)).alias("turn"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("lang", pa.string()), ("turn", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
        for batch in batches:
            rows = []
            for lang, text, turn in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                half, c = len(text) // 2, settings.passage_chars
                for passage in (text, *((text[:c], text[half : half + c]) if len(text) > c else ())):
                    if has_letter(passage):
                        at, n = bucket_counts(passage, settings)
                        rows.append({"lang": lang, "turn": turn, "at": at, "n": n})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    got = sample.mapInArrow(examples, "lang string, turn long, at array<int>, n array<int>").toArrow()
    # Slices of two arrays, as a list of numbers for each example would take the driver many times the memory.
    parts = [got[c].combine_chunks() for c in ("at", "n")]
    ends = [x.offsets.to_numpy() for x in parts]
    flat = [x.values.to_numpy() for x in parts]
    cut = lambda c, i: flat[c][ends[c][i] : ends[c][i + 1]]
    rows = sorted(((turn, lang, cut(0, i), cut(1, i)) for i, (turn, lang) in enumerate(zip(got["turn"].to_pylist(), got["lang"].to_pylist(), strict=True))), key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    fit_on = [r[1:] for r in rows if r[0]] or [r[1:] for r in rows]
    return fit(fit_on, [r[1:] for r in rows if not r[0]], idf, settings)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score`` (its calibrated probability) of every row of ``docs``.

    Only the text makes a prediction. A null text and one without a letter are ``und`` with score 0, as is every text
    if the model knows no language. One row out for each row in, repeated rows included; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    slim = docs.select(docs[id_col], training(docs[id_col])[0].alias("held_out"), docs[text_col].cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``, with all their columns, whatever these are
    called: null texts and those without a letter go, of repeated rows all or none stay. An empty table gives no row; a
    model that knows no language keeps none."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
