"""Quality rules: Jensen-Shannon distance of a document's histograms from language references.

Two histograms are taken of each document: its characters by class, and its words by the common words of the corpus (all
other words are one bin). The references are the same histograms summed over all documents of a language (the ``lang``
column), and the common words are each language's most frequent ones, told apart by a hash of ``Rules.word_bits`` bits, so
both follow the corpus, whatever its languages. A document's distance is that from the nearest reference; documents of
fewer words than a guard are not judged by that histogram, as a few words say little about a distribution.

Beside the distances stand plain counts: words, repeated lines, symbols, and words in repeated three-word windows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files

#: Classes of the characters up to U+00FF; those beyond are one more class.
CLASS_NAMES = ["lower", "upper", "digit", "space", "line", "sentence mark", "other mark", "symbol", "accented", "control", "beyond"]
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


def _classes() -> np.ndarray:
    out = np.full(256, CLASS_NAMES.index("control"))
    for code in range(256):
        c = chr(code)
        if c == "\n":
            name = "line"
        elif c.isspace():
            name = "space"
        elif c in SYMBOLS or c in "@=+~^_\\/`{}[]":
            name = "symbol"
        elif c in ".,;:!?'\"":
            name = "sentence mark"
        elif code < 128 and c.isalpha():
            name = "lower" if c.islower() else "upper"
        elif c.isdigit():
            name = "digit"
        elif c.isalpha():
            name = "accented"
        elif code < 32 or 127 <= code < 160:
            continue
        else:
            name = "other mark"
        out[code] = CLASS_NAMES.index(name)
    return out


_CLASS = _classes()
_ONE_HOT = np.eye(len(CLASS_NAMES), dtype=np.int64)[_CLASS]


@dataclass(frozen=True)
class Rules:
    """Distances are in [0, 1] (logarithms to base 2, square root taken). The bounds of distances are what ``fitted`` gives
    for the labelled documents of the tables at scale factor 0.1."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    class_guard_words: int = 50
    max_class_distance: float = 0.28
    word_guard_words: int = 200
    max_word_distance: float = 0.31
    #: Bits of the hash that tells words apart, and how many of a language's words are common.
    word_bits: int = 12
    common_words: int = 24
    #: A language with fewer documents makes no reference; of more languages the most frequent ones do.
    reference_documents: int = 10
    max_languages: int = 200


class _WordBuckets(dict):
    """The bucket of each word, A to Z lower-cased, made when it is first asked for. Starts anew at 200,000 words."""

    def __init__(self, bits: int) -> None:
        super().__init__()
        self.shift = 32 - bits

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = xxhash.xxh32_intdigest(word.lower()) >> self.shift
        return out


@functools.cache
def _buckets(bits: int) -> _WordBuckets:
    return _WordBuckets(bits)


def word_buckets(words: list[bytes], rules: Rules) -> np.ndarray:
    return np.fromiter(map(_buckets(rules.word_bits).__getitem__, words), np.int64, len(words))


def class_histogram(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("latin-1", "ignore"), np.uint8)
    out = np.bincount(raw, minlength=256) @ _ONE_HOT
    out[-1] = len(text) - len(raw)
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    counts, hit = Counter(windows), bytearray(n + 2)
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def distance(rows: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance of each row from the nearest reference; nan where there is none or a row is empty."""
    out = np.full(len(rows), np.nan)
    total = rows.sum(axis=1, keepdims=True)
    p = rows / np.maximum(total, 1)
    for q in references:
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            d = (np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)) / 2
        out = np.fmin(out, np.sqrt(np.clip(d, 0, 1)))
    out[total[:, 0] == 0] = np.nan
    return out


def _texts(batch: pa.RecordBatch, column: str | int, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with the place of the first; null is the empty text."""
    start, held, size = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


@dataclass(frozen=True)
class References:
    """Shares by class and by common word, a row for each language; ``bin_of`` gives a bucket's bin, 0 for all others."""

    classes: np.ndarray
    words: np.ndarray
    bin_of: np.ndarray


def references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang", folder: str | None = None) -> References:
    """Of all documents of at least ``rules.min_words`` words with a language; the sums are whole numbers, so their order
    does not matter. Each task adds up its own documents first; what reaches the driver is bounded by the buckets and
    ``rules.max_languages``."""
    n_classes, size = len(CLASS_NAMES), 1 << rules.word_bits
    width = n_classes + size + 1  # classes, buckets, documents

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            at = [np.flatnonzero(v) for v in sums.values()]
            langs = pa.array([lang for lang, x in zip(sums, at, strict=True) for _ in range(len(x))], pa.string())
            bins, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, [v[x] for v, x in zip(sums.values(), at, strict=True)]))
            sums.clear()
            return pa.RecordBatch.from_arrays([langs, pa.array(bins, pa.int32()), pa.array(n, pa.int64())], ["lang", "bin", "n"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, texts in _texts(batch, 0):
                for lang, text in zip(langs[start:], texts, strict=False):
                    words = text.encode("utf-8", "surrogatepass").split()
                    if lang is not None and len(words) >= rules.min_words:
                        if lang not in sums:
                            if len(sums) >= 100:
                                yield rows()
                            sums[lang] = np.zeros(width, np.int64)
                        held = sums[lang]
                        held[:n_classes] += class_histogram(text)
                        held[n_classes:-1] += np.bincount(word_buckets(words, rules), minlength=size)
                        held[-1] += 1
        yield rows()

    partial = docs.select(docs[text_col].cast("string"), docs[lang_col].cast("string")).mapInArrow(add_up, "lang string, bin int, n long")
    summed = files.stored(partial.groupBy("lang", "bin").agg(F.sum("n").alias("n")), files.run_folder(docs.sparkSession, "references", folder))
    often = summed.where((F.col("bin") == width - 1) & (F.col("n") >= rules.reference_documents)).orderBy(F.desc("n"), "lang").limit(rules.max_languages)
    langs = sorted(r["lang"] for r in often.collect())
    counts = np.zeros((len(langs), width))
    got = summed.where(F.col("lang").isin(langs)).toArrow()  # ``width`` rows a language
    at = {lang: k for k, lang in enumerate(langs)}
    counts[[at[x] for x in got["lang"].to_pylist()], np.array(got["bin"], np.int64)] = np.array(got["n"], np.int64)
    words = counts[:, n_classes:-1]
    common = np.unique(np.argsort(-words, axis=1, kind="stable")[:, : rules.common_words])
    bin_of = np.zeros(size, np.int64)
    bin_of[common] = 1 + np.arange(len(common))
    by_bin = np.column_stack([words.sum(axis=1) - words[:, common].sum(axis=1), words[:, common]])
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    return References(share(counts[:, :n_classes]), share(by_bin), bin_of)


class Judge:
    def __init__(self, known: References, rules: Rules) -> None:
        self.known, self.rules = known, rules

    def __call__(self, texts: list[str]) -> dict[str, list]:
        r, out, by_class, by_word = self.rules, {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}, [], []
        n_bins = self.known.words.shape[1]
        for text in texts:
            # bytes.split() splits at exactly the six white space characters.
            words = text.encode("utf-8", "surrogatepass").split()
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            repeat = repeated_words(words)
            values = len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(words) < r.min_words or repeat > r.max_repeat_share * len(words)
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
            by_class.append(class_histogram(text))
            by_word.append(np.bincount(self.known.bin_of[word_buckets(words, r)], minlength=n_bins))
        n = np.array(out["n_words"])
        far_class, far_word = distance(np.array(by_class), self.known.classes), distance(np.array(by_word), self.known.words)
        out["class_distance"], out["word_distance"] = far_class.tolist(), far_word.tolist()
        rejected = (n >= r.class_guard_words) & (far_class > r.max_class_distance) | (n >= r.word_guard_words) & (far_word > r.max_word_distance)
        out["kept"] = [not a and not b for a, b in zip(out["base_failed"], rejected.tolist(), strict=True)]
        return out


#: What ``judged`` returns beside the id.
COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "class_distance": "double", "word_distance": "double", "kept": "boolean"}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def judged(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col`` and ``COLUMNS`` of every row of ``docs``.

    Words are runs of characters other than space and U+0009 to U+000D. A null text has no words and fails the base
    rules; a null language is judged like any other and adds to no reference; without any reference no distance
    rejects. Distances are null for an empty text. One row out for each row in, repeated rows included; other columns
    are not read.
    """
    judge = Judge(references(docs, rules, text_col, lang_col), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _texts(batch, 1):
                got = judge(texts)
                arrays = [pa.array([None if v != v else v for v in got[c]] if k == "double" else got[c], _ARROW[k]) for c, k in COLUMNS.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *arrays], [id_col, *COLUMNS])

    slim = docs.select(docs[id_col], docs[text_col].cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, whatever these are called: null and empty texts go,
    of repeated rows all or none stay, a null language or id is no reason to go. An empty table gives no row."""
    judge, at = Judge(references(docs, rules, text_col, lang_col), rules), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _texts(batch, at):
                yield batch.slice(start, len(texts)).filter(pa.array(judge(texts)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Rules:
    """``rules`` with bounds of distances, in hundredths, from ``labels`` (``doc_id``, ``quality`` 0 or 1): halfway between the
    distance that 999 of 1000 good documents stay below and the one that half of the bad documents do, as references
    of another corpus lie elsewhere. A bound without documents of both kinds beyond its guard stays. Null ids and labels
    are left out."""
    told = judged(docs, rules).join(labels.where("quality IN (0, 1)").select("doc_id", "quality"), "doc_id").where("NOT base_failed")
    out = {}
    for kind, guard in (("class", rules.class_guard_words), ("word", rules.word_guard_words)):
        at = F.ceil(F.col(f"{kind}_distance") * 100).cast("int")
        n = np.zeros((2, 102))
        for r in told.where((F.col("n_words") >= guard) & F.col(f"{kind}_distance").isNotNull()).groupBy("quality", at.alias("at")).count().collect():  # 202 rows at most
            n[r["quality"], r["at"]] = r["count"]
        if n.sum(axis=1).all():
            below = n.cumsum(axis=1) / n.sum(axis=1, keepdims=True)
            good, bad = int(np.argmax(below[1] >= 0.999)), int(np.argmax(below[0] >= 0.5))
            out[f"max_{kind}_distance"] = (good + bad) // 2 / 100
    return replace(rules, **out)
