"""The pipeline on a small corpus with planted rows."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    stems = {"en": "the ing tion and th wh of".split(), "de": "sch ung der ein cht und pf".split()}
    words = lambda lang, n: [rng.choice(stems[lang][:3]) if rng.random() < 0.4 else "".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    text = lambda ws: "\n".join(" ".join(ws[k : k + 12]) for k in range(0, len(ws), 12))
    docs = [(k, text(words(lang, 150)), lang, "s", 1) for k, lang in enumerate(["en", "de"] * 20)]
    passage = words("en", 25)
    planted = {
        100: docs[4][1],  # an exact copy
        101: docs[6][1].replace("\n", " ", 1) + " more",  # a near copy
        102: text(words("en", 80) + passage + words("en", 80)),  # a benchmark passage
        103: "too short to keep",
        104: " ".join(f"###{k}$$$ &&&{k}%%%" for k in range(90)),  # symbols
        105: None,
        106: " ".join(str(k) for k in range(1000, 1100)),  # no letter
    }
    rows = docs + [(k, t, "en", None, None) for k, t in planted.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (2, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in held.collect()}
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        held = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        gone = before - {r.doc_id for r in held.collect()}
        assert {"quality rules": {103, 104, 105, 106} & gone == gone >= {103, 104, 105}, "language ID": gone <= {106}, "n-gram Jaccard join": gone == {100, 101}, "benchmark decontamination": gone == {102}}[name], (name, gone)

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(40))
    for r in got:
        ids = library.encode(docs[r.doc_id][1], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id][1].encode()).hexdigest())


def test_pipeline_of_clashing_columns_repeated_rows_and_no_rows(spark, tmp_path):
    rng = random.Random(9)
    stems = "the ing tion and th wh of en re".split()
    text = lambda: " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) for _ in range(150))
    rows = [(k, text(), "en", "s", 1, "a", 2.0, [k], "x") for k in range(20)]
    rows += [rows[3], (None, rows[4][1], "en", None, None, None, None, None, None), (30, None, None, None, None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens double, ids array<long>, class_id string"
    spark.createDataFrame([(1, text()), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/some/benchmark.parquet")
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = sorted((r.doc_id for r in got if r.doc_id is not None))
    # The copy without an id and the one with it are one class, of which one row stays.
    assert len(got) == 20 and set(range(20)) - set(ids) <= {4}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {r[0]: r[1] for r in rows if r[1]}
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in got)

    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
