"""The dealt operators against brute force, on small tables with every awkward row."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stepwell.llm import bpe, decontaminate, html_text, language_id, lm_score, near_duplicates, quality, token_counts, token_files, warc
from stepwell.llm.components import components

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string"


def odd_text(rng, n):
    parts = ["the ", "and", " ", "\n", "\t", "é", "ÉTÉ ", "İ", "ΑΣ", "'s", "don't", "12", "³", "<|endoftext|>", "a" * 70, "中文", "😀", "é", " ", "\x1c", "\x85", "``", "thentionble", "!?", "  "]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, odd_text(rng, rng.randrange(0, 120)), rng.choice(["en", "de", None]), "s", 1, "clash", "clash") for i in range(120)]
    out += [(500, None, "en", None, None, None, None), (501, "", None, None, None, None, None), (None, "a text without an id", "en", None, None, None, None), (502, "word " * 9000, "en", "s", 1, "x", "y"), (503, "q" * 4000, "de", "s", 1, "x", "y")]
    return [*out, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_counts(spark, docs, rows):
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 40))
    assert collected(token_counts.token_counts(docs, BYTE, limit=40)) == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0


def test_bpe_round_trip(docs, rows):
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, decoded, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = bpe.encode_decode(docs, BYTE, list(bpe.OUTPUTS))
    assert collected(got) == sorted(want, key=repr)
    assert bpe.decode_ids(got, BYTE, text_col="again").where("again <> decoded").count() == 0
    assert bpe.encode_decode(docs.limit(0), BYTE).count() == 0


def test_rank_array_and_heap_agree():
    model, rng = bpe.load(BYTE), random.Random(1)
    for n in (1, 2, 3, 8, 20, 47):
        raw = bytes(rng.choice(b"aaabcdeth .") for _ in range(n))
        array, left = model._merge_rows([raw], np.array([n]))
        assert array[0, : left[0]].tolist() == model._merge_long(raw)


def test_cache_starts_anew_when_full():
    model = bpe.load(BYTE)
    cache = bpe.WordCache(model, len, most=3)
    for words in (["a", "b"], ["c", "d"], ["a", "thentionble", "e", "f", "g"]):
        cache.learn([words])
        assert [cache[w] for w in words] == [len(x) for x in model.encode_words(words)]


def test_token_files(spark, docs, rows):
    library = Tokenizer.from_file(WORD)
    written = token_files.write(spark, docs, WORD, shards=5)
    assert len(written.shards) > 1
    got = {(r.doc_id, r.start): r for r in token_files.read(spark, written).collect()}
    assert len(got) == len(rows)
    ordered, start = sorted(got, key=lambda k: k[1]), 0
    assert [k[0] for k in ordered] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    texts = {r[0]: r[1] for r in rows}
    for key in ordered:
        ids = [*library.encode(texts[key[0]] or "", add_special_tokens=False).ids, 2]
        r = got[key]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read(spark, token_files.write(spark, docs.limit(0), WORD)).count() == 0


def test_byte_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(values), n) == values).all()
    source = io.BytesIO()
    token_files.write_block(source, [1, None], np.array([2, 1]), np.array([5, 70_000, 300]))
    source.seek(0)
    [(doc_ids, counts, ranks)] = token_files.read_blocks(source)
    assert (doc_ids, counts.tolist(), ranks.tolist()) == ([1, None], [2, 1], [5, 70_000, 300])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">menu</a></nav><!-- ad -->
<div class="ad">buy <div>now</div></div><article><h1>Head &amp; more</h1><p>One <b>bo</b>ld<br>two&nbsp; three<p>Four &lt;five&gt;<form>name</form>
<section class="comments"><article>a reader</article></section></article><footer>&copy; x</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & more One bold two three Four <five>"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<article>That it.</article>") == "That it."
    long = "words of a page that names no article. " * 4
    assert html_text.main_text(f"<div>Home</div><p>{long}<p>{long}<div class=sidebar>{long}</div><p>tail of it all<div><a href=x>a link to go on with</a></div>").split() == (long + long + "tail of it all").split()
    assert html_text.main_text("<div class='ad'>x<article>y</article></div><article>z") == "z"
    assert html_text.main_text("<article>a <!-- open") == "a"
    assert html_text.main_text("<article>1 < 2 & 3 <p title='>'>x") == "1 < 2 & 3 x"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None), (None, "u", "", "x"), (1, "u", PAGE, "clash")], "page_id long, url string, html string, text string")
    text = "Head & more One bold two three Four <five>"
    assert collected(html_text.extract(pages)) == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "u", "", 0)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_warc(spark):
    big, small = "x" * 1500 + "é", "y" * 10
    data = [(1, "http://a/é?q=1", big), (2, "http://b", big), (7, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (None, "u", big), (2, "http://b", big), (7, None, big)]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, payload string")
    archives = warc.write(spark, pages)
    captures = warc.captures(warc.read_records(spark, archives)).cache()
    got = sorted(map(tuple, warc.digests(captures).collect()), key=repr)
    want = []
    for page_id, _, page in data:
        raw = (page or "").encode()
        revisit = len(raw) >= 1000 and page_id != 7
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=repr)
    assert sorted((r.page_id, r.url) for r in captures.where("page_id IS NOT NULL").collect() if r.url) == sorted((p, u) for p, u, _ in data if u and p)
    assert captures.where("request IS NULL OR metadata IS NULL OR response IS NULL").count() == 0
    assert {bytes(r.payload).decode() for r in captures.select("response.payload").where("payload IS NOT NULL").collect()} == {big, small, ""}
    assert warc.write(spark, pages.limit(0)) == []
    assert warc.captures(warc.read_records(spark, [])).count() == 0
    heads = {"http://a.b/x?q=1 2": b"GET /x?q=1%202 HTTP/1.1\r\nHost: a.b\r\n\r\n", "https://u:p@a.b:80": b"GET / HTTP/1.1\r\nHost: a.b:80\r\n\r\n", "u": b"GET /u HTTP/1.1\r\nHost: *\r\n\r\n", None: b"GET / HTTP/1.1\r\nHost: *\r\n\r\n", "http://[x": b"GET /http://%5Bx HTTP/1.1\r\nHost: *\r\n\r\n"}
    assert {u: warc.request_head(u) for u in heads} == heads
    blocks = list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"))))
    assert blocks == [({"warc-type": "x", "content-length": "2"}, b"ab")]


def brute_hits(text, items, window=10):
    words = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c > "\x7f" else " " for c in t or "").split(" ") if w]
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        wanted = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.fixture(params=["10MB", "-1"])
def broadcasting(spark, request):
    """Small tables are broadcast, or none is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_decontamination(spark, broadcasting):
    rng = random.Random(2)
    word = lambda: rng.choice(["The", "of", "ha", "ha", "É", "é", "x1", "tion", "ed"])
    passage = lambda n: " ".join(word() for _ in range(n))
    items = [(1, passage(25)), (2, passage(10)), (10, passage(6)), (3, "solo"), (4, None), (5, "!!"), (6, "ha " * 14)]
    items.append((7, items[0][1]))
    texts = [passage(rng.randrange(0, 60)) for _ in range(20)] + [passage(5) + ", " + items[0][1][k:] + " " + passage(3) for k in range(0, 60, 9)] + [None, "", "ha " * 40, "SOLO!", items[1][1], "ha"]
    texts += [texts[-1]]
    docs = spark.createDataFrame([(i, t, "clash", "clash", 1, 2, 3) for i, t in enumerate(texts)] + [(3, texts[3], "a", "b", 1, 2, 3), (None, items[0][1], "a", "b", 1, 2, 3)], "doc_id long, text string, n_words string, words string, _bad_id int, bad_id int, key int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, *brute_hits(t, items)) for i, t in [*enumerate(texts), (3, texts[3]), (None, items[0][1])]]
    assert collected(decontaminate.contamination(docs, bench)) == sorted(want, key=repr)
    assert collected(decontaminate.without_contaminated(docs, bench).select("doc_id")) == sorted(((w[0],) for w in want if not w[-1]), key=repr)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated OR n_items > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.without_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.without_contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.without_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_of_very_long_texts(spark, broadcasting):
    """200,000 words, a passage at either end and all windows of another item throughout; items of all ten lengths."""
    rng = random.Random(7)
    word = lambda: "w%d" % rng.randrange(50_000)
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 11)] + [(50, " ".join(word() for _ in range(30))), (60, "ha " * 12)]
    middle = [word() for _ in range(200_000)]
    long = " ".join([items[10][1], *middle, items[9][1]])
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, "ha " * 100_000), (3, "nothing of it"), (4, long)], "doc_id long, text string").repartition(2)
    want = sorted((i, *brute_hits(t, items)) for i, t in [(1, long), (2, "ha " * 100_000), (3, "nothing of it"), (4, long)])
    assert collected(decontaminate.contamination(docs, bench)) == want


def test_decontamination_reads_documents_twice_at_most(spark, tmp_path):
    items = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n))) for n in range(1, 13)], "item_id long, text string")
    spark.createDataFrame([(1, "w0 w1 w2 w3")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    plan = decontaminate.matches(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and plan.count("Relation [doc_id") <= 1  # the other read has been written out as hits
    assert decontaminate.contamination(docs, items).first().n_hit == 4


@pytest.mark.parametrize(("block", "block_bytes"), [(4, 8_000_000), (512, 8_000_000), (512, 1500)])
def test_jaccard_join(spark, block, block_bytes):
    rng = random.Random(4)
    settings = near_duplicates.Settings(block=block, block_bytes=block_bytes)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(120)] for _ in range(4)]
    texts = []
    for b in base:
        for _ in range(9):
            t = list(b)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = "edit"
            texts.append(" ".join(t))
    texts += [texts[0]] * 3 + [texts[1].upper() + "!", None, "", "", "one two", "one  two", "one", "?!"]
    docs = spark.createDataFrame([(100 + i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, class_id long").repartition(3)
    sets = [set(near_duplicates.shingles(t, settings).tolist()) for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (texts[i] or "") == (texts[j] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted((100 + i, 100 + root(i), links[i]) for i in range(len(texts)))
    assert sorted(tuple(r) for r in near_duplicates.near_duplicates(docs, settings).drop("text_key").collect()) == want
    kept = sorted(r.doc_id for r in near_duplicates.keep_one(docs.unionAll(docs.limit(5)), settings).collect())
    assert kept == sorted({w[1] for w in want})
    assert near_duplicates.near_duplicates(docs.limit(0), settings).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("_kept_id", "kept_id", "kept_key", "class_key", "text_key", "bytes")})
    assert near_duplicates.keep_one(clash, settings).columns == clash.columns
    assert sorted(r.doc_id for r in near_duplicates.keep_one(clash, settings).collect()) == kept
    assert near_duplicates.keep_one(docs.limit(0), settings).count() == 0


def test_jaccard_recall_near_the_threshold(spark):
    """300 pairs of texts of 40 to 4,000 words with a similarity of 0.80 to 0.85, and as many just below: all of the first
    are linked, none of the others."""
    rng = random.Random(9)
    settings = near_duplicates.Settings()
    rows, want = [], set()
    while len(want) < 300 or len(rows) < 1200:
        n = rng.choice([40, 80, 150, 400, 400, 4000] if len(rows) < 40 else [40, 80, 150, 400])
        a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        b = list(a)
        high = len(want) < 300
        for _ in range(n):
            b[rng.randrange(n)] = "edit%d" % rng.randrange(10**9)
            x, y = (set(near_duplicates.shingles(" ".join(t), settings).tolist()) for t in (a, b))
            j = len(x & y) / len(x | y)
            if j < 0.85:
                break
        if 0.8 <= j < 0.85 if high else 0.7 <= j < 0.8:
            k = len(rows)
            rows += [(k, " ".join(a)), (k + 1, " ".join(b))]
            if high:
                want.add((k, k + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = defaultdict(list)
    for r in near_duplicates.near_duplicates(docs, settings).collect():
        classes[r.class_id].append(r.doc_id)
    assert {tuple(sorted(c)) for c in classes.values() if len(c) > 1} == want


def test_pruning_keeps_what_may_reach_the_threshold():
    settings = near_duplicates.Settings()
    least = near_duplicates.needed_matches(settings)
    n = settings.hashes
    assert 0.5 * n < least[n] < 0.8 * n and all(m < 0.8 * k for k, m in least.items())


def test_components(spark, tmp_path):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    adjacent = defaultdict(set)
    for a, b in edges:
        if a != b:
            adjacent[a].add(b)
            adjacent[b].add(a)
    want, seen = {}, set()
    for n in sorted(adjacent):
        todo = [n] if n not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = n
                todo += adjacent[x]
    got = components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/rounds")
    assert {r.node: r.label for r in got.collect()} == want and got.count() == len(want)


def test_quality(spark, docs, rows):
    words = lambda t: [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in t).split(" ") if w]
    want = []
    for i, text, *_ in rows:
        t = text or ""
        w = words(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = quality.judged(docs)
    assert collected(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
    assert got.where("base_failed AND kept").count() == 0
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_verdict(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    prose = lambda: " ".join(rng.choice(names) if rng.random() < 0.6 else rng.choice("the of and to in that for with".split()) for _ in range(300)) + "."
    junk = " ".join(rng.choice(["x###", "y&&&", "z$$$", "%%%a"]) + str(k) for k in range(300))
    table = " ".join(f"cell{k} |" for k in range(300))
    docs = spark.createDataFrame([(k, prose(), "en") for k in range(30)] + [(100, junk, "en"), (101, table, "en"), (102, "short", "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert kept == set(range(30))
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
    # Distances by hand, and the common words of a language that no list knows.
    known = quality.references(docs, quality.Rules())
    assert known.classes.shape == (1, 11) and known.words.shape == (1, 25)
    texts = {r.doc_id: r for r in quality.judged(docs).collect()}
    for k in (0, 100, 101):
        text = docs.where(f"doc_id = {k}").first().text
        words = [w.lower().encode() for w in text.split(" ")]
        by_word = Counter(int(known.bin_of[quality.xxhash.xxh32_intdigest(w) >> 20]) for w in words)
        for name, mine, ref in (("word", [by_word[b] for b in range(25)], known.words[0]), ("class", quality.class_histogram(text), known.classes[0])):
            p, q = [x / sum(mine) for x in mine], ref.tolist()
            half = sum(x * np.log2(2 * x / (x + y)) for x, y in zip(p, q, strict=True) if x) + sum(y * np.log2(2 * y / (x + y)) for x, y in zip(p, q, strict=True) if y)
            assert texts[k][f"{name}_distance"] == pytest.approx((half / 2) ** 0.5, abs=1e-9)
    assert quality.references(docs.where("doc_id > 100")).classes.shape == (0, 11)  # too few documents for a reference
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100, 0), (101, 0), (None, 0)], "doc_id long, quality int")
    bounds = quality.fitted(docs, labels)
    assert 0.05 < bounds.max_class_distance < 0.5 and 0.05 < bounds.max_word_distance < 0.8
    assert quality.fitted(docs, labels.limit(0)) == quality.Rules()
    assert quality.keep_good(docs.limit(0)).count() == 0
    one = np.array([[4, 0], [0, 4], [0, 0]])
    far = quality.distance(one, np.array([[1.0, 0.0]]))
    assert far[0] == 0 and far[1] == 1 and np.isnan(far[2])


def test_language_id(spark):
    rng = random.Random(3)
    stems = {"en": "the ing tion and th wh of".split(), "de": "sch ung der ein cht und pf".split(), "fr": "eau oi ai les que ment é".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    data = [(k, text(lang, rng.randrange(5, 80)), lang) for k, lang in enumerate(["en", "de", "fr"] * 120)]
    data += [(900, None, "en"), (901, "", "en"), (902, "12 -- 34", "de"), (903, "the and", None), (None, "der ein", "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id long, text string, lang string, score double")
    model = language_id.learn(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(data)
    truth = {r[0]: r[2] for r in data}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert language_id.keep_identified(docs, model, 0.0).where("doc_id IN (900, 901, 902)").count() == 0
    few = language_id.learn(docs.withColumn("lang", F.when(F.col("doc_id") == 7, "dirt").otherwise(F.col("lang"))), language_id.Settings(max_languages=3))
    assert few.languages == ["de", "en", "fr"]
    assert language_id.keep_identified(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, data[0][1] * 3000, "en"), (2, data[1][1] * 3000, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(long, model).collect()} == {1: "en", 2: "de"}
    hot = docs.unionAll(spark.createDataFrame([(None, data[1][1], "en", 0.5)] * 2000, docs.schema))  # one text a thousand times
    assert language_id.identify(long, language_id.learn(hot)).where("doc_id = 2 AND lang_pred = 'de'").count() == 1
    none = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_lm_score(spark, docs, rows):
    """Base columns, and the score by a forward pass over all units, token by token."""
    settings = lm_score.Settings(frequent_words=40, words=6, endings=7, batch=64, contexts=50)
    training = [lm_score.tokens(t) for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    counts = Counter(w for x in training for w in x)
    total, distinct = sum(counts.values()) + len(training), len(counts) + 1
    scored, learner = lm_score.fit(docs, settings)
    got = scored.collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    target, context, places, bias = (x.astype(np.float64) for x in learner.params)
    hashed = sorted(counts, key=lambda w: (-counts[w], lm_score.word_hash(w)))[:6]
    assert learner.unigram[1 + 7 :].tolist() == [counts[w] for w in hashed]
    unit = lambda w: 1 + 7 + hashed.index(w) if w in hashed else 1 + lm_score.ending(w, 7)
    members = defaultdict(list)
    for w in counts:
        if w not in hashed:
            members[unit(w)].append(counts[w])
    for r in got:
        words = lm_score.tokens(texts[r.doc_id])
        c = [*(counts[w] for w in words), len(training)]
        base = sum(log10((x + 0.5) / (total + 0.5 * (distinct + 1))) for x in c)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
        if len(words) < 200:
            u = v = lm_score.END
            want = 0.0
            for w in [*words, None]:
                z = target @ (places[0] * context[u] + places[1] * context[v]) + bias
                k = lm_score.END if w is None else unit(w)
                want += (z[k] - np.log(np.exp(z).sum())) / np.log(10)
                if 0 < k <= 7:
                    want += log10((counts[w] + 0.5) / (sum(members[k]) + 0.5 * (len(members[k]) + 1)))
                u, v = k, u
            assert r.score == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert lm_score.score(docs.limit(0), settings).count() == 0


def test_probabilities_add_up_to_one_and_are_learned():
    rng = np.random.default_rng(0)
    documents = []
    for _ in range(400):
        x = [2]
        while len(x) < 30:
            x.append(2 + (x[-1] - 1) % 3 if rng.random() < 0.9 else int(rng.integers(2, 5)))
        documents.append(np.array([*x, lm_score.END]))
    units = np.concatenate(documents)
    unigram = np.bincount(units, minlength=5).astype(float)
    learner = lm_score.Learner(unigram, lm_score.Settings(batch=256))
    for _ in range(5):
        learner.learn(units, rng)
    scorer = lm_score.Scorer(learner.params, 3)  # fewer places than contexts
    z = np.concatenate([scorer._queries(np.full(5, u), np.full(5, v)) @ scorer.target.T + scorer.bias for u in range(5) for v in range(5)])[::5]
    norms = scorer.normalisers(np.repeat(np.arange(5), 5), np.tile(np.arange(5), 5))
    assert np.exp(z - norms[:, None]).sum(axis=1) == pytest.approx(np.ones(25), abs=1e-4)
    flat = np.log((unigram + 1e-12) / unigram.sum())
    assert scorer.log_probabilities(units).sum() > 0.7 * flat[units].sum()
    again = scorer.log_probabilities(units)
    assert again == pytest.approx(scorer.log_probabilities(units), abs=1e-6)


def test_model_is_better_than_counts_on_held_out_documents(spark):
    """All documents of sf0.01: at least five per cent a token."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.95 * r.b
