"""Operators on rows that a bound or a shared key would lose."""

from __future__ import annotations

import pytest

pytest.importorskip("stepwell.llm")

from stepwell.llm import html_text, lm_score, near_duplicates


def test_keep_one_keeps_unlinked_texts_of_null_and_repeated_ids(spark):
    texts = {k: " ".join(f"word{k}x{i}" for i in range(30)) for k in "abcdefgh"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (None, None), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (8, texts["d"]), (9, texts["e"]), (None, texts["e"]), (10, texts["f"] + " more"), (11, texts["f"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, near_duplicates.keep_one(docs).collect()), key=repr)
    want = [(None, texts["a"]), (None, texts["b"]), (None, None), (7, texts["c"]), (7, texts["d"]), (9, texts["e"]), (10, texts["f"] + " more")]
    assert got == sorted(want, key=repr)


def test_lm_score_with_very_many_null_texts(spark):
    """Null texts, which come first, do not push other texts out of what the model learns from."""
    texts = [(k, "red blue " * 20 if k % 2 else "one two three " * 15) for k in range(300)]
    settings = lm_score.Settings(batch=64)

    def scores(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        return {r.doc_id: r.score for r in lm_score.score(docs, settings).collect() if r.doc_id in (1, 2)}

    nulls = [(10_000 + k, None) for k in range(3000)]
    first, last = scores(nulls + texts), scores(texts + nulls)
    assert first == pytest.approx(last, rel=0.05)
    assert first[1] > -15 and first[2] > -15


def test_lm_score_learns_from_all_training_documents(spark):
    """Contexts are learned from all documents, in whatever task they are."""
    docs = spark.createDataFrame([(k, "red blue " * 20 if k % 2 else "one two three " * 15) for k in range(600)], "doc_id long, text string").repartition(3)
    scores = [r.score for r in lm_score.score(docs, lm_score.Settings(batch=64)).collect()]
    assert len(scores) == 600 and max(scores) < 0 and sum(scores) / len(scores) > -10


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout has-sidebar'><article><p>A text.</article></div>", "A text."),
        ("<article class='post no-comments'><p>A text.</article>", "A text."),
        ("<main id='page-with-sidebar'><p>A text.</main>", "A text."),
        ("<article><h2 id='share-prices'>One</h2><h2 id=related>Two</h2><section id='related-work'><p>Three</section><p class='alert-text'>Four</article>", "One Two Three Four"),
        ("<article><p class=ad>Buy<br>it<p>One<ul><li class=ad>Buy<ul><li>Buy</ul><li>Two</ul><p>Three<p class=ad>Buy</article>", "One Two Three"),
        ("<div class=sidebar><article>A text.</article></div>", "A text."),
        ("<article>A text.<div class='comments'><article>Nice</article></div><div class='cookie-banner site-footer'>No</div></article>", "A text."),
    ],
)
def test_main_text_with_class_words_in_part(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<ul><li>Home<li>Log in</ul><div><h1>Title</h1><p>{long}<p>{long}<p>The end</div><footer>No</footer><div>2020</div>", "Title {long} {long} The end"),
        ("<div><p>A short article is one, too.</div>", "A short article is one, too."),
        ("<div><p>Two words</div>", "Two words"),
    ],
)
def test_main_text_without_article_keeps_short_lines(page, text):
    long = "Many words are in this long line of text, which goes on for a while so that it is a surge."
    assert html_text.main_text(page.replace("{long}", long)) == text.replace("{long}", long)
