"""Main text of whole tables of pages against a plain extractor, and what the windows decide."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

pytest.importorskip("stepwell.llm")

from stepwell.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Plain(HTMLParser):
    """Blocks of the article, without the elements that are no running text."""

    SKIP = {"nav", "header", "footer", "aside", "form", "button", "script", "style", "noscript", "head"}
    INLINE = {"b", "i", "em", "strong", "a", "span", "code"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.article, self.skipped, self.apart, self.blocks = 0, [], 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.blocks.append("")
        if tag == "article":
            self.article += 1
        elif tag in self.SKIP or self.skipped and tag not in ("br", "p", "img", "meta", "link"):
            self.skipped.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.blocks.append("")
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag == "article":
            self.article -= 1

    def handle_data(self, data):
        if self.article and not self.skipped:
            self.blocks[-1] += data


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    return " ".join(b for b in (" ".join(x.split()) for x in p.blocks) if b)


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(PAGES, columns=["html"])["html"].to_pylist()


def test_every_page_agrees_with_a_plain_extractor(pages):
    assert [html_text.main_text(p) for p in pages] == [plain(p) for p in pages]


def unmarked(page):
    """The page without what names its parts: only the lengths of its lines tell them apart."""
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b", r"<\1div", re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*')", "", page or ""))


def shares(pages, texts, **blocks):
    """Of the words found: how many are of the text; of the text's words: how many are found."""
    found = right = wanted = 0
    for page, text in zip(pages, texts, strict=True):
        got, want = html_text.main_text(unmarked(page), html_text.Blocks(**blocks)).split(), text.split()
        found, wanted = found + len(got), wanted + len(want)
        at = " ".join(got).find(text)
        right += len(want) if text and at >= 0 else len(set(got) & set(want))
    return right / found, right / wanted


def test_windows_decide_where_nothing_is_named(pages):
    """Whole articles come out, with little around them; a window of one line loses half of the articles' edges."""
    texts = [html_text.main_text(p) for p in pages]
    precise, whole = shares(pages, texts)
    assert whole == 1 and precise > 0.9
    everything, _ = shares(pages, texts, surge=0, link_share=2.0, window=100)
    assert everything < precise
    assert html_text.main_text(unmarked(pages[0]), html_text.Blocks(window=0)) == ""


def test_surge_finds_the_article_among_teasers():
    story = "".join(f"<p>Paragraph {k} of the story, which is short.</p>" for k in range(5))
    page = f"<main><h1>Title</h1>{story}<p>End.</p></main><div><article><h3>Teaser</h3></article><article><h3>Another</h3></article></div>"
    text = "Title " + " ".join(f"Paragraph {k} of the story, which is short." for k in range(5)) + " End."
    assert html_text.main_text(page.replace("</main><div>", "</main><nav>1</nav><nav>2</nav><nav>3</nav><div>")) == text
    apart = "".join(f"<div class=ad>{k}</div>" for k in range(4))
    assert html_text.main_text(f"<article>{story}{apart}<p>End.</p></article>") == text.removeprefix("Title ")
    assert html_text.main_text(f"<div>By Somebody</div><article>{story}</article><div>More to read</div>") == text.removeprefix("Title ").removesuffix(" End.")
    # Each of the story's lines is below the surge; only together are they one.
    other = "<article><p>" + "One long line. " * 14 + "</p></article>"
    assert html_text.main_text(f"<article>{story}</article>{other}").startswith("Paragraph 0")
    assert html_text.main_text(f"<article>{story}</article>{other}", html_text.Blocks(window=1)).startswith("One long line")
