"""Main text of a page by line-block distribution.

Markup is stripped to lines, one for each block element, and each line gets a weight: its text length, but 0 inside an
element that is no running text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments by
readers) and for a line that is mostly links, and a share of it outside the article on a page that names one. Weights
are summed over a sliding window of lines. A surge is where the sum rises above a threshold, a dive where it falls to 0;
the text lies between a surge and the next dive. As a window reaches over the edges of the text, short lines at either
end of such a stretch go; as it is blunt to what is short, the element that holds the edge is then completed: lines next
to it in the same element, and all lines of an article that the stretch touches. An article without a surge (a teaser)
is no text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: HTML element names and words of class, id and role attributes.
BLOCK = frozenset("address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav header footer aside form button select option dialog menu noscript template iframe object svg canvas math audio video map head".split())
APART_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe signup sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist respond reply replies disqus footer share sharing social related recommended toolbar skip complementary contentinfo search".split())
APART_WORDS_OUTSIDE = frozenset("header masthead topbar login".split())
#: A class is one of these words, or joins only these and the following with hyphens or underscores.
AROUND_WORDS = frozenset("site page main global primary secondary top bottom left right sticky fixed mobile desktop container wrapper wrap area list box bar block item items inner outer link links button buttons form slot unit group section posts articles stories".split())
READERS_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
ARTICLE = frozenset(["article", "main"])
#: Elements whose blocks belong together; a line in one directly has it as its own.
HOLDERS = frozenset("article aside blockquote center dd details dialog div dl fieldset figure footer form header hgroup li main menu nav ol section table td th ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_PARAGRAPH = frozenset("br canvas noscript optgroup option select video".split())
LISTS = frozenset("ul ol dl menu".split())
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp)(?=[\s/>])[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\s_-]+")


@dataclass(frozen=True)
class Blocks:
    window: int = 3
    #: Characters that a window must hold to be a surge; where no window holds twice as many, half of what the fullest
    #: one does.
    surge: int = 86
    #: A line with this share of its characters in links has no weight, but in a named article.
    link_share: float = 0.6
    #: What a line outside the articles weighs on a page that names one, as a share of its length.
    outside: float = 0.1
    #: Lines of fewer words at either end of a stretch go, if it has longer ones; outside the articles of a page that names
    #: one, words count by the share above and such lines go within a stretch, too.
    edge_words: int = 3


def _words(attrs: str, heading: bool) -> set[str]:
    """The words of those classes, ids and roles that name an element apart; an id of a heading is its anchor."""
    out: set[str] = set()
    for m in _ATTRIBUTE.finditer(attrs):
        if heading and m[1].lower() == "id":
            continue
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_WORD.findall(name))
            if words <= APART_WORDS | APART_WORDS_OUTSIDE | AROUND_WORDS:
                out |= words
    return out


Line = tuple[str, int, bool, int, int]


def lines(page: str) -> list[Line]:
    """Each line's text, characters in links, whether it is in an element that is no running text, the outermost article
    that it is in (0: none), and the element that holds its block. If all articles are in elements that only their
    classes set apart (but not as readers' comments), those elements are not apart."""
    around: set[int] = set()
    out = _lines(page, frozenset(), around)
    return _lines(page, around, set()) if around and not any(inside and not apart for _, _, apart, inside, _ in out) else out


def _lines(page: str, together: Set[int], around: set[int]) -> list[Line]:
    """``lines``; elements that begin at ``together`` are not set apart by their classes. ``around`` gets the places of
    those that are and hold an article."""
    out: list[Line] = []
    held: list[str] = []
    linked = 0
    apart, apart_depth = "", 0  # the outermost element that is no running text, and how deep its own name is nested
    by_class, nested = -1, 0  # where that began if only its classes set it apart; lists open in it
    article = links = 0
    region = 0  # where the outermost open article begins
    holders = [("", 0)]  # names and places of the open elements that hold blocks

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, linked, bool(apart), region if article else 0, holders[-1][1]))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        held.append(text)
        if links:
            linked += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() != "title":
                continue
            if m["raw"]:
                flush()
            continue
        name = name.lower()
        end = bool(m["end"])
        if name in BLOCK or name in APART:
            flush()
        if name in HOLDERS:
            if not end:
                holders.append((name, at))
            elif any(name == x for x, _ in holders):
                while holders.pop()[0] != name:
                    pass
        if name == "a":
            links = max(0, links - 1) if end else links + 1
        if apart and (
            apart == "p" and name in BLOCK - IN_PARAGRAPH and (name != "p" or not end)
            or apart in HEADINGS and name in HEADINGS
            or apart in ITEMS and not nested and (name in ITEMS[apart] or end and name in LISTS)
        ):
            flush()
            apart, apart_depth = "", 0
            if end and name not in ARTICLE:
                continue
        if apart:
            if name in LISTS:
                nested = max(0, nested - 1) if end else nested + 1
            if name in ARTICLE and not end and by_class >= 0:
                around.add(by_class)
            if name == apart and not (name in ITEMS and nested):
                apart_depth += -1 if end else 1
                if not apart_depth:
                    flush()
                    apart = ""
            elif end and name in ("body", "html") or end and name in ARTICLE and article and apart not in ARTICLE:
                flush()
                apart, apart_depth = "", 0
                article -= name in ARTICLE
            continue
        if name in ARTICLE:
            if end:
                article = max(0, article - 1)
                continue
        elif end:
            continue
        if name in VOID:
            continue
        words = _words(m["attrs"], name in HEADINGS) if m["attrs"] and "=" in m["attrs"] else set()
        if name in APART or (name not in ("html", "body") and name not in ARTICLE and m.start() not in together and (words & APART_WORDS or not article and words & APART_WORDS_OUTSIDE)):
            flush()
            apart, apart_depth, nested = name, 1, 0
            by_class = -1 if name in APART or words & READERS_WORDS else m.start()
        elif name in ARTICLE:
            article += 1
            if article == 1:
                region = m.end()
    if at < len(page):
        add(page[at:])
    flush()
    return out


def main_text(page: str | None, blocks: Blocks = Blocks()) -> str:
    """The text of the page's main lines, joined by one space; "" for null, for no text and for no surge."""
    rows = lines(page or "")
    named = any(region and not apart for _, _, apart, region, _ in rows)
    # What a line counts: all of it, or outside a named article a share.
    share = [1.0 if region or not named else blocks.outside for _, _, _, region, _ in rows]
    weights = [0.0 if apart or not (named and region) and linked > blocks.link_share * len(text) else len(text) * part for (text, linked, apart, region, _), part in zip(rows, share, strict=True)]
    long = [len(text.split()) * part >= blocks.edge_words for (text, *_), part in zip(rows, share, strict=True)]
    sums = [sum(weights[i : i + blocks.window]) for i in range(len(rows))]
    threshold = min(blocks.surge, max(sums, default=0) / 2)
    kept: set[int] = set()
    start = None
    for i, total in enumerate([*sums, 0.0]):
        if start is None and total > threshold and weights[i]:
            start = i
        elif start is not None and not total:
            kept.update(_completed(range(start, i), rows, weights, long))
            start = None
    regions = {rows[i][3] for i in kept} - {0}
    return " ".join(text for i, (text, _, _, region, _) in enumerate(rows) if weights[i] and (region in regions or i in kept and (long[i] or not named)))


def _completed(stretch: range, rows: list[Line], weights: list[float], long: list[bool]) -> range:
    """From the first to the last long line of a stretch (all of it, if there is none), and on to the lines of weight next
    to those in the same element."""
    found = [i for i in stretch if weights[i] and long[i]] or [i for i in stretch if weights[i]]
    first, last = found[0], found[-1]
    while first and weights[first - 1] and rows[first - 1][4] == rows[first][4]:
        first -= 1
    while last + 1 < len(rows) and weights[last + 1] and rows[last + 1][4] == rows[last][4]:
        last += 1
    return range(first, last + 1)


def extract(pages: DataFrame, blocks: Blocks = Blocks(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) of every row of ``pages``, from the whole page.

    One row out for each row in, repeated rows included; null html and pages without text give "" and 0, a null id or
    url stays null, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), blocks) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    slim = pages.select(pages[id_col], pages[url_col], pages[html_col].cast("string"))
    kinds = [f.dataType.simpleString() for f in slim.schema]
    return slim.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
