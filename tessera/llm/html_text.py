"""HTML extraction: main text by text-to-tag ratio.

A page is read once, as the events of the standard library's streaming parser.  Block-level
tags cut the stream into *lines*; each line keeps its text, how many tags it took, how much
of it is link text, and the container it stands in.  The logarithm of the lines' text-to-tag ratio is
smoothed with a Gaussian window and split by a two-means threshold into content and rest.
The border is never above ``PROSE``, since two-means also splits a page that is all text.

Content lines decide which region of the page is its main text: the ``article`` elements, if they
hold half of the characters of all content lines (the one with most of them, and those beside it
in the same parent), else the ``main`` element under the same condition, else the smallest
container that holds all of the content lines; paragraphs, headings, lists and tables are no
containers.  Inside the region every line counts, however short and however much of it is link
text, unless it stands in a part that is never main text: navigation, the page's header and
footer, sidebar, form, script, style, or an element whose class, id or role says notice, advert,
comment, share bar and the like.  In a region that is no ``article`` or ``main``, lists of links
before the first content line are a menu.

Elements are numbered as they open, so an element is a range of numbers and lines know their
innermost block; all steps are linear in the page, however deep it is nested.

Defined results: null and empty pages give an empty text; character references are decoded;
white space inside a line becomes one space; lines keep page order and are joined by a
newline; pages of any length and depth are read whole; unclosed and misnested tags are
tolerated; repeated rows give equal results; an empty table gives an empty result; null ids and
urls stay null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import _base

# Tag names and words of class and id attributes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TAGS = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input menu nav noscript object script select"
    " style svg template textarea title".split()
)
NEVER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline-share comment"
    " comments commentlist consent cookie cookies disqus dropdown footer footnav gdpr header masthead menu modal nav navbar"
    " navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related respond replies"
    " reply share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toc toolbar topbar widget".split()
)
NEVER_ROLES = frozenset("banner complementary contentinfo dialog alert alertdialog form menu menubar navigation search toolbar".split())
#: Blocks that hold a piece of a text: what holds the text is not one of them, nor inside one.
LEAF_TAGS = frozenset("address blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre summary ul".split())
#: Parts of a table hold no text by themselves, but a cell may be the column of a layout.
TABLE_TAGS = frozenset("caption table tbody tfoot thead tr".split())
#: Characters a tag from which a smoothed line is content whatever the others have.
PROSE = 50.0
# Parts of a class name that make another part of it a matter of layout.
LAYOUT_FIRST = frozenset("has no with without".split())
LAYOUT_LAST = frozenset("columns container grid layout outer wrap wrapper".split())
#: Elements of one kind end each other, unless another block stands between them.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class _Line(NamedTuple):
    text: str
    tags: int
    links: int  # characters of link text
    block: int  # number of the innermost block, 0 outside of all
    article: int  # number of the outermost article, or 0
    main: int
    listed: bool  # in a list


class _Open(NamedTuple):
    tag: str
    number: int
    never: bool
    block: int
    article: int
    main: int
    listed: bool
    links: int  # links that were open when it began


_PAGE = _Open("", 0, False, 0, 0, 0, False, 0)


class _Events(HTMLParser):
    """Turns parser events into lines.  What is never main text leaves none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[_Open] = []
        self.at: dict[str, list[int]] = {}  # places in ``open`` of each tag
        self.blocks: list[int] = []  # places in ``open`` of blocks
        self.parent, self.tag_of, self.last = [0], [""], [0]  # by number: block around it, tag, last number inside
        self.parts: list[str] = []
        self.tags = self.link_chars = self.in_link = 0

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.open[-1] if self.open else _PAGE
            self.lines.append(_Line(text, self.tags, self.link_chars, top.block, top.article, top.main, top.listed))
        self.parts, self.tags, self.link_chars = [], 0, 0

    def drop(self, least: int) -> None:
        """Close what is open from place ``least`` on."""
        while len(self.open) > least:
            gone, place = self.open.pop(), len(self.open)
            self.last[gone.number] = len(self.last) - 1
            if self.at[gone.tag] and self.at[gone.tag][-1] == place:
                self.at[gone.tag].pop()
            if self.blocks and self.blocks[-1] == place:
                self.blocks.pop()
                self.in_link = min(self.in_link, gone.links)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK_TAGS
        if block:
            self.cut()
            for ends in ("p", *SIBLINGS.get(tag, ())):  # the innermost block, with what is open in it
                if self.blocks and self.open[self.blocks[-1]].tag == ends:
                    self.drop(self.blocks[-1])
        elif tag == "br":
            self.parts.append(" ")
        self.tags += not (self.open and self.open[-1].never)
        if tag in VOID_TAGS:
            return
        if tag == "a":
            self.in_link = 1
        top, number = self.open[-1] if self.open else _PAGE, len(self.parent)
        article = top.article or (number if tag == "article" else 0)
        main = top.main or (number if tag == "main" else 0)
        never = top.never or self.vetoed(tag, attrs, bool(article or main))
        self.parent.append(top.block)
        self.tag_of.append(tag)
        self.last.append(number)
        self.at.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        listed = top.listed or tag in ("ul", "ol", "dl", "menu")
        self.open.append(_Open(tag, number, never, number if block else top.block, article, main, listed, self.in_link))

    @staticmethod
    def vetoed(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        """Whether an element is never main text.  ``inside``: it belongs to an article or main
        element, whose header is part of the text."""
        if tag in NEVER_TAGS and not (tag == "header" and inside):
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    return True
            elif name in ("class", "id"):
                for token in value.lower().split():
                    parts = _NAME.findall(token) or [""]
                    found = {token, *parts} & NEVER_WORDS
                    if parts[0] in LAYOUT_FIRST or (parts[-1] in LAYOUT_LAST and parts[0] not in NEVER_WORDS):
                        continue
                    if found and not (inside and found == {"header"}):
                        return True
            elif name == "role" and value.lower() in NEVER_ROLES:
                return True
            elif name == "aria-hidden" and value.lower() == "true":
                return True
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCK_TAGS
        if block:
            self.cut()
        self.tags += not (self.open and self.open[-1].never)
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link = 0
        places = self.at.get(tag)
        if not places:
            return
        if not block and self.blocks and self.blocks[-1] > places[-1]:  # misnested: it ends alone
            places.pop()
            return
        self.drop(places[-1])

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1].never):
            self.parts.append(data)
            if self.in_link:
                self.link_chars += len(data)

    def finish(self) -> list[_Line]:
        self.close()
        self.cut()
        self.drop(0)
        self.last[0] = len(self.last) - 1
        return self.lines


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over neighbouring lines, weights renewed at the edges."""
    radius = max(1, math.ceil(2 * sigma))
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    n, out = len(values), []
    for i in range(n):
        total = mass = 0.0
        for k in range(-radius, radius + 1):
            if 0 <= i + k < n:
                w = weight[abs(k)]
                total += w * values[i + k]
                mass += w
        out.append(total / mass)
    return out


def threshold(values: list[float]) -> float:
    """Border between the two clusters of ``values`` (two-means in one dimension)."""
    lo, hi = min(values), max(values)
    for _ in range(20):
        middle = (lo + hi) / 2
        below, above = [v for v in values if v <= middle], [v for v in values if v > middle]
        if not above or not below:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def main_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    lines = events.finish()
    if not lines:
        return ""
    level = smoothed([math.log1p(max(0, len(x.text) - x.links) / max(1, x.tags)) for x in lines])
    border = min(threshold(level), math.log1p(PROSE))
    content = [x for x, v in zip(lines, level) if v >= border]
    content = content or [max(lines, key=lambda x: len(x.text))]
    articles, mains = Counter(), Counter()
    for x in content:
        articles[x.article] += len(x.text)
        mains[x.main] += len(x.text)
    half = sum(articles.values()) / 2
    del articles[0], mains[0]
    if articles and articles.total() >= half:
        parent = events.parent[articles.most_common(1)[0][0]]  # of equal ones the first
        return "\n".join(x.text for x in lines if x.article and events.parent[x.article] == parent)
    if mains and mains.total() >= half:
        return "\n".join(x.text for x in lines if x.main)
    root, last = min(x.block for x in content), max(x.block for x in content)
    if len(content) == 1:
        root = events.parent[root]  # one paragraph alone: its container is the region
    while events.last[root] < last:
        root = events.parent[root]
    outer, place = root, root
    while place:  # no piece of a text, and nothing inside one, is a container
        if events.tag_of[place] in LEAF_TAGS:
            outer = events.parent[place]
        place = events.parent[place]
    while events.tag_of[outer] in TABLE_TAGS:
        outer = events.parent[outer]
    inside = [x for x in lines if outer <= x.block <= events.last[outer]]
    first = inside.index(content[0])
    return "\n".join(x.text for k, x in enumerate(inside) if k >= first or not (x.listed and x.links >= 0.9 * len(x.text)))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract(_base.documents(spark, sf_dir, "pages"))
