"""Main text of web pages by points over the tree of their elements.

A page is read tag by tag into a tree. Each paragraph passes points for its length and commas to its
nearest ancestors, the farther the fewer; what an element has gathered is discounted by the share of
its characters that stand in links. The best element and those siblings that belong to it are kept,
without the parts that are no article by their tag, role or name.

Pages are independent, so Spark maps over them and nothing is shuffled. Work on a page is linear in
its length: points climb a fixed number of levels and no step recurses into the tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import mapped

# Elements and attribute words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre li dd dt td th blockquote figcaption summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
GONE = frozenset(
    "head nav header footer aside form script style textarea title xmp iframe noembed noframes noscript template button select option input "
    "label fieldset legend datalist object embed applet svg math canvas audio video map menu dialog search".split()
)
GONE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status form".split())
GONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar skip "
    "header masthead footer sidebar sidebars aside widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay paywall "
    "newsletter subscribe subscription signup login search share sharing social related recommended copyright "
    "print hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies discussion".split())
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "thead": frozenset({"tr", "td", "th"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"tbody", "tr", "td", "th"}),
}
HOLDERS = frozenset("ul ol dl table td th div section article body main".split())

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMAS = re.compile("[,،、，]")

#: Levels that points climb; elements opened deeper than DEEPEST stand beside each other.
LEVELS, DEEPEST = 5, 512
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0


class Page:
    """Elements of one page as parallel lists, parents first, and its texts in page order.

    ``parts`` holds (element, text), and (element, None) where a block begins or ends.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attrs, self.depth = ["html"], [-1], [""], [0]
        self.parts: list[tuple[int, str | None]] = []
        self._read(source)

    def _open(self, at: int, tag: str, attrs: str) -> int:
        self.tag.append(tag)
        self.parent.append(at)
        self.attrs.append(attrs)
        self.depth.append(self.depth[at] + 1)
        return len(self.tag) - 1

    def _up(self, at: int, wanted: frozenset[str], stops: frozenset[str]) -> int:
        """The nearest open element of ``wanted``, or -1 if one of ``stops`` comes first."""
        while at > 0:
            if self.tag[at] in wanted:
                return at
            if self.tag[at] in stops:
                return -1
            at = self.parent[at]
        return -1

    def _read(self, source: str) -> None:
        at = seen = 0
        raw_end = {}
        m = TAG.search(source)
        while m:
            if m.start() > seen:
                self.parts.append((at, html.unescape(source[seen : m.start()])))
            seen = m.end()
            tag = (m[2] or "").lower()
            if tag and m[1]:
                found = self._up(at, frozenset({tag}), BLOCK if tag not in BLOCK else frozenset())
                if found > 0:
                    at = self.parent[found]
                if tag in BLOCK:
                    self.parts.append((at, None))
            elif tag and tag not in ("html", "body"):
                if tag in BLOCK:
                    found = self._up(at, frozenset({"p"}), HOLDERS) if tag != "br" else -1
                    at = self.parent[found] if found > 0 else at
                    if tag in CLOSES:
                        while (found := self._up(at, CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "select"}))) > 0:
                            at = self.parent[found]
                    self.parts.append((at, None))
                node = self._open(at, tag, m[3])
                if tag in RAW:
                    end = raw_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)).search(source, seen)
                    seen = end.end() if end else len(source)
                elif tag not in VOID and self.depth[node] < DEEPEST:
                    at = node
            m = TAG.search(source, seen)
        if seen < len(source):
            self.parts.append((at, html.unescape(source[seen:])))

    def gone(self) -> list[bool]:
        """Whether an element, by itself or by what it stands in, is no part of an article."""
        n = len(self.tag)
        body_like = [t in ("article", "main") for t in self.tag]
        for k in range(n - 1, 0, -1):
            body_like[self.parent[k]] |= body_like[k]
        out, in_article, in_header = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            p, t = self.parent[k], self.tag[k]
            in_article[k] = in_article[p] or t in ("article", "main")
            in_header[k] = in_header[p] or (t == "header" and in_article[k])
            gone = t in GONE and not (t == "header" and in_article[k]) and not (t == "form" and body_like[k])
            if not gone and in_header[k] and t != "header":
                gone = t in BLOCK and t not in HEADING and t not in ("div", "hgroup")
            if not gone and self.attrs[k]:
                gone = self._named_away(t, self.attrs[k], body_like[k])
            out[k] = out[p] or gone
        return out

    @staticmethod
    def _named_away(tag: str, attrs: str, holds_article: bool) -> bool:
        names: list[str] = []
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), html.unescape(a or b or c).lower()
            if name in ("class", "id"):
                names += value.split()
            elif name == "role" and value in GONE_ROLES and not holds_article:
                return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN.search(value)):
                return True
        for name in names:
            words = WORDS.findall(name)
            if not words or words[0] in ("has", "with", "no", "without"):
                continue
            if not COMMENT_WORDS.isdisjoint(words):
                return True
            if not holds_article and not GONE_WORDS.isdisjoint(words):
                return True
        return False


def _blocks(page: Page, keep: list[bool]) -> Iterator[tuple[int, str, int]]:
    """(element, text, characters in links) of the runs of text between block borders, within kept elements."""
    linked = [False] * len(page.tag)
    for k in range(1, len(linked)):
        linked[k] = linked[page.parent[k]] or page.tag[k] == "a"
    pieces: list[str] = []
    at, links = 0, 0
    for node, text in [*page.parts, (0, None)]:
        if text is None:
            if pieces:
                whole = " ".join("".join(pieces).split())
                if whole:
                    yield at, whole, min(links, len(whole))
            pieces, links = [], 0
        elif keep[node]:
            if not pieces:
                at = node
            pieces.append(text)
            if linked[node]:
                links += len(text.strip())
        elif pieces and page.tag[node] in BLOCK:
            pieces.append(" ")


def main_text(source: str) -> str:
    """The article of one page: its blocks, each with single spaces, joined by one space."""
    page = Page(source)
    n = len(page.tag)
    keep = [not g for g in page.gone()]
    points, chars, links, anchors = [0.0] * n, [0] * n, [0] * n, [0] * n
    blocks = list(_blocks(page, keep))
    holder = []
    for at, text, linked in blocks:
        while at > 0 and page.tag[at] not in BLOCK:
            at = page.parent[at]
        holder.append(at)
        chars[at] += len(text)
        links[at] += linked
        anchors[at] += linked > 0
        if page.tag[at] in HEADING or linked * 2 > len(text):
            continue
        worth = min(len(text), 25) / 25 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)
        up = page.parent[at] if page.tag[at] in PARAGRAPH else at
        for level in range(LEVELS):
            if up < 0:
                break
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = page.parent[up]
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        anchors[p] += anchors[k]
    if not chars[0]:
        return ""

    def score(k: int) -> float:
        return points[k] * (1 - links[k] / chars[k]) if chars[k] else 0.0

    best = max(range(n), key=score)  # the first of equals: the outer one
    up = best
    while up > 0 and page.tag[up] not in ("article", "main"):
        up = page.parent[up]
    if up > 0:  # all of the article that the best element stands in
        best = up
    chosen = [False] * n
    chosen[best] = True
    if best > 0:
        least = max(SIBLING_LEAST, SIBLING_SHARE * score(best))
        after = False
        for k in [k for k in range(n - 1, 0, -1) if page.parent[k] == page.parent[best] and keep[k]]:
            if k == best:
                after = True
                continue
            share = links[k] / chars[k] if chars[k] else 1.0
            text_like = page.tag[k] == "p" and (chars[k] > 80 and share < 0.25)
            heads = page.tag[k] in HEADING and after
            chosen[k] = score(k) >= least or text_like or heads
            after = chosen[k]
    for k in range(1, n):
        menu = page.tag[k] in ("ul", "ol", "div", "table") and anchors[k] >= 3 and links[k] > 0.8 * chars[k]
        chosen[k] = (chosen[k] or chosen[page.parent[k]]) and keep[k] and not menu
    return " ".join(text for (_, text, _), at in zip(blocks, holder) if chosen[at])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, text) for each row of ``pages``: the row as it is, in a struct, and the main text of its page.

    A null or empty page and one without an article have the empty text; equal pages have equal
    texts; pages are read whole, unclosed and wrongly nested tags included. Other columns stay in
    ``row``, whatever their names.
    """
    rows = pages.select(F.struct("*").alias("row"), F.col(html_col).cast("string").alias("html"))
    schema = StructType([rows.schema["row"], StructField("text", StringType(), False)])
    return mapped(rows, _extract, schema)
