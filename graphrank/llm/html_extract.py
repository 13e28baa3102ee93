"""Main text of HTML pages by a tree-structured graphical model.

A page's block elements form a tree. Each block is content or not; a block depends on its parent through a
potential for its kind (paragraph, list, menu, comment, ...) and the nearest telling ancestor, and what
is seen of it (length of its text, share of link text) depends on the block. Messages go up the tree
and down again (sum-product), which gives each block's exact marginal. Text of blocks that are more likely content
than not is the main text.

Potentials are smoothed counts over labelled pages: the fixed ones of ``labelled_pages`` and, as labelled by their
own markup, a bounded sample of the table whose pages have exactly one article or main element.

Cases: null and empty html have no text; tags that are never closed, end tags that were never opened, broken comments and
attributes are read on as browsers do, more or less; scripts, styles and other raw elements are never text,
nor are drawings, buttons, choices and templates, whose unended ones hide no later block; formulas are text; repeated rows
give equal rows; a table without labelled pages is read with the fixed ones alone.
"""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.llm.common import ship
from graphrank.llm.labelled_pages import PAGES

#: Pages of the table that help to fit, about, drawn by a hash of their html; weight of a fixed page.
FIT_PAGES, FIXED_WEIGHT = 512, 40.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = re.compile(r"<(/?)(script|style|textarea|iframe|noscript|title|svg|math)(?=[\s/>])|<!--|<[!?]", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,99})")
UNENDED = re.compile(r"<[a-zA-Z/][^<>]*\Z")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var ruby rt rp".split())
INLINE |= frozenset("math mi mo mn ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose merror semantics".split())
#: Elements whose text is not read. Without an end tag the first three last to the next block, the others are passed over.
SILENT = frozenset("svg select template object canvas button annotation annotation-xml".split())
LASTING = frozenset("svg select template".split())
_UNENDED_SILENT = frozenset(f"{t}?" for t in LASTING)  # their names among the open elements
_HUSHED = SILENT | _UNENDED_SILENT
NAMES = re.compile(r"(?:\b(?:class|id|role|itemprop)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

#: Kinds by tag, then by words in class, id and role.
TAG_KINDS = {
    "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice",
    "article": "main", "main": "main", "p": "para", "blockquote": "para", "pre": "para", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item",
    "dd": "item", "h1": "title", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head", "table": "table", "tr": "table", "td": "table",
    "th": "table", "tbody": "table", "thead": "table", "figure": "figure", "figcaption": "figure", "html": "body", "body": "body"}
NAME_KINDS = {
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toc tabs topbar skip",
    "header": "header masthead branding logo sitename",
    "footer": "footer copyright colophon legal imprint contentinfo",
    "side": "sidebar side aside widget related recommended recommendations popular trending more complementary archive tags tagcloud author bio",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner teaser affiliate outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall warning toast message",
    "form": "form search login register contact",
    "comment": "comment comments commentlist disqus reply replies discussion respond reviews",
    "share": "share sharing social follow buttons",
    "main": "article main content post entry story text articlebody entrycontent postcontent maincontent body prose"}
_KIND_OF_NAME = {w: kind for kind, words in NAME_KINDS.items() for w in words.split()}
_BREAKS = frozenset(TAG_KINDS) | frozenset("div section center address details summary hgroup search".split())
APART = frozenset("nav header footer side ad notice form comment share".split())
_STRONG = ("comment", "ad", "notice", "nav", "share", "form", "side", "footer", "header", "main")


def kind_of(tag: str, attributes: str) -> str:
    own = TAG_KINDS.get(tag)
    if own in APART or own == "body":
        return own
    if attributes:
        words = set()
        for value in NAMES.findall(attributes):
            value = value.strip("\"'")
            words.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        found = {_KIND_OF_NAME[w] for w in words if w in _KIND_OF_NAME}
        for kind in _STRONG:
            if kind in found and (kind != "main" or own is None):
                return kind
    return own or "div"


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes. Every quote and bracket is looked at once, however broken the page is.

    A search goes from one quote or bracket to the next outside quotes; what it passes without finding an end cannot lead
    to one later either, and is remembered.
    """

    def __init__(self, text: str):
        self.text = text
        self.places = array("q", (m.start() for m in re.finditer("[\"'>]", text)))
        self.quotes = {q: array("q", (i for i in self.places if text[i] == q)) for q in "\"'"}
        self.last = text.rfind(">")
        self.failed: set[int] = set()

    def after(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        passed = []
        while at <= self.last:
            k = bisect_left(self.places, at)
            if k == len(self.places) or self.places[k] in self.failed:
                break
            place = self.places[k]
            sign = self.text[place]
            if sign == ">":
                return place
            passed.append(place)
            same = self.quotes[sign]
            k = bisect_right(same, place)
            if k == len(same):  # a quote that is never closed
                break
            at = same[k] + 1
        self.failed.update(passed)
        return -1


class Tag(NamedTuple):
    start: int
    end: int
    ending: bool
    name: str
    attributes: str

    @property
    def closed(self) -> bool:
        return self.attributes.rstrip().endswith("/")


def tags_of(text: str) -> Iterator[Tag]:
    ends, at = TagEnds(text), 0
    while match := TAG.search(text, at):
        stop = match.end()
        end = ends.after(stop)
        while end < 0:  # a quote that stands in the name may open an attribute
            stop = max(text.rfind('"', match.start(2), stop), text.rfind("'", match.start(2), stop))
            if stop < 0:
                break
            end = ends.after(stop)
        if end < 0:
            at = match.start() + 1
        else:
            at = end + 1
            yield Tag(match.start(), at, bool(match[1]), text[match.start(2) : stop].lower(), text[stop:end])


def without_raw(source: str) -> str:
    """The page without comments and raw elements, which run to their end tag, or without one to the end of the page."""
    out, at, begin, foreign, unended = [], 0, 0, 0, set()
    ends = TagEnds(source)
    while match := RAW.search(source, begin):
        name = (match[2] or "").lower()
        if name:
            end = ends.after(match.end())
            if end < 0:  # no tag
                begin = match.end()
                continue
            end += 1
        else:
            sign = "-->" if match[0] == "<!--" else ">"
            end = source.find(sign, match.end())
            end = len(source) if end < 0 else end + len(sign)
        out.append(source[at : match.start()])
        at = begin = end
        closed = name and source[match.end() : end - 1].rstrip().endswith("/")
        if name in ("svg", "math"):
            foreign = max(0, foreign - 1) if match[1] else foreign + (not closed)
            out.append(source[match.start() : end])
            continue
        out.append(" ")
        if name and not match[1] and not (foreign and closed):
            close = None if name in unended else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at, ends.last + 1)
            if close:
                at = begin = close.end()
            elif foreign:  # a drawing ends before the page does
                unended.add(name)
            else:
                return "".join(out)
    out.append(source[at:])
    return "".join(out)


def ended(tags: list[Tag]) -> set[int]:
    """Starts of the silent elements that have an end tag of their own."""
    found, pending = set(), {}
    for tag in tags:
        if tag.name in SILENT:
            waiting = pending.setdefault(tag.name, [])
            if tag.ending:
                if waiting:
                    found.add(waiting.pop())
            elif not tag.closed:
                if tag.name in ("button", "select"):  # do not nest
                    waiting.clear()
                waiting.append(tag.start)
    return found


class OpenElements:
    """Open elements with their block, and where each name is among them, so nothing is searched from the top."""

    def __init__(self) -> None:
        self.names: list[str] = [""]
        self.nodes: list[int] = [0]
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = [0]  # neither inline elements nor paragraphs

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE and name != "p":
            self.solid.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def cut(self, depth: int) -> list[str]:
        """Close all from ``depth`` on; their names."""
        gone = self.names[depth:]
        for name in gone:
            self.places[name].pop()
        while self.solid[-1] >= depth:
            self.solid.pop()
        del self.names[depth:], self.nodes[depth:]
        return gone

    def nearest(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def outermost(self, names: Iterable[str], below: int = 0) -> int:
        """Depth of the outermost one deeper than ``below``, 0 if there is none."""
        found = []
        for n in names:
            places = self.places.get(n, [])
            k = bisect_right(places, below)
            if k < len(places):
                found.append(places[k])
        return min(found, default=0)


#: Items and cells end where the next one begins: names they end, names that hold them apart.
_ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
         "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}


class Page:
    """Blocks in page order: parent, kind, nearest telling ancestor, text pieces, characters of text and of link text."""

    def __init__(self, source: str, labelled: bool = False):
        self.parent, self.kind, self.within, self.chars, self.linked = [-1], ["body"], ["none"], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self.label: list[int] = [0]
        self.landmarks = self.loose = 0
        text = UNENDED.sub(" ", without_raw(source))
        stack = OpenElements()
        links = hushed = at = 0
        tags = list(tags_of(text))
        whole = ended(tags)

        def cut(depth: int) -> None:
            nonlocal links, hushed
            for name in stack.cut(depth):
                links -= name == "a"
                hushed -= name in _HUSHED

        for tag in tags:
            if tag.start > at and not hushed:
                self._text(text[at : tag.start], stack.nodes[-1], links)
            at, name = tag.end, tag.name
            if hushed and not tag.ending and name in _BREAKS:
                depth = stack.outermost(_UNENDED_SILENT)
                if depth:
                    cut(depth)
            if name == "br" or name == "hr":
                if not hushed:
                    self.pieces.append((stack.nodes[-1], " "))
            elif name in VOID:
                pass
            elif tag.ending:
                depth = stack.nearest((name,))
                if depth:
                    cut(depth)
                if name not in INLINE and not hushed:
                    self.pieces.append((stack.nodes[-1], " "))
            elif name in SILENT:
                self.pieces.append((stack.nodes[-1], " "))
                if not tag.closed and (tag.start in whole or name in LASTING):
                    stack.push(name if tag.start in whole else f"{name}?", stack.nodes[-1])
                    hushed += 1
            elif hushed:
                if not tag.closed:
                    links += name == "a"
                    stack.push(name, stack.nodes[-1])
            elif name in INLINE:
                if name == "a":
                    links += 1
                if not tag.closed:
                    stack.push(name, stack.nodes[-1])
            else:
                # an open paragraph or item ends where the next block begins
                if name in _ENDS:
                    ends, apart = _ENDS[name]
                    inner, until = stack.nearest(ends), stack.nearest(apart)
                    depth = inner if inner > until else stack.outermost(("p",), until)
                else:
                    depth = stack.outermost(("p",), stack.solid[-1])
                if depth:
                    cut(depth)
                self._block(name, tag.attributes, stack, labelled)
        if at < len(text) and not hushed:
            self._text(text[at:], stack.nodes[-1], links)

    def _block(self, tag: str, attributes: str, stack: OpenElements, labelled: bool) -> None:
        above = stack.nodes[-1]
        kind = kind_of(tag, attributes)
        if tag in ("html", "body"):
            return
        self.landmarks += tag in ("article", "main")
        self.pieces.append((above, " "))
        if labelled:
            given = re.search(r"\by=([01])", attributes)
            label = int(given[1]) if given else self.label[above]
        else:  # by its own markup
            label = int((self.label[above] or tag in ("article", "main")) and kind not in APART)
        node = self._add(above, kind, label)
        self.loose = 0
        if not attributes.rstrip().endswith("/"):
            stack.push(tag, node)

    def _add(self, above: int, kind: str, label: int) -> int:
        self.parent.append(above)
        self.kind.append(kind)
        self.within.append("main" if self.kind[above] == "main" else "apart" if self.kind[above] in APART else self.within[above])
        self.chars.append(0)
        self.linked.append(0)
        self.label.append(label)
        return len(self.parent) - 1

    def _text(self, raw: str, node: int, links: int) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append((node, text))
        size = len(text) - text.count(" ") if text else 0
        if node == 0 and text.strip():  # text beside all blocks is a block of its own
            if not self.loose:
                self.loose = self._add(0, "loose", 0)
            self.pieces[-1] = (self.loose, text)
            node = self.loose
        if text.strip():
            self.chars[node] += size
            if links > 0:
                self.linked[node] += size

    def seen(self) -> list[tuple]:
        """What is seen of each block: size class of its own text, and of the share of links in all text below it."""
        whole, linked = self.chars[:], self.linked[:]
        for v in range(len(whole) - 1, 0, -1):
            whole[self.parent[v]] += whole[v]
            linked[self.parent[v]] += linked[v]
        return [(0 if not c else 1 if c < 25 else 2 if c < 80 else 3 if c < 240 else 4, -1 if not w else 0 if l == 0 else 1 if 3 * l < w else 2 if 3 * l < 2 * w else 3)
                for c, w, l in zip(self.chars, whole, linked, strict=True)]


class TreeModel:
    """Potentials as counts: (parent's label, nearest telling ancestor, kind, label) and (label, what is seen)."""

    def __init__(self, links: dict[tuple, float], looks: dict[tuple, float]):
        self.links, self.looks = links, looks
        self._up: dict[tuple, tuple] = {}
        self._seen: dict[tuple, tuple] = {}
        self.sums = [sum(n for (y, _, _), n in looks.items() if y == label) for label in (0, 1)]

    def potential(self, within: str, kind: str) -> tuple:
        """((P(0|0), P(1|0)), (P(0|1), P(1|1))): a kind rarely seen in this place leans on the kind elsewhere, then on its parent."""
        key = (within, kind)
        if key not in self._up:
            rows = []
            for above in (0, 1):
                place = [self.links.get((above, within, kind, y), 0.0) for y in (0, 1)]
                anywhere = [sum(self.links.get((above, w, kind, y), 0.0) for w in ("none", "main", "apart")) for y in (0, 1)]
                keep = (0.15, 0.85) if above else (0.85, 0.15)
                rate = (anywhere[1] + 2 * keep[1]) / (sum(anywhere) + 2)
                one = (place[1] + 2 * rate) / (sum(place) + 2)
                one = min(max(one, 0.005), 0.995)
                rows.append((1 - one, one))
            self._up[key] = tuple(rows)
        return self._up[key]

    def look(self, seen: tuple) -> tuple[float, float]:
        if seen not in self._seen:
            self._seen[seen] = tuple((self.looks.get((y, *seen), 0.0) + 1.0) / (self.sums[y] + 20.0) for y in (0, 1))
        return self._seen[seen]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every block, by messages from the leaves to the root and back."""
        n, parent = len(page.parent), page.parent
        below = [self.look(s) for s in page.seen()]
        link = [self.potential(w, k) for w, k in zip(page.within, page.kind, strict=True)]
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for v in range(n - 1, 0, -1):
            (a, b), ((p00, p01), (p10, p11)) = below[v], link[v]
            up = (p00 * a + p01 * b, p10 * a + p11 * b)
            sent[v] = up
            x, y = below[parent[v]]
            x, y = x * up[0], y * up[1]
            total = x + y
            below[parent[v]] = (x / total, y / total)
        belief: list[tuple[float, float]] = [(0.0, 0.0)] * n
        belief[0] = (below[0][0], 1e-3 * below[0][1])
        total = sum(belief[0])
        belief[0] = (belief[0][0] / total, belief[0][1] / total)
        for v in range(1, n):
            above, (p0, p1) = belief[parent[v]], link[v]
            x, y = above[0] / max(sent[v][0], 1e-300), above[1] / max(sent[v][1], 1e-300)
            zero, one = below[v][0] * (x * p0[0] + y * p1[0]), below[v][1] * (x * p0[1] + y * p1[1])
            belief[v] = (zero / (zero + one), one / (zero + one))
        return [b[1] for b in belief]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        content = [m > 0.5 for m in self.marginals(page)]
        if set(page.kind[1:]) == {"loose"}:  # no markup to tell by
            content = [True] * len(content)
        return " ".join("".join(t if content[v] else " " for v, t in page.pieces).split())


def _counts(page: Page, weight: float, links: Counter, looks: Counter) -> None:
    for v, seen in enumerate(page.seen()):
        if v:
            links[(page.label[page.parent[v]], page.within[v], page.kind[v], page.label[v])] += weight
            looks[(page.label[v], *seen)] += weight


def fit(pages: DataFrame, column: str = "html") -> TreeModel:
    """Counts over the fixed labelled pages and about ``FIT_PAGES`` of the table; a few hundred sums reach the driver."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("html"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("html", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, looks = Counter(), Counter()
        for batch in batches:
            for source in batch["html"]:
                page = Page(source)
                if page.landmarks == 1:
                    _counts(page, 1.0, links, looks)
        keys = [("link", *map(str, k)) for k in links] + [("look", *map(str, k), "") for k in looks]
        if keys:
            yield pd.DataFrame({"key": [list(k) for k in keys], "n": [*links.values(), *looks.values()]})

    found = rows.where(draw < FIT_PAGES / max(1, total)).mapInPandas(count, "key array<string>, n double").groupBy("key").agg(F.sum("n").alias("n")).collect()
    links: Counter = Counter()
    looks: Counter = Counter()
    for row in found:
        what, *key = row["key"]
        if what == "link":
            links[(int(key[0]), key[1], key[2], int(key[3]))] += row["n"]
        else:
            looks[(int(key[0]), int(key[1]), int(key[2]))] += row["n"]
    for source in PAGES:
        _counts(Page(source, labelled=True), FIXED_WEIGHT, links, looks)
    return TreeModel(dict(links), dict(looks))


def extract(pages: DataFrame, model: TreeModel, keep: list[str], column: str = "html") -> DataFrame:
    """Columns ``keep`` with ``text``, one row per row."""
    ship(pages.sparkSession)
    links, looks = model.links, model.looks

    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = TreeModel(links, looks)
        for sources in parts:
            yield pd.Series([known.text(s) for s in sources], dtype=object)

    return pages.select(*keep, main_text(F.col(column).cast("string")).alias("text"))
