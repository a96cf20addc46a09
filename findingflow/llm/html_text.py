"""Main text of web pages by text-to-tag ratios.

Each page is read as a stream of parser events that become lines: the text between two block boundaries, with the
number of tags in it, the share of it inside links and the container it stands in. A line's text-to-tag ratio, weighed
down where names suggest something beside the content, is smoothed with a Gaussian over its neighbours; lines of at
least one standard deviation form the content clusters. The containers that hold the clusters (article and main
elements, else the deepest element with nearly all of them) are the content regions; their lines are the text, less
those weighed down, and outside article and main elements those mostly links, that no cluster holds. Elements that are never prose (scripts, menus, footers,
forms, adverts, notices, reader comments and the like, by tag, role or class) count as lines without text and give none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_batches, values

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small strike strong sub sup time tt u var".split())
REGION = frozenset("article main body div section td".split())
PROSE = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre figcaption td th".split())
NEVER = frozenset("script style noscript template head title nav aside footer form button select textarea iframe object svg canvas dialog menu audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion nav navbar navigation navi menu submenu breadcrumb breadcrumbs"
    " sidebar sidenav aside footer cookie cookies consent gdpr notice notices notification popup modal newsletter comment comments commentlist discussion disqus replies respond paywall".split()
)
DOUBTFUL = frozenset("foot header masthead banner topbar toolbar overlay subscribe subscription signup login share sharing social related recommended recommendations reply widget widgets pagination pager search skip".split())
CONTENT = frozenset("article body content entry main page post story text".split())
DOUBT = 0.25  # what names that suggest something beside the content leave of a ratio
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CLOSED_BY_OWN_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
WORDS = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
HOLDS_MOST = 0.9
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
KERNEL /= KERNEL.sum()


def name_weight(value: str, prose: bool) -> float:
    """What a class or id says: 0 out, DOUBT doubtful, 1 nothing. Each whole name counts once; names of content make up for others.

    A paragraph, heading or item (``prose``) is out only by a name that says nothing else: ``notice``, but not ``notice-period``.
    """
    said = 0
    worst = 1.0
    for name in value.lower().split():
        words = set(WORDS.findall(name))
        if words & CONTENT:
            said += 1
        elif words & OUT and not (prose and name not in OUT):
            said -= 1
            worst = 0.0
        elif words & DOUBTFUL and not (prose and name not in DOUBTFUL):
            said -= 1
            worst = min(worst, DOUBT)
    return worst if said < 0 else 1.0


def tag_weight(tag: str, attrs: list, in_article: bool) -> float:
    """The weight of an element's lines, by its tag, role and names."""
    if tag in NEVER or (tag == "header" and not in_article):
        return 0.0
    if tag in ("html", "body", "article", "main"):
        return 1.0
    weight = 1.0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value and value.lower() in ROLES):
            return 0.0
        if name in ("class", "id") and value:
            weight = min(weight, name_weight(value, tag in PROSE))
    return weight


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    within: int  # innermost container, -1: none
    weight: float


class Lines(HTMLParser):
    """Turns events into ``lines``, and containers into ``kinds`` (their tags) and ``parents``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, float, int]] = []  # tag, weight, container
        self.held: Counter[str] = Counter()  # open elements by tag
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags, self.linked, self.in_link = 0, 0, 0
        self.weight, self.within = 1.0, -1

    def end_line(self) -> None:
        if self.parts or self.tags:
            self.lines.append(Line("".join(self.parts), self.tags, self.linked, self.within, self.weight))
            self.parts, self.tags, self.linked = [], 0, 0

    def pop_to(self, at: int) -> None:
        self.end_line()
        self.held.subtract(tag for tag, _, _ in self.stack[at:])
        del self.stack[at:]
        self.weight, self.within = self.stack[-1][1:] if self.stack else (1.0, -1)

    def open_at(self, tag: str, stops: tuple = ()) -> int:
        """Where the innermost open element of this tag stands, no further out than any of ``stops``; else -1."""
        if not self.held[tag]:
            return -1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                return at
            if self.stack[at][0] in stops:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.held["head"] and tag not in IN_HEAD and tag != "head":
            self.pop_to(self.open_at("head"))
        if tag in INLINE:
            self.tags += 1
            self.in_link += tag == "a"
            return
        if tag in VOID:
            self.tags += 1
            self.parts.append(" ")
            return
        if tag != "span":
            self.end_line()
            if self.stack and self.stack[-1][0] == "p":
                self.pop_to(len(self.stack) - 1)
            if tag in CLOSED_BY_OWN_KIND and (at := self.open_at(tag, CLOSED_BY_OWN_KIND[tag])) >= 0:
                self.pop_to(at)
        weight = min(self.weight, tag_weight(tag, attrs, self.held["article"] + self.held["main"] > 0))
        self.held[tag] += 1
        if tag == "span" and weight == self.weight:
            self.tags += 1
            self.stack.append((tag, weight, self.within))
            return
        self.end_line()
        self.tags += 1
        if tag in REGION:
            self.parents.append(self.within)
            self.within = len(self.kinds)
            self.kinds.append(tag)
        self.weight = weight
        self.stack.append((tag, weight, self.within))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.tags += 1
            self.in_link -= tag == "a" and self.in_link > 0
            return
        if tag in VOID:
            return
        if (at := self.open_at(tag)) >= 0:
            if tag == "span" and at == len(self.stack) - 1 and self.weight == (self.stack[at - 1][1] if at else 1.0):
                self.tags += 1
                self.stack.pop()
                self.held[tag] -= 1
                return
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data)


def smoothed_ratios(lines: list[Line]) -> np.ndarray:
    """Weighed text-to-tag ratio of each line, smoothed over two neighbours on each side."""
    ratios = np.array([x.weight * len(x.text) / max(1, x.tags) for x in lines])
    if len(ratios) == 1:
        return ratios
    weight = np.convolve(np.ones(len(ratios)), KERNEL, "same")[: len(ratios)] if len(ratios) >= 5 else None
    if weight is None:
        reach = np.abs(np.subtract.outer(np.arange(len(ratios)), np.arange(len(ratios))))
        k = np.where(reach <= 2, np.exp(-0.5 * reach**2), 0)
        return k @ ratios / k.sum(1)
    return np.convolve(ratios, KERNEL, "same") / weight


def content_regions(parser: Lines, own: np.ndarray, prose: np.ndarray) -> set[int]:
    """Containers that hold the content, given the characters of content lines, links aside, that stand in each: whole article and main elements, else the deepest element with nearly all; -1 is the page.

    Article and main elements decide if they hold at least half of the content; then all of them count that hold any
    ``prose`` (characters of undoubted lines that are not mostly links), long or short. An element whose one part holds
    nearly all of its content gives way to that part.
    """
    mass, text, parents = own.copy(), prose.copy(), parser.parents
    for c in range(len(parents) - 1, -1, -1):  # parts come after their wholes
        if parents[c] >= 0:
            mass[parents[c]] += mass[c]
            text[parents[c]] += text[c]
    named = [-1] * len(parents)  # innermost named element around or at each container
    chosen: set[int] = set()
    for c, kind in enumerate(parser.kinds):
        outer = named[parents[c]] if parents[c] >= 0 else -1
        named[c] = outer
        if kind in ("article", "main") and (mass[c] or text[c]):
            named[c] = c
            if outer < 0 or (outer in chosen and mass[c] >= HOLDS_MOST * mass[outer] > 0):
                chosen.discard(outer)
                chosen.add(c)
    whole = own.sum()
    if sum(mass[c] for c in chosen) >= 0.5 * whole > 0:
        return chosen
    return {max((c for c in range(len(mass)) if mass[c] >= HOLDS_MOST * whole > 0), default=-1)}


def main_text(html: str) -> str:
    """The main text of one page: blocks in page order, joined by one space; empty if there is none."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = [x._replace(text=SPACE.sub(" ", x.text).strip()) for x in parser.lines]
    lines = [x for x in lines if x.text or x.tags]
    if not any(x.text and x.weight for x in lines):
        return ""
    ratios = smoothed_ratios(lines)
    content = ratios >= min(ratios.std(), ratios.max())
    own, prose, loose = np.zeros(len(parser.kinds)), np.zeros(len(parser.kinds)), 0
    for line, is_content in zip(lines, content, strict=True):
        if line.within >= 0 and line.weight == 1 and line.linked <= 0.5 * len(line.text):
            prose[line.within] += len(line.text)
        if is_content and line.weight:
            if line.within >= 0:
                own[line.within] += max(0, len(line.text) - line.linked)
            else:
                loose += max(0, len(line.text) - line.linked)
    regions = {-1} if loose > (1 - HOLDS_MOST) * (loose + own.sum()) else content_regions(parser, own, prose)
    inside = [-1 in regions]  # by container, the page first
    for c, parent in enumerate(parser.parents):
        inside.append(c in regions or inside[parent + 1])
    named = any(c >= 0 and parser.kinds[c] in ("article", "main") for c in regions)
    usual = max((x.weight for x in lines if x.text and inside[x.within + 1]), default=1.0)  # a region that is doubtful as a whole is not doubted inside
    kept = [
        line.text
        for line, is_content in zip(lines, content, strict=True)
        if line.text and line.weight and inside[line.within + 1] and (is_content or (line.weight >= usual and (named or line.linked <= 0.5 * len(line.text))))
    ]
    return " ".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns of ``keep``, text and n_chars (code points) for every row of ``pages``.

    A null or empty page, and one without prose, gives an empty text. Null ids and urls stay null, repeated rows
    give repeated results, an empty table gives an empty one, and other columns are ignored. No part of a page is
    left unread, and unclosed or misnested tags are closed by what follows them.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in values(batch.column(batch.num_columns - 1), 20)]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *keep, "text", "n_chars"])

    rows = pages.select(id_col, *keep, html_col)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return map_batches(rows, extract, f"{fields}, text string, n_chars bigint")
