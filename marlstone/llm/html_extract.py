"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags. A word scores 1, a tag, a word in a link and a word in an element that
calls itself a menu, advert, footer or the like score below zero, by weights that come from labelled pages; one linear
scan finds the contiguous region of the highest total. That region is the text. Only its ends are mended: blocks that it
cuts are taken whole, and so are the plain blocks beside it within the smallest element around it, up to the first menu,
header, footer, sidebar or list of links; adverts and forms don't end it. Between the region's words, every element
named as boilerplate goes whose words and tags score below zero in sum; outside of it nothing is kept, whatever its name.

Defined cases: null or empty html gives the empty string; broken nesting, tags left open and pages cut short are read
as far as they go; equal rows give equal results; pages of any length take time in proportion; an empty table gives an
empty result. Only the id, url and html columns are read. Of weights that agree with the labels equally well, the ones
nearest to the middle of them all are taken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import arrow_column

# Fixed values of HTML: elements without an end, elements of raw text, elements that don't break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object audio video select option xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIER = frozenset("html body article main section div td th table li ul ol blockquote aside nav header footer form".split())
# What pages call their menus, notices, adverts, comments and the like.
BOILER_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
INSERTED_TAGS = frozenset("form button dialog fieldset".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu menubar breadcrumb breadcrumbs sidebar side rail widget widgets aside "
    "footer masthead topbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations pagination pager toolbar tags taglist skip hidden".split()
)
# Of these, what stands between the paragraphs of a text.
INSERTED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations skip hidden".split()
)
# Reader comments, whatever else the name says ("post-comments"), unless a word says that it is about them ("has-comments").
COMMENT_NAMES = frozenset("comment comments commentlist commentary disqus reply replies respond".split())
ABOUT_NAMES = frozenset("has have no with without open opened closed enable enabled disabled allow count counter".split())
CONTENT_NAMES = frozenset("article content main post entry story body text".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
KEEP_TAGS = frozenset("html body article main".split())

# A quote opens a value only after an equals sign; elsewhere in a tag it is a character like any other.
_VALUE = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*"
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:{_VALUE})?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}

PLAIN, LINK, BOILER = range(3)
LABELLED_PAGES, LABELLED_CHARS = 200, 65_536
#: tag, word in a link, word in boilerplate; used where no labelled page is to be had.
DEFAULT = (-0.25, -1.5, -3.0)
GRID = [(t, l, b) for t in (-0.125, -0.25, -0.5, -1.0, -2.0) for l in (0.5, 0.0, -0.5, -1.0, -1.5, -2.0, -3.0) for b in (0.5, 0.0, -0.5, -1.0, -2.0, -3.0, -4.0, -6.0)]


NAMED, STRUCTURE = 1, 2


def _boiler(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element calls itself boilerplate, by its name, role, class and id: 0, NAMED, or STRUCTURE for menus, headers and the like."""
    if tag in KEEP_TAGS and tag != "article":
        return 0
    if tag in BOILER_TAGS or tag == "header" and not in_article:
        return NAMED if tag in INSERTED_TAGS else STRUCTURE
    if "=" not in attrs:
        return NAMED if " hidden" in f" {attrs} " else 0
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in BOILER_ROLES:
        return STRUCTURE
    if found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return NAMED
    tokens = [[n.lower() for n in _NAME.findall(_CAMEL.sub(" ", w))] for v in (found.get("class", ""), found.get("id", "")) for w in v.split()]
    if any(COMMENT_NAMES & set(t) and not ABOUT_NAMES & set(t) for t in tokens):
        return STRUCTURE
    names = [n for t in tokens for n in t]
    bad = [n for n in names if n in BOILER_NAMES]
    if in_article and {"header", "title"} & set(names) and len(bad) == names.count("header"):
        return 0
    if not bad or any(n in CONTENT_NAMES for n in names):
        return 0
    return NAMED if set(bad) <= INSERTED_NAMES else STRUCTURE


class Page:
    """A page's blocks of words, and the sequence that is scored: runs of words and tags.

    nodes: parent of each element; runs: (kind, number of words, element, block), a tag is a run of no words.
    """

    def __init__(self, text: str):
        self.parent, self.depth, self.tags = [-1], [0], ["#page"]
        self.kind: list[int] = []
        self.size: list[int] = []
        self.node: list[int] = []
        self.text: list[str] = []
        self.breaks: list[bool] = []  # whether a block ends at this run
        self.named: list[int] = []  # elements that call themselves boilerplate
        self.ends: list[bool] = [False]  # by element, whether it lies in a menu, header or the like
        self._read(text)

    def _add(self, kind: int, size: int, node: int, text: str, breaks: bool) -> None:
        self.kind.append(kind)
        self.size.append(size)
        self.node.append(node)
        self.text.append(text)
        self.breaks.append(breaks)

    def _read(self, text: str) -> None:
        stack = [(0, "#page", PLAIN, False)]  # element, name, kind of its words, inside an article
        places: dict[str, list[int]] = {}  # by name, where in the stack its open elements are
        at, n = 0, len(text)
        while at < n:
            m = _TOKEN.search(text, at) if text[at] != "<" else _TOKEN.match(text, at)
            if m is None and text[at] == "<":  # a bare "<" is text
                m = _TOKEN.search(text, at + 1)
            start = m.start() if m else n
            if start > at:
                words = html.unescape(text[at:start])
                self._add(stack[-1][2], len(words.split()), stack[-1][0], words, False)
            if m is None:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, places, tag)
                continue
            if tag in RAW:
                if not m[0].endswith("/>"):
                    end = _RAW_END[tag].search(text, at)
                    at = end.start() if end else n
                self._add(-1, 0, stack[-1][0], "", tag not in INLINE)
                continue
            if tag in CLOSES_P:
                self._close_open(stack, places, "p", BARRIER)
            elif tag in ("li", "dt", "dd", "tr", "td", "th"):
                self._close_open(stack, places, tag, frozenset(("ul", "ol", "dl", "table")))
            top = stack[-1]
            element = top[0]
            if tag not in VOID:
                self.parent.append(element)
                self.depth.append(self.depth[element] + 1)
                self.tags.append(tag)
                element = len(self.parent) - 1
                inside = top[3] or tag in ("article", "main")
                named = _boiler(tag, m[3], top[3])
                self.ends.append(self.ends[top[0]] or named == STRUCTURE)
                if named:
                    self.named.append(element)
                kind = BOILER if top[2] == BOILER or named else LINK if top[2] == LINK or tag == "a" else PLAIN
                if not m[0].endswith("/>"):
                    places.setdefault(tag, []).append(len(stack))
                    stack.append((element, tag, kind, inside))
            self._add(-1, 0, element, "", tag not in INLINE)

    @staticmethod
    def _cut(stack: list, places: dict[str, list[int]], at: int) -> None:
        """Close all elements of the stack from `at` on."""
        while len(stack) > at:
            places[stack.pop()[1]].pop()

    @staticmethod
    def _last(places: dict[str, list[int]], tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def _close(self, stack: list, places: dict[str, list[int]], tag: str) -> None:
        at = self._last(places, tag)
        if not at or tag in INLINE | {"p"} and any(self._last(places, t) > at for t in ("article", "main", "body")):
            return
        self._add(-1, 0, stack[at][0], "", tag not in INLINE)
        self._cut(stack, places, at)

    def _close_open(self, stack: list, places: dict[str, list[int]], tag: str, barrier: frozenset) -> None:
        at = self._last(places, tag)
        if at and not any(self._last(places, t) > at for t in barrier if t != tag):
            self._cut(stack, places, at)

    def inside(self, element: int) -> np.ndarray:
        """Which runs lie in an element."""
        within = np.zeros(len(self.parent), bool)
        within[element] = True
        for k in range(element + 1, len(self.parent)):  # parents come before their children
            within[k] = within[self.parent[k]]
        return within[np.array(self.node, np.int64)]

    def scores(self, weights: tuple[float, float, float]) -> np.ndarray:
        """What each run counts: a tag, or its words by kind."""
        tag, link, boiler = weights
        kind = np.array(self.kind, np.int64)
        return np.where(kind < 0, tag, np.array(self.size) * np.array((1.0, link, boiler, 0.0))[kind])

    def region(self, weights: tuple[float, float, float]) -> tuple[int, int]:
        """First and last run, exclusive, of the contiguous region of the highest score; nothing scores above zero: (0, 0)."""
        best = total = 0.0
        start, found = 0, (0, 0)
        for k, score in enumerate(self.scores(weights).tolist()):
            total += score
            if total <= 0:
                total, start = 0.0, k + 1
            elif total > best:
                best, found = total, (start, k + 1)
        return found

    def _block_of(self) -> np.ndarray:
        """By run, the number of its block: runs between two tags that break a line."""
        breaks = np.array(self.breaks, np.int64)
        return np.cumsum(breaks) * 2 - breaks

    def grown(self, region: tuple[int, int]) -> tuple[int, int]:
        """The region with the blocks that it cuts, and with the plain blocks beside it within the smallest element around it.

        The body and the page are no such element. Words of a menu or the like, and two blocks of links alone, one after the other, end it."""
        held = [self.node[k] for k in range(*region) if self.size[k]]
        if not held:
            return region
        block = self._block_of()
        first = int(np.searchsorted(block, block[region[0]], "left"))
        last = int(np.searchsorted(block, block[region[1] - 1], "right"))
        # Elements are numbered as they open, so what holds the first and the last of them holds them all.
        top, x = min(held), max(held)
        while top != x:
            if self.depth[top] >= self.depth[x]:
                top = self.parent[top]
            else:
                x = self.parent[x]
        while self.tags[top] in INLINE or self.tags[top] in ("p", "h1", "h2", "li"):
            top = self.parent[top]
        if self.tags[top] in ("#page", "html", "body"):
            return first, last
        within = self.inside(top)
        steps = (range(first - 1, -1, -1), -1), (range(last, len(self.kind)), 1)
        ends = [first, last]
        for side, (order, step) in enumerate(steps):
            links, here, plain, any_words = 0, -1, False, False
            for k in order:
                if not within[k] or self.size[k] and self.ends[self.node[k]]:
                    break
                if self.kind[k] == BOILER:
                    continue
                if block[k] != here:
                    links = links + 1 if any_words and not plain else 0 if plain else links
                    if links == 2:
                        break
                    here, plain, any_words = block[k], False, False
                if self.size[k]:
                    any_words = True
                    plain = plain or self.kind[k] == PLAIN
                if plain or any_words and links == 0:
                    ends[side] = k if step < 0 else k + 1
        # A block is taken whole at the grown ends, too.
        return int(np.searchsorted(block, block[ends[0]], "left")), int(np.searchsorted(block, block[ends[1] - 1], "right"))

    def dropped(self, region: tuple[int, int], weights: tuple[float, float, float]) -> np.ndarray:
        """The runs in elements named as boilerplate that score below zero in sum, between plain words of a region or within its blocks."""
        n, node = len(self.parent), np.array(self.node, np.int64)
        own = np.bincount(node, self.scores(weights), n)
        low, high = np.full(n, len(node)), np.full(n, -1)
        np.minimum.at(low, node, np.arange(len(node)))
        np.maximum.at(high, node, np.arange(len(node)))
        for k in range(n - 1, 0, -1):  # children come after their parents
            up = self.parent[k]
            own[up] += own[k]
            low[up], high[up] = min(low[up], low[k]), max(high[up], high[k])
        plain = [k for k in range(*region) if self.kind[k] == PLAIN and self.size[k]]
        gone = np.zeros(n, bool)
        for k in self.named if plain else ():
            gone[k] = own[k] < 0 and (self.tags[k] in INLINE or low[k] > plain[0] and high[k] < plain[-1])
        for k in range(1, n):
            gone[k] |= gone[self.parent[k]]
        return gone[node]

    def blocks(self, region: tuple[int, int], dropped: np.ndarray) -> str:
        """The text of a region's runs: white space inside a block is one space, blocks are joined by one."""
        out, block = [], []
        for k in range(*region):
            if self.breaks[k] and block:
                out.append("".join(block))
                block = []
            if self.text[k] and not dropped[k]:
                block.append(self.text[k])
        out.append("".join(block))
        return " ".join(w for b in out for w in b.split())


def extract(text: str | None, weights: tuple[float, float, float] = DEFAULT) -> str:
    """The main text of a page."""
    if not text:
        return ""
    page = Page(text)
    region = page.grown(page.region(weights))
    return page.blocks(region, page.dropped(region, weights))


def fit(pages: list[str]) -> tuple[float, float, float]:
    """The weights whose bare regions overlap best with the labelled ones.

    A page is labelled if it has exactly one article or main element; that element's words are its content, but for the
    elements in it that are named as boilerplate. Agreement is the mean F1 of words over labelled pages. Of equally good
    weights in GRID, the ones nearest to their mean are taken, and of equally near ones the first.
    """
    labelled = []
    for text in pages:
        page = Page(text)
        marks = [k for k, t in enumerate(page.tags) if t in ("article", "main")]
        if len(marks) == 1:
            labelled.append((page, page.inside(marks[0]) & (np.array(page.kind) != BOILER)))
    if not labelled:
        return DEFAULT

    def agreement(weights: tuple[float, float, float]) -> float:
        total = 0.0
        for page, truth in labelled:
            size = np.array(page.size)
            mine = np.zeros(len(size), bool)
            mine[slice(*page.region(weights))] = True
            both = size[mine & truth].sum()
            total += 2 * both / max(1, size[mine].sum() + size[truth].sum())
        return round(total / len(labelled), 9)

    found = [agreement(w) for w in GRID]
    best = np.array([w for w, a in zip(GRID, found) if a == max(found)])
    return tuple(best[np.abs(best - best.mean(0)).sum(1).argmin()].tolist())


def extractor(weights: tuple[float, float, float]):
    """html -> its main text and that text's code points."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            texts = [extract(p.as_py(), weights) for p in pages]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"])

    return arrow_column(run, "struct<text:string,n_chars:bigint>")


def fit_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = LABELLED_PAGES) -> tuple[float, float, float]:
    """Weights from at most `most` pages of at most LABELLED_CHARS characters that have an article or main element: those
    whose ids' hashes are least. The hashes are chosen first, so that only the chosen pages come to the driver."""
    few = pages.filter(F.char_length(html_col) <= LABELLED_CHARS).select(F.xxhash64(id_col, html_col).alias("_h"), F.col(html_col).alias("_t")).filter(F.col("_t").rlike("(?i)<(article|main)[\\s>]"))
    chosen = [r["_h"] for r in few.select("_h").orderBy("_h").limit(most).collect()]
    return fit([r["_t"] for r in few.filter(F.col("_h").isin(chosen)).dropDuplicates(["_h"]).orderBy("_h").collect()]) if chosen else DEFAULT


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple | None = None) -> DataFrame:
    """id, url, text and n_chars of each page; weights: fitted on the pages themselves if None."""
    weights = weights or fit_weights(pages, html_col, id_col)
    return pages.select(F.col(id_col), F.col(url_col), extractor(tuple(weights))(F.col(html_col)).alias("_t")).select(id_col, url_col, "_t.*")
