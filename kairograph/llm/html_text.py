"""Main text of raw web pages by text-to-tag ratios over standard-library parser events.

The page is fed to ``html.parser`` in pieces. Block elements cut its text into lines; each
line knows how many tags and how much link text it has, its container, and what its ancestors
say of it. The ratio of text to tags per line, weighed by the ancestors, is smoothed by a
Gaussian and cut by two clusters; containers that hold a share of the ratio above the threshold
are the content regions. Inside a region every line without a furniture mark is kept, so that a
short paragraph between long ones is not lost.

Elements and words of a class, id or role are weights, no verdicts: elements of one such name
that together hold almost all of the page's plain text are not marked at all, a marked
line stays if its own weighed ratio and the smoothed one are above the threshold, and article
and main elements only weigh more than others. What is never shown (scripts, styles, forms'
controls, hidden elements) is no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_with

# Fixed values of HTML: elements without content, block elements, furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
UNSHOWN = frozenset("head script style noscript template button select textarea iframe object svg canvas audio video dialog".split())
#: Elements that weigh as furniture.
MARKING = frozenset("nav footer header aside form menu".split())
CONTENT = frozenset("article main".split())
#: Words of a class, id or role that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "footer form header masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget "
    "complementary contentinfo".split()
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")
PIECE = 1 << 16
SIGMA = 1.5
#: Weights of lines in a marking element, of lines with a marking class word (before and after smoothing,
#: so that they neither lend to nor borrow from their neighbours), and of article and main elements.
FRAMED, MARKED, NAMED = 0.1, 0.25, 2.0
#: Words of a name that mark furniture while anything else on the page reads like an article.
STRICT = frozenset("comment comments commentlist disqus reply respond footer nav navbar navigation contentinfo".split())
#: Share of the plain text outside links above which a name's elements may be no furniture.
RELEASED = 0.8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A closing block reads as a sentence, and is no copyright line.
_SENTENCE, _RIGHTS = re.compile(r"[.!?…。！？][\"'”’»)]*$"), re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
#: Share of the best container's ratio that makes another one part of the article.
SHARE = 0.2


class _Lines(HTMLParser):
    """Parser events to lines: (text, tags, link characters, container number, state, marks, heading); the
    state is 0 for plain lines, 1 in a marking element, 2 where nothing is shown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, frozenset]] = []
        self.open: Counter[str] = Counter()  # open elements by name, so that stray end tags cost nothing
        self.lines: list[tuple[str, int, int, int, int, frozenset, bool]] = []
        self.kinds: list[bool] = [False]  # of each container: whether it is an article or main element
        self.outer: list[int] = [0]  # of each container: the element it stands in, by number
        self.elements = 0
        self.numbers: list[int] = []  # of the open elements
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _state(self) -> tuple[int, int, frozenset]:
        return self.stack[-1][1:] if self.stack else (0, 0, frozenset())

    def _close(self, k: int) -> None:
        """Close the elements from place ``k`` of the stack on."""
        for x in self.stack[k:]:
            self.open[x[0]] -= 1
        del self.stack[k:], self.numbers[k:]

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        state, container, marks = self._state()
        if text:
            heading = any(x[0] in HEADINGS for x in self.stack[-4:])
            self.lines.append((text, self.tags, self.linked, container, state, marks, heading))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "body":
            while self.stack and self.stack[-1][0] != "html":
                self._close(len(self.stack) - 1)
        elif tag in BLOCK and self.open["p"] and self.stack[-1][0] != tag:
            for k in range(len(self.stack) - 1, -1, -1):  # a block ends an open paragraph
                if self.stack[k][0] == "p":
                    self._close(k)
                    break
                if self.stack[k][0] in BLOCK:
                    break
        elif tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and self.stack and self.stack[-1][0] == tag:
            self._close(len(self.stack) - 1)
        if tag in VOID:
            return
        state, container, marks = self._state()
        if tag not in ("html", "body"):
            if tag in UNSHOWN or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
                state = 2
            state = max(state, int(tag in MARKING))
            marks |= self._marks(tag, attrs)
        named = tag in CONTENT or any(k == "role" and v == "main" for k, v in attrs)
        if named or tag in ("div", "section", "td") and not self.kinds[container]:
            self.kinds.append(named)
            self.outer.append(self.numbers[-1] if self.numbers else 0)
            container = len(self.kinds) - 1
        self.elements += 1
        self.numbers.append(self.elements)
        self.stack.append((tag, state, container, marks))
        self.open[tag] += 1

    @staticmethod
    def _marks(tag, attrs) -> frozenset:
        """Names (without numbers) of an element that hold a furniture word; elements of one name are judged together."""
        return frozenset((tag, k, _DIGITS.sub("", v)) for k, v in attrs if v and k in ("class", "id", "role") and any(w.lower() in FURNITURE for w in _NAME.findall(v)))

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.open[tag]:
            if tag in BLOCK:
                self.cut()
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        outer = self.stack[k - 1][1::2] if k else (0, frozenset())
        if tag in BLOCK or self.stack[k][1::2] != outer:
            self.cut()
        self._close(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style", "template"):
            return
        self.parts.append(data)
        if any(x[0] == "a" for x in self.stack[-4:]):
            self.linked += len(data.strip())


def page_lines(html: str) -> _Lines:
    """The parser after a page, with its lines and containers."""
    parser = _Lines()
    for k in range(0, len(html), PIECE):
        parser.feed(html[k : k + PIECE])
    parser.close()
    parser.cut()
    return parser


def raw_ratios(lines) -> np.ndarray:
    """Characters outside links per tag of each line; what is not shown has none."""
    return np.array([0.0 if state == 2 else max(0, len(text) - linked) / (1 + tags) for text, tags, linked, _, state, *_ in lines])


def smoothed_ratios(ratio: np.ndarray) -> np.ndarray:
    """Ratios smoothed over neighbours."""
    reach = min(len(ratio), int(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(ratio, kernel / kernel.sum(), "full")[reach : reach + len(ratio)]


def released_marks(lines) -> set:
    """Names that mark no furniture here. Their elements hold almost all of the page's plain text outside
    links, and no line without such a name is above the threshold of the lines' own ratios; a name
    with a word of ``STRICT`` also needs that no line without such a word is above it."""
    total, held = 0, {}
    for text, _, linked, _, state, marks, _ in lines:
        if not state:
            n = max(0, len(text) - linked)
            total += n
            for m in marks:
                held[m] = held.get(m, 0) + n
    large = {m for m, n in held.items() if n > RELEASED * total}
    if not large:
        return large
    ratio = raw_ratios(lines) * np.array([FRAMED if x[4] == 1 else 1.0 for x in lines])
    cut = threshold_of(smoothed_ratios(ratio))
    high = [x for x, r in zip(lines, ratio) if not x[4] and r >= cut]
    strict = {m for m in large if STRICT & {w.lower() for w in _NAME.findall(m[2])}}
    if any(not x[5] for x in high):
        return set()
    if any(not x[5] & strict for x in high):
        return large - strict
    return large


def threshold_of(values: np.ndarray) -> float:
    """Middle between the centres of two clusters of the smoothed ratios."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        above = values > cut
        new = (values[~above].mean() if (~above).any() else low, values[above].mean() if above.any() else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The article's blocks joined by one line feed; empty where a page has none."""
    if not html:
        return ""
    page = page_lines(html)
    lines, kinds = page.lines, page.kinds
    if not lines:
        return ""
    ratio = raw_ratios(lines)
    released = released_marks(lines)
    state, marked = np.array([x[4] for x in lines]), np.array([not x[5] <= released for x in lines])
    weight_of = np.where(state == 1, FRAMED, 1.0) * np.where(marked, MARKED, 1.0)
    ratio *= weight_of
    smooth = smoothed_ratios(ratio) * weight_of
    cut = threshold_of(smooth)
    high = smooth >= cut
    shown = (state < 2) & ((weight_of == 1) | high & (ratio >= cut))
    mass: dict[int, float] = {}  # of each container: its ratio above the threshold
    for x, r, up, show in zip(lines, smooth, high, shown):
        if show and up:
            mass[x[3]] = mass.get(x[3], 0.0) + r * (NAMED if kinds[x[3]] else 1.0)
    least = SHARE * max(mass.values(), default=0.0)
    regions = {c for c, m in mass.items() if m >= least}
    keep = shown & np.array([x[3] in regions for x in lines])
    if not keep.any():
        return ""
    # between a region's lines, plain lines of the containers inside it; and lines that are long themselves
    places = np.flatnonzero(keep)
    named = any(kinds[c] for c in regions)
    inside = np.zeros(len(lines), bool)
    inside[places[0] : places[-1] + 1] = not named
    keep |= shown & inside
    beside = {page.outer[c] for c in regions}
    for k in _beside(lines, keep, weight_of == 1, lambda c: page.outer[c] in beside):
        keep[k] = True
    return "\n".join(x[0] for x, k in zip(lines, keep) if k)


def _beside(lines, keep: np.ndarray, plain: np.ndarray, sibling) -> list[int]:
    """Plain lines of sibling containers that adjoin the kept ones: before them, from a heading on;
    after them, what reads as sentences."""
    first, last = np.flatnonzero(keep)[[0, -1]]

    def fits(k: int) -> bool:
        text, _, linked, container, state, _, _ = lines[k]
        return bool(plain[k]) and not state and 2 * linked < len(text) and sibling(container)

    out, run, k = [], [], first - 1
    while k >= 0 and fits(k):
        run.append(k)
        if lines[k][6]:
            out, run = out + run, []
        k -= 1
    k = last + 1
    while k < len(lines) and fits(k) and (lines[k][6] or _SENTENCE.search(lines[k][0])) and not _RIGHTS.search(lines[k][0]):
        out.append(k)
        k += 1
    while out and out[-1] > last and lines[out[-1]][6]:
        out.pop()  # a heading with nothing below it
    return out


def extract_main_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` plus ``text`` and ``n_chars`` (its code points).

    Null or empty html gives an empty text; repeated rows are kept; an empty table stays
    empty; existing columns of the two names are replaced."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(lambda h: main_text(h if isinstance(h, str) else None))

    kept = pages.select(*columns_with(pages, "text", "n_chars"))
    return kept.withColumn("text", extract(F.col(html_col).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
