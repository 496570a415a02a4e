"""Main text of web pages by the distribution of text over lines of markup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines whose lengths are summed, and the share of the page's largest sum from which a
#: stretch of lines is text even if most of it is links.
WINDOW, SURGE = 3, 0.35
#: A line or stretch with a larger share of link text is mostly links.
LINKS = 0.6

# Elements of HTML by what they mean for the main text.
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
NOT_SHOWN = set("head script style noscript template title iframe object svg math canvas audio video select datalist textarea button".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BESIDE = set("nav header footer aside form menu dialog".split())
BESIDE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
BESIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar header masthead footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "signup login comment comments commentlist disqus respond replies related share sharing social widget toolbar pagination pager".split()
)
#: With one of these parts a name tells what is not there or is there too: ``no-comments``, ``with-sidebar``.
OTHERWISE = set("and has have hide is layout no not show toggle with without".split())
#: A name with one of each names what holds the text and more: ``content-sidebar-wrap``.
TEXT_PARTS, WRAPPERS = set("article content entry main story text".split()), set("container wrap wrapper".split())
ADVERTS = set("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion".split())
COMMENTS = set("comment comments commentlist disqus respond replies".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An element that one of these opens while it is open ends by itself.
ENDS = {
    "p": BLOCKS - {"br"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
BARRIERS = {"article", "main", "body", "html"}
_PART = re.compile(r"[a-z][a-z0-9]*")
#: What short lines of notices and footers say. Only looked for where no element marks the article.
_NOTICE = re.compile(r"©|\(c\) *[0-9]{4}|copyright|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)", re.I)
_SENTENCE = re.compile(r"[.!?…:;。！？؟।][\"'”’»)\]]*$")
#: Characters of a line that is text whatever it ends with, and that a notice has at most.
TEXT_CHARS, NOTICE_CHARS = 80, 300


def marks(names: str) -> set[str]:
    """The listed words in the class or id tokens that name what stands beside the text."""
    out = set()
    for token in names.lower().split():
        parts = {x.rstrip("0123456789") for x in _PART.findall(re.sub(r"[0-9]+x[0-9]+", " ", token))}
        if not parts & OTHERWISE and not (parts & TEXT_PARTS and parts & WRAPPERS):
            out |= parts & BESIDE_NAMES
    return out


class Line(NamedTuple):
    text: str
    beside: int  # 0 no; 1 by a name alone; 2 by an element, a role, or as comments or an advert
    main: int  # number of the article or main element that it stands in, or 0
    linked: int  # characters of link text
    heading: bool


class Lines(HTMLParser):
    """Strips markup: the page's blocks, each with what it stands in.

    An article or main element ends the mark of what it stands in, unless it is an advert or
    a comment itself. An article in an aside or among comments or related pages is one of
    those; but an aside that nothing closes doesn't hold it. Work and memory grow with the
    page, however deep its elements are nested.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, bool, int, int]] = []  # tag, hidden, beside, main, holder, own number
        self.scopes: list[Counter] = [Counter()]  # open elements since each barrier
        self.n_barriers = self.n_links = self.n_open = 0
        self.closed: set[int] = set()
        self.holders: list[int] = []  # of each line
        self.text: list[str] = []
        self.linked = 0
        self.heading = False
        self.n_main = 0
        self.main_at = 0

    def _state(self) -> tuple[bool, int, bool, int]:
        """Hidden, beside, main, and the number of the aside that the text stands in, if any."""
        return self.open[-1][1:5] if self.open else (False, 0, False, 0)

    def _cut(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                _, beside, main, holder = self._state()
                self.lines.append(Line(line, beside, self.main_at if main else 0, self.linked, self.heading))
                self.holders.append(holder)
        self.text, self.linked, self.heading = [], 0, False

    def _push(self, tag: str, hidden: bool, beside: int, main: bool, holder: int) -> None:
        self.open.append((tag, hidden, beside, main, holder, self.n_open))
        self.scopes[-1][tag] += 1
        self.n_links += tag == "a"
        if tag in BARRIERS:
            self.scopes.append(Counter())

    def _pop(self) -> str:
        tag, *_, number = self.open.pop()
        if tag in BARRIERS:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        self.n_links -= tag == "a"
        self.closed.add(number)
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._cut()
        while self.open and tag in ENDS.get(self.open[-1][0], ()):
            self._pop()
        if tag in VOID:
            return
        hidden, beside, main, holder = self._state()
        self.n_open += 1
        names = dict(attrs)
        named = marks(f"{names.get('class') or ''} {names.get('id') or ''}")
        role = (names.get("role") or "").lower()
        hidden |= tag in NOT_SHOWN or "hidden" in names or "none" in (names.get("style") or "").replace(" ", "").partition("display:")[2][:4]
        if tag in ("article", "main") or role in ("article", "main"):
            beside = 2 if named & (ADVERTS | COMMENTS) else 0
            if "main" in (tag, role):
                holder = 0
            if not main and not beside:
                self.n_main += 1
                self.main_at = self.n_main
            main = True
        elif tag not in ("html", "body"):
            inner = tag == "header" and main  # an article's own header holds its headline
            if main:
                named -= {"header", "masthead", "banner", "menu"}
            if (tag in BESIDE and not inner) or role in BESIDE_ROLES or named & (ADVERTS | COMMENTS):
                beside = 2
            elif named:
                beside = max(beside, 1)
            if tag == "aside" or role == "complementary" or named & (COMMENTS | {"related"}):
                holder = holder or self.n_open
        self._push(tag, hidden, beside, main, holder)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._cut()
        # a stray end tag closes nothing outside its article
        scopes = self.scopes if tag in BARRIERS else self.scopes[-1:]
        if any(scope[tag] > 0 for scope in scopes):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.text.append(data)
            if self.n_links:
                self.linked += len(data.strip())
            if self.open and self.open[-1][0] in HEADINGS:
                self.heading = True

    def close(self) -> None:
        super().close()
        self._cut()
        self.lines = [line._replace(beside=2) if holder in self.closed else line for line, holder in zip(self.lines, self.holders)]


def main_regions(lengths: np.ndarray, linked: np.ndarray, total: np.ndarray, window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """Every stretch of lines from a surge to its dive of the text summed over line windows.

    Text surges where the sums rise from nothing and dives where they fall to nothing, so
    ``window`` lines of length 0 part two stretches. One goes only if it is mostly links
    (``linked`` of ``total`` characters) and its sums stay below ``surge`` of the largest.
    """
    at = np.flatnonzero(lengths)
    if not len(at):
        return []
    sums = np.convolve(lengths, np.ones(window))
    parts = np.split(at, np.flatnonzero(np.diff(at) > window) + 1)
    regions = [(int(p[0]), int(p[-1]) + 1) for p in parts]
    return [(a, b) for a, b in regions if linked[a:b].sum() <= LINKS * total[a:b].sum() or sums[a : b + window - 1].max() >= surge * sums.max()]


def text_lengths(lines: list[Line]) -> np.ndarray:
    """The length that each line has in the distribution: 0 for what is not the main text.

    Where the page marks articles or main elements, all lines in them count, others don't.
    Where it marks none, lines that are mostly links don't, nor short ones that speak as
    notices do, nor those in elements named like what stands beside a text, unless these
    hold more than twice as much text as all others do: then the names mean something else.
    """
    total, linked = np.array([len(x.text) for x in lines], float), np.array([x.linked for x in lines], float)
    beside = np.array([x.beside for x in lines], int)
    if any(x.main and not x.beside for x in lines):
        return np.where([x.main > 0 for x in lines] & (beside == 0), total, 0)
    plain = np.where(linked <= LINKS * total, total, 0)
    notice = [len(x.text) <= NOTICE_CHARS and bool(_NOTICE.search(x.text)) for x in lines]
    plain[np.array(notice, bool)] = 0
    named = plain[beside == 1].sum() > 2 * plain[beside == 0].sum()
    return np.where(beside <= int(named), plain, 0)


def main_text(html: str | None) -> str:
    """The main text's blocks, joined by an empty line; empty if there is none.

    On every page, the stretches from a surge to a dive of the text summed over line windows
    are kept, less the lines in them that have no length (``text_lengths``). Where no
    element marks the article, short lines at a stretch's ends that are neither headings nor
    sentences are left out, as bars of words at the top and the bottom of a page are.
    """
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = [line for line in parser.lines if line.beside < 2]
    if not lines:
        return ""
    lengths = text_lengths(lines)
    total, linked = np.array([len(x.text) for x in lines], float), np.array([x.linked for x in lines], float)
    marked = any(x.main and not x.beside for x in lines)
    texty = [marked or x.heading or len(x.text) >= TEXT_CHARS or bool(_SENTENCE.search(x.text)) for x in lines]
    out = []
    for a, b in main_regions(lengths, np.where(marked, 0, linked), total):
        kept = [k for k in range(a, b) if lengths[k]]
        ends = [k for k in kept if texty[k]] or kept
        out += [lines[k].text for k in kept if ends[0] <= k <= ends[-1]]
    return "\n\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page; null html counts as empty.

    Every row of ``pages`` gives one row, repeated ones too; other columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            for at in range(0, batch.num_rows, 64):
                texts = [main_text(h.as_py()) for h in column.slice(at, 64)]
                part = batch.slice(at, 64)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(of, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
