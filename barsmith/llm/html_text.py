"""Main text of web pages by the distribution of line-block lengths.

A page is reduced to lines, one for each block element, in page order. Markup goes;
what stands in an element that is not the page's own prose (menus, headers, footers,
side bars, notices, adverts, forms, reader comments, scripts, styles) leaves empty
lines, as many as a window has, so that it parts the text around it. Headings in the
header of an article are the article's own and stay. If the page names its article
(``article`` or ``main``), lines outside it weigh nothing.

For each line the text lengths of a window of ``WINDOW`` lines are summed. A *surge* is
a window that passes ``SURGE`` characters, or half of the page's largest window where
that is less; from there the text is followed in both directions until it dives, that
is until a whole window is empty. The region from the first surge's start to the last
surge's dive is the text. It is then widened over shorter runs of lines that belong to
it: those parted from it by nothing but what stands inside the element that holds the
region (an advert between two paragraphs, say), and those of a named article. Between
elements that lie directly in the page's body only adverts, notices, forms and the like
are passed over; a menu, header, footer or side bar there ends the region.

Character references are decoded as browsers do; white space inside a block, a line
break included, becomes one space; blocks are joined by one line feed, nothing else is dropped or capped.

Results for odd input: a null or empty page has the empty text; an unclosed
element ends with its parent or the page; markup cut off at the end of the page is
markup; a very long page is handled whole; an empty table gives an empty one; every row
stands for itself, whatever its id or url, and extra columns play no part.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.frames import pick

#: Lines summed, and the characters in them that mark the main text.
WINDOW, SURGE = 3, 80
#: Elements without prose, elements that bound a line, and elements without an end tag.
OUTSIDE = frozenset("nav header footer aside form script style noscript template iframe svg canvas object button select textarea menu dialog head title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: Words of class, id and role that mark an element as not the page's prose: those that part a page, and those found inside a text.
_PARTS = "nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|comments?|disqus|reply|replies|respond|login|search|contentinfo|complementary"
_INSETS = "ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|related"
_MARKS = re.compile(rf"(?:^|[\s_-])(?:({_PARTS})|{_INSETS})(?=$|[\s_-])", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?=$|[\s_-])", re.I)
#: The header of an article by its class; its headings stay.
_OWN_HEADER = re.compile(r"(?:^|\s)(?:article|post|entry|story)[_-]{1,2}header(?=$|\s)", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Excluded elements that part a page.
_PARTING = frozenset("nav header footer aside menu head title".split())
#: Elements that never lose their content through such a word.
_BODY = frozenset(("html", "body", "main"))
#: Block elements that hold other blocks.
_HOLDERS = BLOCK - frozenset("body html p h1 h2 h3 h4 h5 h6 hgroup hr pre li dt dd tr td th caption figcaption legend summary address option".split())
#: Elements that end an open element of the same kind or of these kinds.
_ENDS = {"p": BLOCK - {"body", "html"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)),
         "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")


def _excluded(name: str, attributes: str) -> str:
    """Why an element is not the page's prose: "part", "inset", "own" (an article's header), or "" if it is."""
    kind = "" if name not in OUTSIDE else "part" if name in _PARTING else "inset"
    if not attributes or name in _BODY:
        return kind
    for key, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        key = key.lower()
        if key == "hidden" and not value or key == "aria-hidden" and value.lower() == "true":
            return kind or "inset"
        if key not in ("class", "id", "role") or kind:
            continue
        if name == "article":
            kind = "part" if _COMMENT.search(value) else ""
        elif _OWN_HEADER.search(value):
            kind = "own"
        else:
            m = _MARKS.search(value)
            kind = "" if not m else "part" if m[1] else "inset"
    return kind


class Line(NamedTuple):
    """A line of the page; empty ones stand for an excluded element."""

    text: str
    named: bool  # in a named article
    path: tuple[int, ...]  # the elements that hold its block, by number
    inset: bool = False  # an empty line of an element that does not part a page


class _Open(NamedTuple):
    name: str
    out: int  # 1 excluded, -1 a heading in an article's header, else 0
    kind: str
    article: bool
    number: int


def lines_of(page: str) -> tuple[list[Line], set[int]]:
    """Lines of the page, and the numbers of its named articles."""
    lines: list[Line] = []
    articles: set[int] = set()
    text: list[str] = []
    open_: list[_Open] = []
    out = named = number = 0  # open excluded elements, open articles, elements so far

    def flush(kind: str = "") -> None:
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if line or kind:
            path = tuple(e.number for e in open_ if e.name in _HOLDERS)
            if line:
                own = next((e for e in reversed(open_) if e.name in BLOCK), None)  # the line's block itself does not hold it
                lines.append(Line(line, named > 0, path[:-1] if own and own.name in _HOLDERS else path))
            if kind:
                lines.extend([Line("", named > 0, path, kind == "inset")] * WINDOW)

    def close(n: int) -> None:
        """Close the innermost elements down to ``n``."""
        nonlocal out, named
        while len(open_) > n:
            last = open_[-1]
            if last.name in BLOCK and not out:
                flush()
            open_.pop()
            out -= last.out
            if last.out > 0 and not out:
                text.clear()
                flush(last.kind)
            named -= last.article

    at = 0
    while True:
        m = _TAG.search(page, at)
        if not out:
            text.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i].name == name), None)
            if depth is not None:
                close(depth)
            elif name in BLOCK and not out:
                flush()
            continue
        for i in range(len(open_) - 1, -1, -1):  # implied ends
            above = open_[i].name
            if name in _ENDS.get(above, ()):
                close(i)
                break
            if above in BLOCK and above not in _ENDS:
                break
        if name in BLOCK and not out:
            flush()
        if name == "br" and not out:
            text.append(" ")
        if name in VOID or m.group(3).endswith("/") and name not in BLOCK:
            continue
        kind = _excluded(name, m.group(3))
        if named and kind == "part" and not out and (name == "header" or "header" in m.group(3).lower()):
            kind = "own"
        step = 1 if kind else 0
        if name in _HEADINGS and not kind and out == 1 and any(e.kind == "own" and e.out for e in open_):
            step = -1
        article = name in ("article", "main") and not out and not kind
        if step > 0 and not out:
            flush(kind)
        number += 1
        open_.append(_Open(name, step, kind, article, number))
        out += step
        named += article
        if article:
            articles.add(number)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            stop = end.end() if end else len(page)
            if not out:
                text.append(page[at:end.start() if end else len(page)])
            at = stop
            close(len(open_) - 1)
    close(0)
    if not out:
        flush()
    return lines, articles


def _holder(paths: Iterable[tuple[int, ...]], articles: set[int]) -> tuple[int, ...]:
    """The innermost element that holds all paths; the outermost named article among those that do, if any."""
    common = os.path.commonprefix(list(paths))
    first = next((i for i, e in enumerate(common) if e in articles), None)
    return common if first is None else common[:first + 1]


def main_text(page: str) -> str:
    """The text between surge and dive."""
    lines, articles = lines_of(page)
    named = any(x.named and x.text for x in lines)
    size = np.array([len(x.text) if x.named or not named else 0 for x in lines], np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return ""
    n = len(size)
    total = np.concatenate([[0], np.cumsum(size)])
    block = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:n]  # text of the window that begins at each line
    # Runs of lines between dives: a dive is a window without text.
    dive = np.flatnonzero(np.diff(full) > WINDOW)
    begin, end = full[np.append(0, dive + 1)], full[np.append(dive, len(full) - 1)] + 1
    least = min(SURGE, int(block.max()) / 2)
    surges = [i for i, (a, b) in enumerate(zip(begin, end, strict=True)) if block[max(0, a - WINDOW + 1):b].max() >= least]
    first, last = surges[0], surges[-1]
    held = _holder((lines[i].path for i in full[(full >= begin[first]) & (full < end[last])]), articles)

    def belongs(a: int, b: int, nearest: int) -> bool:
        """Whether the lines between ``a`` and ``b`` let the region reach the run."""
        if lines[nearest].named:
            return True
        return all(not x.text and x.path[:len(held)] == held and (held or x.inset) for x in lines[a:b]) and lines[nearest].path[:len(held)] == held

    while first and belongs(end[first - 1], begin[first], end[first - 1] - 1):
        first -= 1
    while last + 1 < len(begin) and belongs(end[last], begin[last + 1], begin[last + 1]):
        last += 1
    return "\n".join(lines[i].text for i in full[(full >= begin[first]) & (full < end[last])])


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``, its code points."""
    narrow = pick(pages, id=id_col, url=url_col, html=html_col)
    narrow = narrow.withColumn("html", F.col("html").cast("string"))
    kinds = dict(narrow.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py() or "") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["id", "url", "text", "n_chars"])

    out = narrow.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.toDF(id_col, url_col, "text", "n_chars")
