"""Main text of web pages by line-block distribution (operator 2).

Markup is stripped into lines, one for each block, in page order. Menus, headers, footers, sidebars, forms, dialogs,
scripts, styles, hidden parts and reader comments - by their elements, or attributes for the last two - make empty
lines. A line's length is the number of characters of its text outside links. Two doubts divide it by `DOUBT` each:
that the class, id or role of what holds it names a part beside the main text, and that the page has an article and the
line lies outside it. Lines of equal doubts form one distribution, in page order: sums of lengths over sliding windows
of `window` lines. A run of lines surges where the sum gets to `surge` characters - or to the page's highest sum, if that is
less - and dives where it gets to zero; the lines from the first to the last with a length before the dive are kept,
empty ones aside. So a box of adverts is dropped because it is short for its doubts, and an article in a box with an
odd name is kept because it is long.

A null or empty page has an empty text. Repeated rows each come back. Ties don't arise: lines keep the page's order. A
page is held whole by one task and takes time in proportion to its length. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: Least window sum, in characters, of main text.
SURGE = 80
DOUBT = 8

#: Elements whose content is never text.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video head select datalist textarea button".split())
#: Those of them that take all up to the end of the page if they have no end.
ENDLESS = frozenset("script style textarea iframe".split())
#: Elements that are never main text.
ASIDE = frozenset("nav aside footer header form menu dialog fieldset label".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that hold others and are closed by their own end tags; paragraphs and items may stay open.
HOLDERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name parts beside the main text.
HINTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer contentinfo sidebar aside complementary widget widgets related recommended recommendations share sharing social ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments reply replies respond disqus discussion pagination pager toolbar copyright legal disclaimer gdpr paywall hidden".split()
)
TALK = frozenset("comment comments reply replies respond disqus discussion".split())

_TOKEN = re.compile(
    # Quotes hold a > only right after a =, and only if they end.
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)|<""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(attrs: str) -> set[str]:
    return {w.lower() for m in _NAMED.finditer(attrs) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")}


class Line(NamedTuple):
    text: str  # empty in parts that are never main text
    length: int
    doubts: int


def page_lines(page: str) -> list[Line]:
    """The lines of a page in order."""
    made: list[tuple[str, int, bool, bool]] = []  # text, characters outside links, whether its holder's name speaks against it, whether in an article
    parts: list[str] = []
    loose: list[str] = []  # of the parts, those outside links
    links = 0
    heading = False
    # Each open holder: its name, whether its text is never main text, whether its name speaks against it, whether in an article, whether in comments.
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    open_: Counter[str] = Counter()

    def close() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            free = len(text) if len(loose) == len(parts) else len(" ".join(_html.unescape("".join(loose)).split()))
            if text:
                name, beside, hinted, article, talk = stack[-1]
                if beside and name == "header" and heading and len(stack) > 1 and stack[-2][3] and not talk:
                    beside = False
                if not beside:
                    made.append((text, max(free, 1) if article else free, hinted, article))
                elif not article:
                    made.append(("", 0, hinted, article))
        parts.clear()
        loose.clear()

    def add(text: str) -> None:
        parts.append(text)
        if not links:
            loose.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<":
                add("<")
            continue
        name = name.lower()
        attrs = m[3]
        if not m[1]:
            if name in RAW and not attrs.endswith("/"):
                if name == "head":
                    close()
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if stop is None and name == "head":
                    stop = re.compile(r"(?=<body\b)", re.I).search(page, at)
                if stop is not None or name in ENDLESS or name == "head":
                    at = end if stop is None else stop.end()
                continue
            if name == "a":
                links += 1
            elif name in ("br", "td", "th"):
                add(" ")
            if name in BLOCKS:
                close()
                heading = name in HEADINGS
            if name in HOLDERS:
                words = _named(attrs)
                _, beside, hinted, article, talk = stack[-1]
                talk = talk or bool(words & TALK)
                if name in ("article", "main"):
                    beside, hinted, article = talk, False, not talk
                elif name not in ("body", "html"):
                    beside, hinted = beside or talk or name in ASIDE, hinted or bool(words & HINTS)
                if _HIDDEN.search(attrs):
                    beside = True
                stack.append((name, beside, hinted, article, talk))
                open_[name] += 1
        else:
            if name == "a":
                links = max(0, links - 1)
            elif name in ("td", "th"):
                add(" ")
            if name in BLOCKS:
                close()
                heading = False
            if name in HOLDERS and open_[name]:
                while True:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
                links = 0
    close()
    marked = any(article and text for text, _, _, article in made)
    return [Line(text, length // DOUBT ** (doubts := hinted + (marked and not article)), doubts) for text, length, hinted, article in made]


def between_surge_and_dive(lengths: np.ndarray, window: int, surge: int) -> np.ndarray:
    """True for the lines of a distribution that a surge and a dive enclose."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(window - 1, np.int64), lengths, np.zeros(window - 1, np.int64)]))])
    curve = total[window:] - total[:-window]  # curve[i] sums the window that ends at line i
    alive = np.concatenate([[False], curve > 0, [False]])
    starts, stops = np.flatnonzero(alive[1:] & ~alive[:-1]), np.flatnonzero(alive[:-1] & ~alive[1:])
    kept = np.zeros(n, bool)
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if curve[a:b].max() >= surge:
            kept[a : b - window + 1] = True  # the last window - 1 sums of a run are of windows that end after its last length
    return kept


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The kept lines, joined by two line feeds."""
    if not page:
        return ""
    lines = page_lines(page)
    doubts = np.array([x.doubts for x in lines], np.int64)
    lengths = np.array([x.length for x in lines], np.int64)
    groups = [np.flatnonzero(doubts == d) for d in sorted(set(doubts.tolist()))]
    peak = max((int(np.convolve(lengths[g], np.ones(window, np.int64)).max()) for g in groups), default=0)
    if not peak:
        return ""
    kept = np.zeros(len(lines), bool)
    for g in groups:
        kept[g] = between_surge_and_dive(lengths[g], window, min(surge, peak))
    return "\n\n".join(x.text for x, keep in zip(lines, kept, strict=True) if keep and x.text)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kept = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p.as_py(), window, surge) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(run, schema)
