"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element gives a line. The text lengths of sliding windows of lines
surge where an article begins and dive where it ends; this chooses the region, and every line of it is kept, from
the first to the last of the stretch around it. What elements
and their names say only takes lines out of the count: menus, page headers and footers and reader comments
count as empty, so that any article ends there; adverts, notices, forms and other insertions are cut out, so
that the text around them stands together. A mark of the page (article, main) is a weight: where a marked
element holds at least as much text as the largest stretch outside, the others count as empty and marked
lines weigh more; else the marks are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, struct_array, text_column

WINDOW = 3  # lines summed
SURGE, SHARE = 80, 0.25  # a surge has so many characters, or this share of the page's largest window if less
LINK_SHARE = 0.5  # outside a trusted mark a line with more link text than this counts as empty
MARK_WEIGHT = 4  # of characters inside a trusted mark

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
# Fixed values of HTML: elements without content, with raw content, and that break lines.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas select xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that no article text is in: those that an article ends at, and those that may stand within one.
#: A header inside a marked article is part of it.
EDGES = frozenset("nav footer header menu head search".split())
INSERTS = frozenset("aside form button fieldset dialog".split())
MARKED = frozenset(["article", "main"])
#: Words of class, id and role that name such parts. A name of several words is what its last one says
#: (cookie-notice, but not search-results), after words that say only where or in what it is.
_EDGE_NAMES = re.compile(r"(?:^|[\s_-])(?:comment(?!ary|ator)\w*|disqus\w*|respond|repl(?:y|ies)|discussion|menus?|nav(?:bar|igation)?|breadcrumbs?|(?:site|page|main)?-?footer|masthead|(?:site|page)-header|topbar|contentinfo|pag(?:ination|er))(?:$|[\s_-])", re.I)
_PLACES = r"(?:[\s_-]+(?:\d\w*|\w|left|right|top|bottom|inner|outer|main|primary|secondary|sticky|fixed|small|large|mobile|desktop|box(?:es)?|block|area|wrap(?:per)?|container|content|section|unit|slot|panel|module|bar|list|items?|links?|buttons?|icons?|form|text|title|label|zone|group|row|col(?:umn)?))*"
_INSERT_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookie\w*|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|sidebars?|complementary|share|sharing|newsletter\w*|subscri\w+|sign-?up|login|search|widgets?|toolbar|dialog)" + _PLACES + r"(?=$|\s)", re.I)
#: Elements that end where the next one of a kind begins, or where their parent ends.
_SHORT = frozenset("p li dt dd tr td th option".split())
NOT, CUT, EDGE = 0, 1, 2  # article text may be here; never, and text around it stands together; never, and an article ends here


def _named(attributes: str) -> str:
    return " ".join(next(filter(None, m), "") for m in _NAMED.findall(attributes))


def _part(name: str, attributes: str, marked: int) -> int:
    if name in EDGES:
        return NOT if name == "header" and marked else EDGE
    if name in INSERTS:
        return CUT
    if not attributes or name in ("html", "body", "a", "img") or name in MARKED:
        return NOT
    words = _named(attributes)
    if words and _EDGE_NAMES.search(words):
        return EDGE
    return CUT if _HIDDEN.search(attributes) or words and _INSERT_NAMES.search(words) else NOT


class _Open(list):
    """Names of open elements, with their counts, so that looking for one does not walk through all."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def append(self, name: str) -> None:
        super().append(name)
        self.counts[name] = self.counts.get(name, 0) + 1

    def pop(self) -> str:
        name = super().pop()
        self.counts[name] -= 1
        return name

    def clear(self) -> None:
        super().clear()
        self.counts.clear()

    def __contains__(self, name: str) -> bool:
        return self.counts.get(name, 0) > 0


def lines_of(html: str) -> list[tuple[str, float, int, int]]:
    """Per block its text, share of link text, NOT, CUT or EDGE, and the number from 1 on of the outermost
    marked element that it stands in, 0 if in none."""
    out: list[tuple[str, float, int, int]] = []
    parts: list[str] = []
    linked = total = 0
    opened = _Open()  # open blocks outside of skipped ones
    skip = _Open()  # open elements from the outermost skipped one on
    kind = since = 0  # what the skipped element is, and the number of lines before it
    marked = link = number = 0
    at, n = 0, len(html)

    def end_line() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, linked / max(1, total), kind if skip else NOT, number if marked else 0))
            parts.clear()
            linked = total = 0

    while at < n:
        open_at = html.find("<", at)
        m = _TAG.match(html, open_at) if open_at >= 0 else None
        stop = n if open_at < 0 else open_at if m else open_at + 1
        if stop > at:
            parts.append(html[at:stop])
            size = stop - at
            total += size
            linked += size if link else 0
        if open_at < 0:
            break
        if not m:
            at = stop
            continue
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        closing = bool(m[1])
        if name in BLOCK:
            end_line()
        if name == "a":
            link = 0 if closing else 1
        if closing:
            if name in skip:
                while skip.pop() != name:
                    pass
            elif name in opened:
                if skip:
                    if skip[0] not in _SHORT:
                        # Its own end never came, so only its first line is known to be part of it.
                        out[since + 1 :] = [(text, links, NOT, mark) for text, links, _, mark in out[since + 1 :]]
                    skip.clear()
                while (last := opened.pop()) != name:
                    marked -= last in MARKED
                marked -= name in MARKED
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at) if not m[3].endswith("/") else m
            at = end.end() if end else n
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        if name in VOID or m[3].endswith("/"):
            continue
        if skip and len(skip) == 1 and (skip[0] == "p" and name in BLOCK or skip[0] in _SHORT and name == skip[0]):
            skip.clear()
        if skip:
            if name == skip[0] or name in BLOCK and name not in _SHORT:
                skip.append(name)
            continue
        if part := _part(name, m[3], marked):
            end_line()
            skip.append(name)
            kind, since = part, len(out)
            continue
        if name in BLOCK and name not in _SHORT:
            opened.append(name)
        if name in MARKED:
            number += not marked
            marked += 1
    end_line()
    return out


def runs_of(sizes: list[int]) -> list[tuple[int, int]]:
    """Stretches of lines that are not empty."""
    runs, begin = [], None
    for i, size in enumerate([*sizes, 0]):
        if size and begin is None:
            begin = i
        elif not size and begin is not None:
            runs.append((begin, i))
            begin = None
    return runs


def trusted(lines: list[tuple[str, float, int, int]], sizes: list[int]) -> bool:
    """Whether one marked element holds at least as many characters as the largest stretch outside of any."""
    held: dict[int, int] = {}
    for text, _, never, mark in lines:
        if mark and not never:
            held[mark] = held.get(mark, 0) + len(text)
    outside = [0 if line[3] else size for line, size in zip(lines, sizes, strict=True)]
    return bool(held) and max(held.values()) >= max((sum(outside[a:b]) for a, b in runs_of(outside)), default=0)


def main_text(html: str) -> str:
    """The article's blocks, joined by line breaks; empty if there is none."""
    lines = [line for line in lines_of(html) if line[2] != CUT]
    sizes = [0 if never or links > LINK_SHARE else len(text) for text, links, never, _ in lines]
    if trusted(lines, sizes):
        # What is never article text does not end a marked article, it is cut out of it.
        lines = [line for line in lines if not (line[2] and line[3])]
        sizes = [MARK_WEIGHT * len(text) if mark else 0 for text, _, _, mark in lines]
    if not any(sizes):
        return ""
    # A window looks ahead from its line and stops at an empty one, where any article dives.
    runs = runs_of(sizes)
    windows = {k: sum(sizes[k : min(k + WINDOW, b)]) for a, b in runs for k in range(a, b)}
    least = min(SURGE, SHARE * max(windows.values()))
    # A stretch in which text surges is kept from end to end, headings before the surge and short lines behind the dive too.
    return "\n".join(lines[k][0] for a, b in runs if any(windows[k] >= least for k in range(a, b)) for k in range(a, b))


_EXTRACTED = "text string, n_chars long"


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns in keep, text (empty if none) and n_chars, its code points. Null html is empty; a very
    long page is read whole, in one pass; markup cut short is closed at the end; windows of equal size count
    alike. Repeated rows give repeated results; an empty table gives an empty one; a column in keep that is
    named like an added one is replaced."""

    def judge(_: np.ndarray, __: np.ndarray, pages: pa.Array) -> pa.Array:
        texts = [main_text(v.as_py() or "") for v in pages]
        return struct_array({"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return beside(pages, keep, text_column(F.col(html), _EXTRACTED, lambda: judge), _EXTRACTED)
