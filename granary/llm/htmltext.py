"""Main text of web pages by line-block distribution.

Markup is stripped into lines (the blocks of the page, in page order).  A line weighs the characters it has outside of links;
boilerplate weighs nothing and leaves a gap.  Weights are summed over a sliding window of ``WINDOW`` lines: text surges where
the sum reaches ``SURGE`` (or the page's peak, if that is lower) and dives where it falls to nothing.  What is kept is decided
by these surges alone, on every page:

* Lines are weighed in segments, which end at gaps and where the container (such as a div) or the mark changes.
* A mark (article, main, role=main, itemprop=articleBody) multiplies the page's peak within it by ``MARK``: if that is still
  above the peak outside, only marked text is looked at, of articles if one of them surges.  A mark with a surge is kept as a
  whole, and so is the container of a surging segment, however short its other blocks; of text that stands in the
  body itself only the lines from surge to dive are.
* Elements that by name, role or class look like boilerplate are no lines.  Class words count on containers alone, never on a
  paragraph.  A form or such a class that holds most of the page's text, while nothing surges outside, is layout and its text counts.

Defined results: null or empty html gives an empty text, as does a page of boilerplate; unclosed elements end with their parent
or the page; truncated tags are no text; character references are decoded as HTML does, an unknown one stays; repeated rows
are kept; time and memory are linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame


WINDOW, SURGE, MARK = 3, 80, 8
#: Fixed values of HTML: elements without text of their own, elements that never close, elements that stand as blocks.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button datalist map".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold other blocks of a text, and those of them that hold all of a page.
CONTAINERS, ROOTS = frozenset("article body center div html main section".split()), frozenset("body html".split())
REPEATING = frozenset("p li dt dd option tr td th".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose class and id are looked at, and the words that mark what is no article.
CLASSED = frozenset("div section ul ol dl table article header center details fieldset figure".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments respond disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup related recommended share sharing social widget toolbar pagination pager skip copyright".split()
)
#: Words that may follow such a word in a name: ad-slot is an advert, ad-hoc is none.
PLACES = frozenset("area bar block bottom box buttons col column container content form group holder inner item items left links list main module outer panel right row section slot text top unit wrap wrapper zone".split())
#: A class such as has-sidebar tells of a part elsewhere; of an article's own class only these count.
PREFIXES = frozenset("has with no without is js".split())
ARTICLE_MARKS = frozenset("comment comments related ad ads advert sponsored promo".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?=[A-Za-z/])[^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z]+")
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b")


class Line(NamedTuple):
    text: str
    plain: int  #: characters outside of links
    suspects: tuple[int, ...]  #: elements around it that look like boilerplate, by where they begin
    mark: tuple[int, int] | None  #: 3 for an article, 2 for a main part, 1 for an article's body; and where it begins
    home: tuple[str, int]  #: the innermost container and where it begins


class _Open(NamedTuple):
    name: str
    silent: bool
    suspects: tuple[int, ...]
    mark: tuple[int, int] | None
    home: tuple[str, int]
    linked: bool
    blocks: int  #: open blocks up to here


_NONE = _Open("", False, (), None, ("html", -1), False, 0)


def _suspect(name: str, attrs: str, marked: bool) -> bool:
    """Whether an element looks like boilerplate by its name, role, class or id."""
    if name in BOILERPLATE or name == "header" and not marked:
        return True
    if "=" not in attrs or name not in BLOCKS:
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    if name not in CLASSED:
        return False
    marks = ARTICLE_MARKS if name == "article" else MARKS
    for own in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [x for x in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", own).lower()) if x]
        if parts and parts[0] not in PREFIXES and (parts[-1] in marks or parts[0] in marks and all(x in PLACES for x in parts[1:])):
            return True
    return False


def _mark(name: str, attrs: str, at: int) -> tuple[int, int] | None:
    if name == "article":
        return 3, at
    if name == "main" or "main" in attrs and _MAIN.search(attrs):
        return 2, at
    return (1, at) if "articleBody" in attrs else None


def lines(page: str) -> tuple[list[Line], set[int]]:
    """The blocks of a page in order, and the suspects that may be layout."""
    out: list[Line] = []
    block: list[str] = []
    links: list[str] = []
    stack: list[_Open] = [_NONE]
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
    layout: set[int] = set()

    def end() -> None:
        text = " ".join(entities.unescape("".join(block)).split())
        if text:
            own = stack[-1]
            linked = len(" ".join(entities.unescape("".join(links)).split())) if links else 0
            out.append(Line(text, max(0, len(text) - linked), own.suspects, own.mark, own.home))
        block.clear()
        links.clear()

    def close(k: int) -> None:
        for o in stack[k:]:
            where[o.name].pop()
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        own = stack[-1]
        if not own.silent:
            part = page[at : m.start() if m else size]
            block.append(part)
            if own.linked:
                links.append(part)
        if not m:
            break
        begin, at = m.start(), m.end()
        name, attrs = (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            continue
        if m.group(1):
            k = where[name][-1] if where[name] else 0
            # an inline or paragraph end never closes blocks around it
            if k and (name in BLOCKS and name != "p" or name in SILENT or stack[-1].blocks == stack[k].blocks):
                if name in BLOCKS and not own.silent:
                    end()
                close(k)
            elif name in BLOCKS and not own.silent:
                end()
            elif name == "br":
                block.append(" ")
            continue
        if name in RAW:
            shut = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else size
            continue
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCKS and name not in SILENT:
            if name == "br" and not own.silent:
                block.append(" ")
            elif name in BLOCKS and not own.silent:
                end()
            continue
        mark = _mark(name, attrs, begin)
        if name in BLOCKS and not own.silent:
            end()
        if mark and own.suspects and not own.mark and name in ("article", "main"):
            # boilerplate that was never closed ends where the article begins; a form may hold all of a page
            k = next((i for i, o in enumerate(stack) if o.suspects and o.name != "form" and o.suspects != stack[i - 1].suspects), 0)
            if k:
                close(k)
        if name in REPEATING and stack[-1].name == name:
            close(len(stack) - 1)
        own = stack[-1]
        suspects = own.suspects
        if not own.silent and _suspect(name, attrs, own.mark is not None):
            suspects = (*suspects, begin)
            if name == "form" or name not in BOILERPLATE and name != "header" and "role" not in attrs and "aria-hidden" not in attrs:
                layout.add(begin)
        if mark and own.mark and own.mark[0] >= mark[0]:
            mark = None
        home = (name, begin) if name in CONTAINERS else own.home
        where[name].append(len(stack))
        stack.append(_Open(name, own.silent or name in SILENT, suspects, mark or own.mark, home, own.linked or name == "a", own.blocks + (name in BLOCKS)))
    end()
    return out, layout


def spans(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Half-open runs of lines from a surge to its dive.

    The block of line i sums the weights of the lines i to i + window - 1.  A run begins with the first line that weighs
    anything in a block of at least ``surge``, and ends after the last such line before a block that weighs nothing.
    """
    total = [0, *accumulate(weights)]
    n = len(weights)
    sums = [total[min(i + window, n)] - total[i] for i in range(n)]
    found, i = [], 0
    while i < n:
        if sums[i] < surge or not sums[i]:
            i += 1
            continue
        a = next(k for k in range(i, n) if weights[k])
        z = next((k for k in range(a, n) if not sums[k]), n)
        i = z
        while not weights[z - 1]:
            z -= 1
        found.append((a, z))
    return found


def _segments(own: list[Line], weights: list[int], gone: list[bool]) -> list[tuple[int, int]]:
    """Runs of lines that no gap, other mark or other container parts."""
    out, a = [], 0
    for i in range(1, len(own) + 1):
        if i == len(own) or gone[i] != gone[a] or own[i].mark != own[a].mark or own[i].home != own[a].home:
            if not gone[a]:
                out.append((a, i))
            a = i
    return out


def _peak(weights: list[int], segments: list[tuple[int, int]]) -> int:
    return max((sum(weights[i : min(i + WINDOW, z)]) for a, z in segments for i in range(a, z)), default=0)


def _boilerplate(own: list[Line], layout: set[int]) -> list[bool]:
    """Which lines are boilerplate: suspects that hold most of a page on which nothing else surges are cleared, outermost first."""
    cleared: set[int] = set()
    total = sum(x.plain for x in own)
    while True:
        gone = [any(s not in cleared for s in x.suspects) for x in own]
        weights = [x.plain for x in own]
        segments = _segments(own, weights, gone)
        if _peak(weights, segments) >= SURGE or any(own[a].mark for a, _ in segments):
            return gone
        mass: dict[int, int] = defaultdict(int)
        for x in own:
            first = next((s for s in x.suspects if s not in cleared), None)
            if first in layout:
                mass[first] += x.plain
        most = max(mass, key=lambda s: mass[s], default=None)
        if most is None or 2 * mass[most] <= total:
            return gone
        cleared.add(most)


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line feeds."""
    if not page:
        return ""
    own, layout = lines(page)
    gone = _boilerplate(own, layout)
    # links within a mark are part of the text; on a page of links alone they are all there is
    weights = [0 if g else len(x.text) if x.mark else x.plain for x, g in zip(own, gone, strict=True)]
    if not any(weights):
        weights = [0 if g else len(x.text) for x, g in zip(own, gone, strict=True)]
    segments = _segments(own, weights, gone)
    marked, open_ = ([s for s in segments if (own[s[0]].mark is not None) == m] for m in (True, False))
    inside, outside = _peak(weights, marked), _peak(weights, open_)
    chosen, peak = (marked, inside) if inside and inside * MARK >= outside else (segments, max(inside, outside))
    if not peak:
        return ""
    runs = [(a + i, a + j) for a, z in chosen for i, j in spans(weights[a:z], surge=min(SURGE, peak))]
    kept = {i for a, z in runs for i in range(a, z)}
    if chosen is marked:
        best = max(own[a].mark[0] for a, _ in runs)
        marks = {own[a].mark for a, _ in runs if own[a].mark[0] == best}
        return "\n".join(x.text for x, g in zip(own, gone, strict=True) if not g and x.mark in marks)
    homes = {own[a].home for a, _ in runs if own[a].home[0] not in ROOTS}
    return "\n".join(x.text for i, (x, g) in enumerate(zip(own, gone, strict=True)) if not g and (i in kept or x.home in homes))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; no shuffle."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h if isinstance(h, str) else None) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": list(map(len, texts))})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars bigint")
