"""Operator 10, HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of the page, and regions that are never content (menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, comments of readers) are left out, but
not a wrapper with such a name that holds the page's article. The text lengths of the lines are summed over sliding windows. The distribution surges where the
main text begins and dives where it ends; of all spans between a surge and its dive the one with most text is
kept, joined with those that are mostly in the same container and with neighbours over a small gap, since three short lines
(of a list, of dialogue) end a span. The ends take in the container's short lines. Where an article or main element holds most of the span, only the span's ends are moved to it: outward by at
most as much text as the span has, inward by the short lines that a window reaches beyond the text.

Defined results: a null or empty page gives an empty text. A page without content lines gives an
empty text. Repeated rows give repeated results, an empty table an empty one. Unclosed and stray
tags are tolerated. Other columns pass through; text and n_chars are replaced if there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .staging import small_batches

WINDOW = 3
#: A window with this many code points begins a surge; one below it for a whole window ends in a dive.
SURGE = 40
#: Neighbouring spans are one when the text between them is at most this share of that on either side.
GAP = 0.1

#: Comments, declarations and tags. A quoted value follows an equals sign; what is not closed runs to the end, so that no part is looked at twice.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>=]++|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|hidden|style|type|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
_RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
_DROPPED = set("nav footer aside form head script style noscript template svg canvas iframe object select button dialog menu textarea datalist video audio map math".split())
_CLOSES_P = _BLOCK - {"br"}
_ROOTS = {"article", "main"}
#: Words in class, id or role that mark a region outside the main text.
_OUTSIDE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb"
    " breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login search comment comments disqus reply replies respond discussion share sharing social related recommended"
    " recommendations widget pagination pager paging complementary contentinfo toc copyright legal disclaimer outbrain taboola skip hidden"
    " form rail tags teaser".split()
)
#: Words that mark a region as main text whatever else its names hold.
_INSIDE = set("article content main post entry story body articlebody".split())
_WORDS = re.compile(r"[a-z]+", re.I)


#: Words that begin or end a name which tells the state of a page or wrapper, not what it is: has-sidebar, comments-open.
_STATE_FIRST, _STATE_LAST = {"has", "no", "not", "with", "without"}, {"open", "opened", "closed", "enabled", "disabled"}
_LAYOUT = {"sidebar", "nav", "menu", "footer"}
_STRONG = {"comment", "comments", "sidebar", "ad", "ads", "advert", "nav", "menu", "footer", "related", "share", "newsletter", "cookie"}
#: Elements left out that are kept after all when they hold the page's article.
_WRAPPERS = {"form", "header", "aside"}
KEPT, GONE, NAMED, WRAPS = range(4)


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]


def _outside(name: str, attributes: str, in_root: bool) -> int:
    """KEPT; GONE: never content; NAMED: the element's own name is that of a region outside; WRAPS: left out unless it holds the article."""
    if name in ("html", "body", "main"):
        return KEPT
    if name in _DROPPED and name not in _WRAPPERS:
        return GONE
    verdict = WRAPS if name in ("form", "aside") or name == "header" and not in_root else KEPT
    if not attributes or name == "article" and "comment" not in attributes.lower():
        return verdict
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return GONE
        if key in ("class", "id", "role", "aria-label"):
            whole = [_words(x) for x in (m[2] or m[3] or m[4] or "").split()]
            whole = [x for x in whole if x and not (len(x) > 1 and (x[0] in _STATE_FIRST or x[-1] in _STATE_LAST))]
            named = {w for x in whole for w in x}
            inside = named & _INSIDE
            if not inside and (named & _STRONG - _LAYOUT or any(len(x) == 1 and x[0] in _LAYOUT for x in whole)):
                verdict = NAMED
            elif verdict == KEPT and (named & _STRONG or named & _OUTSIDE and not inside):
                verdict = WRAPS
    return verdict


def lines_of(page: str) -> tuple[list[tuple[str, int]], list[str], list[int]]:
    """The page's content lines with the number of the element that each is in; the elements' names and parents by number, 0 being the page."""
    found: list[tuple[int, list[tuple[str, int]]]] = []  # element, pieces of text with the region that each is in
    text: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, dropped, number
    names, parents = [""], [0]
    regions: dict[int, int] = {}  # elements left out unless they hold the article, with their verdict
    region = [0]  # the innermost region that each element is in or is
    dropped, roots, at = 0, 0, 0
    opened: Counter[str] = Counter()  # how many elements of a name are on the stack

    def add(piece: str) -> None:
        text.append((piece, region[stack[-1][2]] if stack else 0))

    def flush() -> None:
        if text:
            found.append((stack[-1][2] if stack else 0, text.copy()))
            text.clear()

    def pop() -> None:
        nonlocal dropped, roots
        name, was, _ = stack.pop()
        opened[name] -= 1
        roots -= name in _ROOTS and not dropped
        dropped -= was

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            if not dropped:
                add(page[at:])
            break
        if m.start() > at and not dropped:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not dropped:
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if name in _BLOCK:
            flush()
        if m[1]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _CLOSES_P and stack:
            near = [i for i in range(len(stack) - 1, max(-1, len(stack) - 12), -1) if stack[i][0] == "p"]
            if near and all(s[0] not in _BLOCK for s in stack[near[0] + 1 :]):
                while len(stack) > near[0]:
                    pop()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            pop()
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in _VOID or m[3].rstrip().endswith("/") and name not in _BLOCK:
            continue
        verdict = _outside(name, m[3], roots > 0)
        drop = verdict == GONE
        parents.append(stack[-1][2] if stack else 0)
        region.append(region[parents[-1]])
        if verdict in (NAMED, WRAPS) and not dropped:
            region[-1] = len(names)
            regions[len(names)] = verdict
        names.append("" if drop or dropped else name)  # an article in what is gone is none
        stack.append((name, drop, len(names) - 1))
        opened[name] += 1
        dropped += drop
        roots += name in _ROOTS and not dropped
    flush()
    gone = _left_out(found, names, parents, regions, region) if regions else set()
    out = []
    for element, pieces in found:
        line = " ".join(html.unescape("".join(x for x, r in pieces if r not in gone)).split())
        if line:
            out.append((line, element))
    return out, names, parents


def _left_out(found: list[tuple[int, list[tuple[str, int]]]], names: list[str], parents: list[int], regions: dict[int, int], region: list[int]) -> set[int]:
    """The regions whose text is left out: all but those that hold the page's article, and all inside one that is left out.

    A region holds it that has the main element, or the only article elements, or most of the page's text and, if there is another article,
    an article too. One that is named as a region has to have the main element, or the only articles with no text of any length elsewhere.
    """
    size = [0] * len(parents)  # text of each region itself, then with the regions in it
    for _, pieces in found:
        for x, r in pieces:
            size[r] += len(" ".join(x.split()))
    free, total = size[0], sum(size)
    within = {e: region[parents[e]] for e in regions}
    held: dict[int, set[str]] = {}
    for e, name in enumerate(names):
        if name in _ROOTS and e not in regions:
            held.setdefault(region[e], set()).add(name)
    free_root = 0 in held
    for e in reversed(regions):
        if regions[e] != NAMED:
            held.setdefault(within[e], set()).update(held.get(e, ()))
        elif "main" in held.get(e, ()):
            held.setdefault(within[e], set()).add("main")
        size[within[e]] += size[e] if within[e] else 0
    gone: set[int] = set()
    for e in regions:
        marks = held.get(e, set())
        if regions[e] == NAMED:
            holds = "main" in marks or "article" in marks and not free_root and free < SURGE
        else:
            holds = "main" in marks or "article" in marks and not free_root or 2 * size[e] > total and (not free_root or "article" in marks)
        if within[e] in gone or not holds:
            gone.add(e)
    return gone


def _spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The surges, their dives (one past the last line), and the text before each line and in all."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    block = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], block >= SURGE, [False]]).astype(np.int8)))
    return edge[::2], np.minimum(edge[1::2] + WINDOW - 1, n), total


def main_span(lengths: np.ndarray) -> tuple[int, int]:
    """First and last + 1 of the lines between the surge and the dive with most text between them."""
    n = len(lengths)
    if not n:
        return 0, 0
    surges, dives, total = _spans(lengths)
    if not len(surges):
        return 0, n
    k = int(np.argmax(total[dives] - total[surges]))
    return int(surges[k]), int(dives[k])


def _joined(a: int, b: int, lengths: np.ndarray, inside: np.ndarray) -> tuple[int, int]:
    """The span (a, b) with the other spans that are mostly in the same container, and their neighbours over a small gap.

    ``inside`` tells which lines are in the container. A gap is small when its text is at most GAP of that on either side.
    """
    surges, dives, total = _spans(lengths)
    own = np.concatenate([[0], np.cumsum(lengths * inside)])
    same = 2 * (own[dives] - own[surges]) > total[dives] - total[surges]
    if same.any():
        a, b = min(a, int(surges[same][0])), max(b, int(dives[same][-1]))

    def near(low: int, high: int, mass: int) -> bool:
        return total[high] - total[low] <= GAP * min(mass, total[b] - total[a])

    k = int(np.searchsorted(surges, a)) - 1
    while k >= 0 and near(dives[k], a, total[min(dives[k], a)] - total[surges[k]]):
        a = int(surges[k])
        k -= 1
    k = int(np.searchsorted(dives, b, "right"))
    while k < len(surges) and near(b, surges[k], total[dives[k]] - total[max(surges[k], b)]):
        b = int(dives[k])
        k += 1
    return a, b


def _container(span: list[tuple[str, int]], names: list[str], parents: list[int]) -> int:
    """The innermost element with most of the span's text that has more than one block of text of the span."""
    mass = _masses(span, parents)
    e = max(e for e in range(len(parents)) if 2 * mass[e] > mass[0])
    block = [0] * len(parents)  # the nearest block of each element
    for at in range(1, len(parents)):
        block[at] = at if names[at] in _BLOCK else block[parents[at]]
    count = [0] * len(parents)
    for at in {block[x] for _, x in span}:
        count[at] = 1
    for at in range(len(parents) - 1, 0, -1):
        count[parents[at]] += count[at]
    while e and (count[e] < 2 or names[e] not in _BLOCK):
        e = parents[e]
    return e


def _masses(lines: list[tuple[str, int]], parents: list[int]) -> list[int]:
    """The text of the lines inside each element."""
    mass = [0] * len(parents)
    for line, element in lines:
        mass[element] += len(line)
    for e in range(len(parents) - 1, 0, -1):
        mass[parents[e]] += mass[e]
    return mass


def _inside(element: int, parents: list[int]) -> list[bool]:
    """Which elements are the given one or in it."""
    inside = [False] * len(parents)
    inside[element] = True
    for e in range(element + 1, len(parents)):
        inside[e] = inside[parents[e]]
    return inside


def _widened(a: int, b: int, lines: list[tuple[str, int]], inside: list[bool]) -> tuple[int, int]:
    """The span with the lines next to it that are inside, on either side as much text as the span has at most."""
    most = sum(len(x) for x, _ in lines[a:b])
    left = right = most
    while a and inside[lines[a - 1][1]] and len(lines[a - 1][0]) <= left:
        a -= 1
        left -= len(lines[a][0])
    while b < len(lines) and inside[lines[b][1]] and len(lines[b][0]) <= right:
        right -= len(lines[b][0])
        b += 1
    return a, b


def _narrowed(a: int, b: int, lines: list[tuple[str, int]], inside: list[bool]) -> tuple[int, int]:
    """The span without the short lines outside that the windows at its ends reach."""
    for _ in range(WINDOW - 1):
        if not inside[lines[a][1]] and len(lines[a][0]) < SURGE:
            a += 1
        if not inside[lines[b - 1][1]] and len(lines[b - 1][0]) < SURGE:
            b -= 1
    return a, b


def extract(page: str | None) -> str:
    """The main text of one page."""
    lines, names, parents = lines_of(page or "")
    if not lines:
        return ""
    lengths = np.array([len(x) for x, _ in lines])
    a, b = main_span(lengths)
    container = _container(lines[a:b], names, parents)
    inside = _inside(container, parents)
    a, b = _joined(a, b, lengths, np.array([inside[e] for _, e in lines]))
    if names[container] not in ("", "html", "body"):
        a, b = _widened(a, b, lines, inside)
    mass = _masses(lines[a:b], parents)
    marks = [e for e, name in enumerate(names) if name in _ROOTS and 2 * mass[e] > mass[0]]  # each in the one before
    if marks:
        a, b = _narrowed(a, b, lines, _inside(marks[0], parents))
        a, b = _widened(a, b, lines, _inside(marks[-1], parents))
    return "\n".join(line for line, _ in lines[a:b])


def extract_pages(pages: DataFrame, markup: str = "html") -> DataFrame:
    """``pages`` without ``markup``, with text and n_chars."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != markup and c.lower() not in {"text", "n_chars"}]
    schema = StructType([*(pages.schema[c] for c in kept), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(markup)
            for a in range(0, batch.num_rows, 256):
                texts = [extract(x.as_py()) for x in column.slice(a, 256)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, 256) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    [*kept, "text", "n_chars"],
                )

    return pages.select(*kept, markup).mapInArrow(run, schema)
