"""Blocks of text in an HTML page, and where in the page they stand: what page differencing works on.

A tolerant reader for tag soup: unclosed paragraphs, items and inline elements, stray end tags, cut-off pages, unquoted attributes. A block is the
text between two block-level boundaries; `<br>` is white space within one. Each block has a kind:

- ARTICLE: inside an `<article>`, or on a page without one inside `<main>` (or what is marked as such)
- MAIN: inside `<main>` but outside the article
- FURNITURE: inside an element that HTML's vocabulary, a role or a class or id names as menu, header, footer, sidebar, notice, advert, form or comments
- OPEN: anywhere else
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator, Set
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import accumulate
from typing import NamedTuple

import xxhash

ARTICLE, MAIN, FURNITURE, OPEN = "amfo"

_TOKEN = re.compile(
    r"<!--(?:.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Attributes that say what an element is.
_TELLING = re.compile("class|id|role|hidden|style|itemprop", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text ends at their own end tag only.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An element that starts closes an open one of these, up to the elements after the bar.
_CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_NONE, _PARAGRAPH = frozenset(), frozenset({"p"})
_FURNITURE_TAGS = frozenset("nav footer aside menu dialog button select option svg canvas object template search audio video datalist".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or an id that name furniture, and beginnings of such words.
_FURNITURE_WORDS = frozenset("ad ads notice notices newsletter popup modal disqus respond reply replies related share sharing social pagination pager signup alert skip teaser teasers".split())
_FURNITURE_STEMS = ("advert", "sponsor", "promo", "breadcrumb", "comment", "recommend", "subscri")
#: The same, where a page's wrapper is often named after what it holds beside the article: an article or main within it counts.
_WRAPPER_WORDS = frozenset("banner consent gdpr overlay paywall menu menus nav navbar navigation footer masthead topbar toolbar widget widgets search login".split())
_WRAPPER_STEMS = ("cookie", "sidebar")


@dataclass(frozen=True)
class Block:
    text: str
    kind: str
    #: A number for the names and classes of the elements around the block: the slot of the page that it fills.
    slot: int


class _Open(NamedTuple):
    """An open element: its tag, whether furniture is around that holds no article (hard) or may (soft), and the containers it is in."""

    tag: str
    hard: bool
    soft: bool
    article: bool
    main: bool
    slot: int


@lru_cache(1 << 14)
def _enter(tag: str, raw: str, above: _Open) -> _Open:
    """The element `tag` with these attributes, within another; templates repeat, so most are known."""
    attributes: dict[str, str] = {}
    if raw:
        for name, *values in _ATTRIBUTE.findall(raw):
            attributes.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    role = attributes.get("role", "").lower()
    words = [] if tag in ("html", "body") else [w.lower() for key in ("class", "id") for w in _WORD.findall(attributes.get(key, ""))]
    hidden = "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    named = any(w in _FURNITURE_WORDS or w.startswith(_FURNITURE_STEMS) for w in words)
    article = tag == "article" or attributes.get("itemprop", "").lower() == "articlebody"
    main = tag == "main" or role == "main"
    outside = not (above.article or above.main)
    wraps = tag == "form" or any(w in _WRAPPER_WORDS or w.startswith(_WRAPPER_STEMS) for w in words) or outside and (tag == "header" or "header" in words)
    hard = above.hard or hidden or named or tag in _FURNITURE_TAGS or role in _FURNITURE_ROLES
    soft = (above.soft or wraps) and not (article or main)
    slot = xxhash.xxh64_intdigest(f"{above.slot} {tag} {attributes.get('class', '')}".encode("utf-8", "replace"))
    return _Open(tag, hard, soft, above.article or article, above.main or main, slot)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in their order, without empty ones; scripts, styles, comments and the title have none."""
    page = page or ""
    stack = [_Open("", False, False, False, False, 0)]
    still_open: dict[str, int] = defaultdict(int)
    found: list[tuple[str, _Open]] = []
    pieces: list[tuple[str, _Open]] = []
    end, search = 0, _TOKEN.search

    def flush() -> None:
        # inline furniture within a block is a block of its own
        parted = len(pieces) > 1 and len({x.hard or x.soft for _, x in pieces}) > 1
        for part in [[p for p in pieces if (p[1].hard or p[1].soft) == f] for f in (False, True)] if parted else [pieces]:
            text = "".join([t for t, _ in part])
            words = (html.unescape(text) if "&" in text else text).split()
            if words:
                found.append((" ".join(words), part[0][1]))
        pieces.clear()

    def close(tags: Set[str], up_to: Set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for x in stack[i:]:
                    still_open[x.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in up_to:
                return

    while (token := search(page, end)) is not None:
        start = token.start()
        if start > end:
            pieces.append((page[end:start], stack[-1]))
        end = token.end()
        closing, tag, raw = token.group(1, 2, 3)
        if not tag:
            continue
        tag = tag.lower()
        block = tag in _BLOCK
        if pieces:
            if block:
                flush()
            elif tag == "br":
                pieces.append((" ", stack[-1]))
        if closing:
            if still_open[tag]:
                close({tag}, _NONE if block else _BLOCK)
            continue
        if tag in _RAW:
            stop = _ends(tag).search(page, end)
            end = stop.end() if stop else len(page)
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES:
            if any(still_open[t] for t in _CLOSES[tag][0]):
                close(*_CLOSES[tag])
        elif block and still_open["p"]:
            close(_PARAGRAPH, _BLOCK)
        stack.append(_enter(tag, raw if raw and _TELLING.search(raw) else "", stack[-1]))
        still_open[tag] += 1
    if end < len(page):
        pieces.append((page[end:], stack[-1]))
    flush()
    any_article = any(x.article and not (x.hard or x.soft) for _, x in found)

    def kind(x: _Open) -> str:
        if x.hard or x.soft:
            return FURNITURE
        if x.article if any_article else x.main:
            return ARTICLE
        return MAIN if x.main else OPEN

    return [Block(text, kind(x), x.slot) for text, x in found]


@cache
def _ends(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE)


def _columns(rows: list[int], columns: list[int]) -> Iterator[int]:
    """The bit rows of the longest common subsequence of two sequences (Hyyrö): row i has a zero bit for each column where prefix i's length steps up."""
    match: dict[int, int] = {}
    for j, c in enumerate(columns):
        match[c] = match.get(c, 0) | 1 << j
    full = now = (1 << len(columns)) - 1
    for r in rows:
        u = now & match.get(r, 0)
        now = ((now + u) | (now - u)) & full
        yield now


def _lengths(rows: list[int], columns: list[int]) -> list[int]:
    """The length of the longest common subsequence of `rows` with each prefix of `columns`."""
    last = 0
    for last in _columns(rows, columns):
        pass
    return [0, *accumulate(1 - (last >> j & 1) for j in range(len(columns)))]


#: Bits of the table kept for one alignment; longer sequences are halved first.
TABLE_BITS = 1 << 28


def _align(a: list[int], b: list[int], offset: int, out: list[int]) -> None:
    """Append the positions of `a` (plus offset) that a longest common subsequence with `b` uses."""
    if not a or not b:
        return
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half, width = len(a) // 2, len(b)
        head, tail = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(width + 1), key=lambda j: head[j] + tail[width - j])
        _align(a[:half], b[:cut], offset, out)
        _align(a[half:], b[cut:], offset + half, out)
        return
    table = list(_columns(a, b))
    row, col, mine = len(a), len(b), []
    while row and col:
        if table[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or table[row - 1] >> (col - 1) & 1:
                col -= 1
                mine.append(offset + row)
    out += reversed(mine)


def aligned(a: list[int], b: list[int]) -> list[int]:
    """The positions of `a` in a longest common subsequence of `a` and `b`, ascending."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[len(a) - 1 - stop] == b[len(b) - 1 - stop]:
        stop += 1
    inner_b = b[start : len(b) - stop]
    known_b = set(inner_b)
    places = [i for i in range(start, len(a) - stop) if a[i] in known_b]
    inner_a = [a[i] for i in places]
    known_a = set(inner_a)
    middle: list[int] = []
    _align(inner_a, [x for x in inner_b if x in known_a], 0, middle)
    return [*range(start), *[places[i] for i in middle], *range(len(a) - stop, len(a))]
