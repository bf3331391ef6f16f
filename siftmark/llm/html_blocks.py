"""Leaf blocks of an HTML page, with what stands above them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape

# Elements that begin and end a block, have no end tag, or hold no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe title textarea noembed noframes xmp svg audio video canvas".split())
# An opening tag ends an open one of these, unless one of the others is nearer.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Frame:
    tag: str
    names: frozenset  # features of this element and all above


@dataclass(slots=True)
class Block:
    text: str
    frame: Frame  # where it begins
    own: str  # nearest block element
    linked: int  # characters in links


_ROOT = Frame("", frozenset())
#: The feature of what stands in any element with a class, an id or a role.
NAMED = "named"


def _features(tag: str, attributes: str) -> Iterable[str]:
    yield f"t:{tag}"
    if attributes:
        for m in _NAMED.finditer(attributes):
            for word in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()):
                if word:
                    yield f"c:{word}"
                    yield NAMED


def blocks(html: str) -> list[Block]:
    """Texts between block boundaries in page order, character references decoded, white space made one space; empty ones left out.

    Linear in the page: a tag cut off by the end of the page is dropped, an
    end tag without an open element is ignored, and what SKIPPED elements
    hold is passed over.
    """
    out: list[Block] = []
    stack, open_tags = [_ROOT], Counter()
    parts: list[str] = []
    frame, linked, in_link, at = _ROOT, 0, 0, 0
    own = [""]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, frame, own[-1], linked))
        linked = 0

    def pop() -> None:
        nonlocal in_link
        tag = stack.pop().tag
        open_tags[tag] -= 1
        if tag == "a":
            in_link -= 1
        if tag in BLOCKS:
            own.pop()

    def end(tag: str) -> None:
        while True:
            last = stack[-1].tag
            pop()
            if last == tag:
                return

    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else n
        if stop > at:
            raw = html[at:stop]
            text = unescape(raw) if "&" in raw else raw
            if not parts:
                frame = stack[-1]
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if open_tags[tag] > 0:
                end(tag)
            continue
        if tag in SKIPPED:
            if not m[3].rstrip().endswith("/") or tag != "svg":
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = close.end() if close else n
            continue
        if tag in BLOCKS:
            flush()
            if tag != "option" and open_tags["p"] > 0:
                end("p")
            if tag in CLOSES:
                these, nearer = CLOSES[tag]
                if any(open_tags[t] > 0 for t in these):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].tag in these:
                            while len(stack) > depth:
                                pop()
                            if tag != "tr":
                                break
                        elif stack[depth].tag in nearer:
                            break
        elif tag == "br":
            parts.append(" ")
            if len(parts) == 1:
                frame = stack[-1]
        if tag not in VOID:
            top = stack[-1].names
            stack.append(Frame(tag, top.union(_features(tag, m[3]))))
            open_tags[tag] += 1
            if tag == "a":
                in_link += 1
            if tag in BLOCKS:
                own.append(tag)
    flush()
    return out
