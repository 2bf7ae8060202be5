"""Token stream of one page (small per-row helper): tags that shape the page, and texts with their paths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import xxhash

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
MATH = frozenset("math menclose mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable "
                 "mtd mtext mtr munder munderover semantics".split())
#: Elements whose content is characters up to their closing tag, and is no page text.
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
#: Elements whose content is markup but no page text.
INERT = frozenset("svg template select".split())
#: An opening tag that ends open elements of these names, up to the nearest of the given borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
          "body": ({"head"}, {"html"})}

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>|[!?/][^>]*+>)")
#: One attribute: its whole name, and its value if it has one, so that neither longer names nor values are read as names.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARKS = frozenset("class id role hidden".split())
_DIGITS = re.compile(r"\d+")
_NOTHING: tuple[set[str], set[str]] = (set(), set())


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def component(name: str, attributes: str) -> str:
    """Name of an element with its class, id and role, numbers folded."""
    if not attributes:
        return name
    marks: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in _MARKS and key not in marks:  # of repeated attributes HTML takes the first
            marks[key] = " ".join(_DIGITS.sub("0", "".join(values)).split()).replace("[", "(").replace("]", ")")
    return name + "".join(f"[{key}={marks[key]}]" for key in sorted(marks))


class Place:
    """An open element below others; equal paths of a page are one place."""

    __slots__ = ("parent", "name", "key", "kinds", "below")

    def __init__(self, parent: Place | None, name: str):
        self.parent, self.name = parent, name
        self.key = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), parent.key) if parent else 0
        self.kinds: frozenset[int] | None = None
        self.below: dict[str, Place] = {}


def _inert_end(html: str, at: int, name: str, parent: str | None) -> tuple[int, int]:
    """Place after the closing tag of an inert element, or -1 where its parent or the page ends before, and where that is."""
    depth, outer = 1, 1
    for match in _TAG.finditer(html, at):
        found = (match[2] or "").lower()
        step = -1 if match[1] else 0 if match[0].endswith("/>") else 1
        if found == name:
            depth += step
            if not depth:
                return match.end(), match.end()
        elif found == parent:
            outer += step
            if not outer:
                return -1, match.start()
    return -1, len(html)


def tokens(html: str, place: Callable[[Place | None, str], Place] = Place) -> Iterator[tuple[str, str, Place, bool]]:
    """``(kind, value, place, linked)`` of a page.

    Kinds are ``open`` and ``close`` of block elements, ``break``, and ``text`` (raw,
    references not decoded).  The place names the open block elements and is made by
    ``place``; inline elements leave no trace but ``linked`` (inside a link).  Comments,
    declarations and elements whose content is no page text are left out.  Paragraphs
    and list items are closed as HTML does; stray closing tags are ignored; an unclosed
    comment, tag or raw element takes the rest of the page, as HTML has it; an inert
    element (a drawing, a template) that its parent ends before is as if not there.
    """
    top = place(None, "")
    stack: list[Place] = [top]
    names: list[str] = []
    opened: Counter[str] = Counter()
    no_end: dict[str, int] = {}
    links, at = 0, 0

    def pop() -> str:
        gone = names.pop()
        opened[gone] -= 1
        stack.pop()
        return gone

    while at < len(html):
        cut = html.find("<", at)
        match = _TAG.match(html, cut) if cut >= 0 else None
        while cut >= 0 and match is None:  # a "<" that starts no tag is text
            if html[cut + 1:cut + 2].isalpha() or html[cut + 1:cut + 2] in "/!?" and cut + 1 < len(html):
                break
            cut = html.find("<", cut + 1)
            match = _TAG.match(html, cut) if cut >= 0 else None
        end = cut if cut >= 0 else len(html)
        if end > at:
            yield "text", html[at:end], stack[-1], links > 0
        if cut < 0 or match is None:
            return
        at = match.end()
        name = (match[2] or "").lower()
        if match[0] == "<!--":
            close = html.find("-->", cut + 4)
            at = len(html) if close < 0 else close + 3
        elif not name:
            continue
        elif match[1]:
            if name == "a":
                links = 0
            elif opened[name]:
                links = 0
                gone = None
                while gone != name:
                    yield "close", stack[-1].name, stack[-1], False
                    gone = pop()
        elif name == "br":
            yield "break", name, stack[-1], False
        elif name in RAW:
            if not match[3].endswith("/"):
                close = _closing(name).search(html, at)
                at = len(html) if close is None else close.end()
        elif name in INERT:
            if not match[3].endswith("/") and at > no_end.get(name, -1):
                close, seen = _inert_end(html, at, name, names[-1] if names else None)
                if close >= 0:
                    at = close
                else:
                    no_end[name] = seen
        elif name in VOID:
            if name == "hr":
                yield "open", name, stack[-1], False
                yield "close", name, stack[-1], False
        elif name in INLINE or name in MATH:
            links = 1 if name == "a" else links
        else:
            ends, borders = CLOSES.get(name, _NOTHING)
            first = None
            if any(opened[e] for e in ends):
                depth = next((d for d in range(len(names) - 1, -1, -1) if names[d] in borders), -1)
                first = next((d for d in range(depth + 1, len(names)) if names[d] in ends), None)
            if first is None and names and names[-1] == "p":
                first = len(names) - 1
            while first is not None and len(names) > first:
                yield "close", stack[-1].name, stack[-1], False
                pop()
            names.append(name)
            opened[name] += 1
            marked = component(name, match[3])
            if marked not in stack[-1].below:
                stack[-1].below[marked] = place(stack[-1], marked)
            stack.append(stack[-1].below[marked])
            yield "open", marked, stack[-1], False
