"""HTML extraction through wrappers inferred per host as union-free regular expressions.

A page is a stream of block tags and texts.  A text that many different pages of the
host have at its place is a constant of the host's template; any other is a slot,
named by its place.  Repeated groups are folded within a page, and folded streams of
the same host are aligned one after another: what does not match becomes an optional
group, unequal texts of one place face to face become a field.  So the host's wrapper
is a regular expression of tags, constants, fields, and optional and repeated groups.

Every page is then read by its host's wrapper: its stream is matched against the
expression, and what part of the expression a text was matched by says what it is (a
field, a field of a menu, or template text).  The main text is the text of the main
container, whatever it was matched by; on pages without a container it is the smallest
element that holds all fields, so that constants beside it are left out.  Which
container that is is chosen from the page's own elements, so it does not depend on
what other shapes of pages the host has.  A page that the wrapper does not accept (it
was inferred from others) is read by its own expression.

Tasks emit each distinct folded stream of a host once, and Spark adds up counts
before any stream meets another, so a host with a third of all pages costs its
distinct streams only; these are aligned in as many groups of a bounded size as the
host needs, and the groups' wrappers are aligned again, level by level.
"""

from __future__ import annotations

import html as html_entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced
from .html_tokens import Place, tokens
from .url_filter import url_host

# Words in an element's name, class, id or role that mark what is no main text.
BOILERPLATE = frozenset(
    "ad ads adbox advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs button "
    "captcha comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus "
    "footer footnav form gdpr head header hidden legal login masthead menu modal nav navbar navigation newsletter notice "
    "notification pager pagination popup promo promoted promotion recommended related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split())
#: Words that mark a container of main text, best first.
CONTAINERS = ("article", "main", "articlebody", "content", "post", "entry", "story")
#: Elements of a text, which are no part of a layout.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
#: Words that make a class name one of a layout.
LAYOUT = frozenset("has with no without is layout".split())
#: Copies of a host's row for the join with its pages.
SALTS = 8
#: Streams or wrappers of one host that are aligned in one group (on average).
GROUP = 32
#: Longest repeated group, and most cells of an edit table (longer stretches are cut at what both sides hold once).
PERIOD, CELLS = 24, 250_000
#: Share of link text above which a slot is a menu outside containers.
LINK_SHARE = 0.5
#: Least share of a page's text, and of its largest kind of container, that makes a kind of container the main one.
PAGE_SHARE, KIND_SHARE = 0.1, 0.5
#: Different pages that must have a text at a place, and their share of the pages with that place, to make it a constant.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5

_WORDS = re.compile(r"[a-z]+")
_FIRST = 0x100  # code of the first token in a folded string

# A node is a token (str), ["?", nodes] (optional) or ["+", nodes] (repeated).  Tokens are tags, "~place" (a field),
# "^place" (a field of a menu) and "=place#words" (a constant); places and words are hashes.


def fold(stream: list[str]) -> list:
    """Fold repeated neighbours into ``["+", group]``, inner groups first."""
    nodes: list = []
    codes: dict[str, int] = {}

    def code(node) -> str:
        key = node if isinstance(node, str) else json.dumps(node)
        if key not in codes:
            codes[key] = len(nodes)
            nodes.append(node)
        return chr(_FIRST + codes[key] + (0x800 if _FIRST + codes[key] >= 0xD800 else 0))

    def node_of(char: str):
        at = ord(char)
        return nodes[at - _FIRST - (0x800 if at >= 0xE000 else 0)]

    text = "".join(map(code, stream))
    repeated = re.compile(rf"(.{{1,{PERIOD}}}?)\1+", re.S)
    while True:
        folded = repeated.sub(lambda m: code(_repeat([node_of(c) for c in m[1]])), text)
        if folded == text:
            return [node_of(c) for c in text]
        text = folded


def _repeat(group: list) -> list:
    return group[0] if len(group) == 1 and group[0][0] == "+" and not isinstance(group[0], str) else ["+", group]


def _groups(nodes: list, found: list) -> list:
    """Optional and repeated groups of a pattern, inner ones first."""
    for node in nodes:
        if not isinstance(node, str):
            _groups(node[1], found)
            if node not in found:
                found.append(node)
    return found


def _wrap_known(nodes: list, groups: list) -> list:
    """Write bare occurrences of the other side's groups as such groups too."""
    for kind, group in groups:
        out, at, length = [], 0, len(group)
        while at < len(nodes):
            node = nodes[at]
            if nodes[at:at + length] == group:
                out.append([kind, group])
                at += length
            else:
                out.append(node if isinstance(node, str) or node[1] == group else [node[0], _wrap_known(node[1], [[kind, group]])])
                at += 1
        nodes = out
    return nodes


def _core(node):
    """What a node is aligned by: an optional group stands for its content."""
    return json.dumps(node[1] if not isinstance(node, str) and node[0] == "?" else [node])


def _optional(nodes: list) -> list:
    """Nodes one side lacks: one optional group (groups that are optional already stay)."""
    if not nodes:
        return []
    if all(not isinstance(n, str) and n[0] == "?" for n in nodes):
        return nodes
    flat = []
    for n in nodes:
        flat += n[1] if not isinstance(n, str) and n[0] == "?" and len(nodes) == 1 else [n]
    return [["?", flat]]


def align(left: list, right: list, inside: bool = False) -> list:
    """Most special pattern this method finds for both sides.

    Inside of groups that met, the sides are taken as they are written, so that each step is about less.
    """
    if left == right:
        return left
    if not inside:
        right = _wrap_known(right, _groups(left, []))
        left = _wrap_known(left, _groups(right, []))
    a, b = [_core(n) for n in left], [_core(n) for n in right]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1

    def same(x, y):
        return x if not isinstance(x, str) and x[0] == "?" else y

    start = [same(x, y) for x, y in zip(left[:head], right[:head])]
    end = [same(x, y) for x, y in zip(left[len(left) - tail:], right[len(right) - tail:])]
    left, right, a, b = left[head:len(left) - tail], right[head:len(right) - tail], a[head:len(a) - tail], b[head:len(b) - tail]
    pairs = _common(a, b)
    middle, i, j, lone_a, lone_b = [], 0, 0, [], []

    def flush():
        # two groups face to face are aligned inside, unequal texts of one place are a field
        if len(lone_a) == len(lone_b) == 1:
            x, y = lone_a[0], lone_b[0]
            if isinstance(x, str) and isinstance(y, str):
                field = _place_of(x)
                middle.extend(["~" + field] if field is not None and field == _place_of(y) else _optional([x]) + _optional([y]))
            elif isinstance(x, str) or isinstance(y, str):
                middle.extend(_optional([x]) + _optional([y]))
            elif x[0] == y[0] == "+":
                middle.append(["+", align(x[1], y[1], True)])
            else:
                middle.append(["?", align(*(n[1] if n[0] == "?" else [n] for n in (x, y)), True)])
        else:
            middle.extend(_optional(lone_a) + _optional(lone_b))
        lone_a.clear()
        lone_b.clear()

    for at, to in [*pairs, (len(a), len(b))]:
        lone_a += left[i:at]
        lone_b += right[j:to]
        flush()
        if at < len(a):
            middle.append(same(left[at], right[to]))
        i, j = at + 1, to + 1
    return start + middle + end


def _place_of(token: str) -> str | None:
    """Place of a text token; None for tags."""
    return token[1:].split("#", 1)[0] if token[0] in "~=" else None


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: a longest one, between cuts at what both sides hold once where they are long."""
    if not a or not b:
        return []
    if len(a) * len(b) <= CELLS:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        found, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return found
    in_a, in_b, place = Counter(a), Counter(b), {x: j for j, x in enumerate(b)}
    single = [(i, place[x]) for i, x in enumerate(a) if in_a[x] == 1 and in_b[x] == 1]
    cuts = _rising(single) or [_half(a, b)]
    found, i, j = [], 0, 0
    for at, to in [*cuts, (len(a), len(b))]:
        found += [(i + x, j + y) for x, y in _common(a[i:at], b[j:to])]
        if at < len(a) and to < len(b) and a[at] == b[to]:
            found.append((at, to))
            i, j = at + 1, to + 1
        else:
            i, j = at, to
    return found


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (ordered by the first) whose second rises."""
    ends: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before.append(tops[at - 1] if at else -1)
        ends[at:at + 1], tops[at:at + 1] = [j], [n]
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _half(a: list[str], b: list[str]) -> tuple[int, int]:
    """Where to cut two long lists that share nothing single: in their middles."""
    return len(a) // 2, len(b) // 2


def size(nodes: list) -> int:
    return sum(1 if isinstance(n, str) else 1 + size(n[1]) for n in nodes)


def infer(patterns: Iterable[list]) -> list:
    """Align patterns one after another, short ones first."""
    wrapper: list | None = None
    for pattern in sorted(patterns, key=lambda p: (size(p), json.dumps(p))):
        wrapper = pattern if wrapper is None else align(wrapper, pattern)
    return wrapper or []


def slots(nodes: list) -> list[str]:
    """Paths of the text slots of a wrapper, in order."""
    out = []
    for node in nodes:
        if isinstance(node, str):
            if node.startswith("~"):
                out.append(node[1:])
        else:
            out += slots(node[1])
    return out


def marked(nodes: list, menus: set[str]) -> list:
    """The wrapper with fields of menus written as such."""
    return [("^" + n[1:] if n[0] == "~" and n[1:] in menus else n) if isinstance(n, str) else [n[0], marked(n[1], menus)]
            for n in nodes]


def as_expression(nodes: list) -> str:
    """The wrapper as a readable regular expression; ``#`` is a field, ``^`` one of a menu, ``=`` a constant."""
    signs = {"~": "#", "^": "^", "=": "="}
    return "".join(signs.get(n[0], f"<{n}>") if isinstance(n, str) else f"({as_expression(n[1])}){n[0]}" for n in nodes)


class Expression:
    """A wrapper that reads streams: each token is matched by one part of it.

    Parts are the tokens of the expression, sets of parts are bits of one number.  A
    stream is read forwards through sets of parts (each set and step is computed once)
    and backwards along the earliest parts that lead to the end.
    """

    def __init__(self, nodes: list):
        self.parts: list[str] = []
        self.follow: list[int] = []
        self.matching: dict[str, int] = defaultdict(int)
        self.first, self.last, self.empty = self._build(nodes)
        before = [0] * len(self.parts)
        for at, after in enumerate(self.follow):
            for to in _bits(after):
                before[to] |= 1 << at
        self.before = before
        for at, part in enumerate(self.parts):
            self.matching["~" + part[1:] if part[0] == "^" else part] |= 1 << at
        self.sets: list[int] = [0]
        self.numbers = {0: 0}
        self.steps: list[dict[str, int]] = [{}]

    def _build(self, nodes: list) -> tuple[int, int, bool]:
        first, last, empty = 0, 0, True
        for node in nodes:
            if isinstance(node, str):
                self.parts.append(node)
                self.follow.append(0)
                f = e = 1 << len(self.parts) - 1
                skip = False
            else:
                f, e, skip = self._build(node[1])
                if node[0] == "+":
                    for at in _bits(e):
                        self.follow[at] |= f
                else:
                    skip = True
            for at in _bits(last):
                self.follow[at] |= f
            first, last, empty = first | f if empty else first, last | e if skip else e, empty and skip
        return first, last, empty

    def _accepting(self, token: str) -> int:
        found = self.matching.get(token, 0)
        return found | self.matching.get("~" + token[1:].split("#", 1)[0], 0) if token[0] == "=" else found

    def _step(self, number: int, token: str) -> int:
        after = 0
        for at in _bits(self.sets[number]):
            after |= self.follow[at]
        after = (after if number else self.first) & self._accepting(token)
        if after not in self.numbers:
            self.numbers[after] = len(self.sets)
            self.sets.append(after)
            self.steps.append({})
        self.steps[number][token] = self.numbers[after]
        return self.numbers[after]

    def match(self, stream: list[str]) -> list[int] | None:
        """The part that matches each token, or None if the expression does not accept the stream."""
        number, way = 0, []
        for token in stream:
            to = self.steps[number].get(token)
            number = self._step(number, token) if to is None else to
            if not number:
                return None
            way.append(number)
        if not way:
            return [] if self.empty else None
        open_, out = self.sets[way[-1]] & self.last, []
        for number in reversed(way):
            open_ &= self.sets[number]
            if not open_:
                return None
            at = (open_ & -open_).bit_length() - 1
            out.append(at)
            open_ = self.before[at]
        return out[::-1]


def _bits(number: int) -> Iterator[int]:
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


class Text(NamedTuple):
    """A text block of a page."""

    place: Place
    words: str
    chars: int
    linked: int


def page_stream(page: str | None) -> list[str | Text]:
    """Tags and text blocks of a page, white space of a block turned into one space, references decoded."""
    stream: list[str | Text] = []
    run: list[str] = []
    sums = [0, 0]
    at: Place | None = None

    def flush():
        if run:
            words = " ".join(html_entities.unescape("".join(run)).split())
            if words:
                stream.append(Text(at, words, *sums))
            run.clear()
            sums[:] = 0, 0

    for kind, value, place, linked in tokens(page or "", _place):
        if kind == "text":
            n = len(value) - value.count(" ") - value.count("\n")
            sums[0] += n
            sums[1] += n * linked
            at = place
            run.append(value)
        elif kind == "break":
            run.append(" ")
        else:
            flush()
            stream.append(value if kind == "open" else "/" + value)
    flush()
    return stream


def _digest(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words.encode("utf-8", "surrogatepass")) >> 1


def _constant(text: Text) -> str:
    return f"{text.place.key:x}#{_digest(text.words):x}"


def named(stream: list[str | Text], constants: frozenset[str]) -> list[str]:
    """Tokens of a stream: its texts as constants or as slots."""
    return [item if isinstance(item, str) else "=" + name if constants and (name := _constant(item)) in constants
            else f"~{item.place.key:x}" for item in stream]


def _marks(part: str) -> tuple[set[str], set[str]]:
    """Words of an element's name, classes, id and role, and those that stand alone (not joined as in ``post-footer``).

    Names that tell a layout (``has-sidebar``) say nothing; ``hidden`` must stand alone.
    """
    name, *attributes = part.lower().split("[")
    words, alone = {name}, {name}
    if name not in ("html", "body"):
        for attribute in attributes:
            key, _, values = attribute.rstrip("]").partition("=")
            if key == "hidden":
                words.add(key)
                alone.add(key)
            for value in values.split():
                found = set(_WORDS.findall(value))
                if not found & LAYOUT:
                    words |= found - {"hidden"} | {value} & {"hidden"}
                    alone |= found & {value}
    return words, alone


@lru_cache(maxsize=4096)
def _boilerplate(part: str) -> bool:
    """An element is marked as no main text.

    No word but ``hidden`` speaks against the elements ``article`` and ``main`` (or such a role),
    and a joined word (``category-social``) not against one with a container's class either.
    """
    words, alone = _marks(part)
    name = part.split("[", 1)[0]
    if name in ("article", "main") or "[role=article]" in part or "[role=main]" in part:
        return "hidden" in words
    return bool((alone if alone & set(CONTAINERS) else words) & BOILERPLATE)


@lru_cache(maxsize=4096)
def _own_kinds(part: str) -> frozenset[int]:
    return frozenset(r for r, word in enumerate(CONTAINERS) if word in _marks(part)[0])


def _place(parent: Place | None, name: str) -> Place:
    """A place with the kinds of containers (places in :data:`CONTAINERS`) it lies in; None below a boilerplate element."""
    place = Place(parent, name)
    if parent is None:
        place.kinds = frozenset()
    elif parent.kinds is not None and not _boilerplate(name):
        place.kinds = parent.kinds | _own_kinds(name)
    return place


def main_blocks(stream: list[str | Text], parts: list[str]) -> list[str]:
    """Blocks of the main text, of a page's stream and the parts of the wrapper that matched it.

    Text is summed by kind of container; the kind is the best name with its share of
    the page's text and of the largest kind (so an article inside the content wins, a
    card beside it does not).  All its text below no boilerplate element is main,
    constants too.  Without a container the main text lies in the smallest element
    (no paragraph, list or table) that holds all fields but menus; without fields it
    is all text that is no menu.
    """
    seen = [(at, text) for at, text in enumerate(stream) if not isinstance(text, str) and text.place.kinds is not None]
    weight: Counter[int] = Counter()
    for _, text in seen:
        for kind in text.place.kinds:
            weight[kind] += text.chars - text.linked
    least = max(PAGE_SHARE * sum(t.chars - t.linked for _, t in seen), KIND_SHARE * max(weight.values(), default=0))
    kind = min((k for k, n in weight.items() if n >= least), default=None)
    if kind is not None:
        return [text.words for _, text in seen if kind in text.place.kinds]
    open_ = [(at, text) for at, text in seen if text.place.kinds or parts[at][0] != "^"]
    start, end = _region(stream, [at for at, _ in open_ if parts[at][0] == "~"])
    return [text.words for at, text in open_ if start <= at < end]


def _region(stream: list[str | Text], fields: list[int]) -> tuple[int, int]:
    """Start and end in a stream of the smallest element that holds all fields; the whole page without fields."""
    opened: list[tuple[int, str]] = []
    if fields:
        for at, item in enumerate(stream[:fields[0]]):
            if isinstance(item, str):
                if item[0] != "/":
                    opened.append((at, item))
                elif opened:
                    opened.pop()
        # of the elements open at the first field, those still open at the last hold all of them
        level = depth = len(opened)
        close = {}
        for at in range(fields[0], len(stream)):
            item = stream[at]
            if isinstance(item, str):
                depth += 1 if item[0] != "/" else -1
                while level > max(depth, 0):
                    level -= 1
                    close[level] = at
        for level in range(len(opened) - 1, -1, -1):
            at, name = opened[level]
            if close.get(level, len(stream)) > fields[-1] and name.split("[", 1)[0] not in TEXTUAL:
                return at, close.get(level, len(stream))
    return 0, len(stream)


def main_text(page: str | None, wrapper: Expression | None, constants: frozenset[str] = frozenset()) -> str:
    """Main text of a page as its host's wrapper reads it, or its own expression if that does not accept it."""
    stream = page_stream(page)
    names = named(stream, constants)
    parts = wrapper.match(names) if wrapper else None
    if parts is None:
        chars: dict[Place, list[int]] = defaultdict(lambda: [0, 0])
        for text in stream:
            if not isinstance(text, str):
                chars[text.place][0] += text.chars
                chars[text.place][1] += text.linked
        wrapper = Expression(marked(fold(named(stream, frozenset())), {f"{p.key:x}" for p, (n, linked) in chars.items() if linked > LINK_SHARE * n}))
        parts = wrapper.match(named(stream, frozenset()))
    return "\n\n".join(main_blocks(stream, [wrapper.parts[at] for at in parts]))


# A text row has its words' digest, a slot row has null; ``seen`` has a bit (of 63) for each page.
_TEXTS = "host string, place long, words long, pages long, chars long, linked long, seen long"


def _observe_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many pages of each host have a text at a place, and sums of each place."""
    for batch in batches:
        found: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for host, page in zip(batch["host"], batch["html"]):
            texts = [(text.place.key, _digest(text.words), text.chars, text.linked) for text in page_stream(page) if not isinstance(text, str)]
            bit = 1 << xxhash.xxh3_64_intdigest(repr([t[:2] for t in texts])) % 63
            for place, words, chars, linked in texts:
                row = found[host, place, -1]
                row[1], row[2] = row[1] + chars, row[2] + linked
            for place, words in {t[:2] for t in texts} | {(t[0], -1) for t in texts}:
                row = found[host, place, words]
                row[0], row[3] = row[0] + 1, row[3] | bit
        rows = [(host, place - (1 << 64) if place >> 63 else place, words, *row) for (host, place, words), row in found.items()]
        frame = pd.DataFrame(rows, columns=["host", "place", "words", "pages", "chars", "linked", "seen"])
        frame["words"] = frame["words"].astype("Int64").where(frame["words"] >= 0)
        yield frame


def _observe_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct folded streams of each host in a batch."""
    read = _Tables()
    for batch in batches:
        found = {(host, json.dumps(fold(named(page_stream(page), read.constants(table)))))
                 for host, page, table in zip(batch["host"], batch["html"], batch["constants"])}
        yield pd.DataFrame(sorted(found), columns=["host", "value"])


class _Tables:
    """Hosts' rows as a task reads them, each parsed once (as long as few are held)."""

    def __init__(self):
        self.held: dict[str, object] = {}

    def _of(self, row: str, make):
        if row not in self.held:
            if len(self.held) >= 1000:
                self.held.clear()
            self.held[row] = make(json.loads(row))
        return self.held[row]

    def constants(self, row: str | None) -> frozenset[str]:
        return self._of(row, frozenset) if row else frozenset()

    def wrapper(self, row: str | None) -> tuple[Expression | None, frozenset[str]]:
        return self._of(row, lambda nodes: (Expression(nodes), frozenset(constants_of(nodes)))) if row else (None, frozenset())


def constants_of(nodes: list) -> Iterator[str]:
    """Constants of a wrapper."""
    for node in nodes:
        if not isinstance(node, str):
            yield from constants_of(node[1])
        elif node[0] == "=":
            yield node[1:]


def _aligned(rows: pd.DataFrame) -> pd.DataFrame:
    """Wrapper of one group of a host's streams or wrappers."""
    return pd.DataFrame([(rows["host"].iloc[0], json.dumps(infer(map(json.loads, rows["value"]))))], columns=["host", "value"])


def _wrapper_of_each_host(streams: DataFrame) -> DataFrame:
    """``host, value`` with one wrapper per host, of distinct rows ``host, value``.

    Each level deals a host's rows over groups by their hash and aligns each group,
    until no host has several groups.
    """
    while True:
        groups = streams.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
        dealt = streams.join(groups, F.col("host") == F.col("h")).select(
            "host", "value", F.pmod(F.xxhash64("value"), F.col("groups")).alias("part"))
        last = groups.where("groups > 1").isEmpty()
        wrappers = dealt.groupBy("host", "part").applyInPandas(_aligned, "host string, value string")
        if last:
            return wrappers
        streams = saved(wrappers.distinct(), "wrapper-level")


def _finished(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Wrappers with their menus, as text and for readers."""
    for values, menus in batches:
        made = [marked(json.loads(value), set(json.loads(menu)) if menu else set()) for value, menu in zip(values, menus)]
        yield pd.DataFrame([(as_expression(nodes), json.dumps(nodes)) for nodes in made], columns=["wrapper", "nodes"])


def _salted(df: DataFrame) -> DataFrame:
    """A row of each host, copied per salt."""
    return df.withColumnRenamed("host", "h").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages (with ``host, html``) and their hosts' rows; pages of a hot host are dealt over several keys."""
    keyed = pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
    return keyed.join(_salted(hosts), (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left").drop("h", "s", "salt")


def _place_hex(column: str) -> Column:
    return F.lower(F.hex(column))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper, nodes`` for every host of ``pages`` (null URLs have the empty host).

    ``wrapper`` is the inferred expression as text, ``nodes`` the JSON form of it that
    :func:`extract_text` reads pages with.
    """
    given = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    counted = saved(given.mapInPandas(_observe_texts, _TEXTS).groupBy("host", "place", "words").agg(
        *(F.sum(c).alias(c) for c in ("pages", "chars", "linked")), F.bit_or("seen").alias("seen")), "texts")
    places = counted.where("words is null").select(F.col("host").alias("ph"), F.col("place").alias("pp"), F.col("pages").alias("all"))
    often = counted.where(F.col("words").isNotNull() & (F.bit_count("seen") >= TEMPLATE_PAGES))
    constant = often.join(places, (F.col("host") == F.col("ph")) & (F.col("place") == F.col("pp"))).where(F.col("pages") >= TEMPLATE_SHARE * F.col("all"))
    constants = saved(constant.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(
        F.concat(_place_hex("place"), F.lit("#"), _place_hex("words"))))).alias("constants")), "constants")
    menus = counted.where(F.col("words").isNull() & (F.col("linked") > LINK_SHARE * F.col("chars"))).groupBy(F.col("host").alias("mh")).agg(
        F.to_json(F.sort_array(F.collect_list(_place_hex("place")))).alias("menus"))
    streams = _with_hosts(given, constants).select("host", "html", "constants").mapInPandas(_observe_streams, "host string, value string")
    wrappers = _wrapper_of_each_host(saved(streams.distinct(), "streams"))
    finished = F.pandas_udf(_finished, "wrapper string, nodes string")
    made = wrappers.join(menus, F.col("host") == F.col("mh"), "left").select("host", finished("value", "menus").alias("made"))
    return saved(made.select("host", "made.wrapper", "made.nodes"), "wrappers")


def text_column(page: Column, nodes: Column) -> Column:
    """Main text of each page under its host's wrapper."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        read = _Tables()
        for htmls, rows in batches:
            yield pd.Series([main_text(html, *read.wrapper(row)) for html, row in zip(htmls, rows)], dtype=object)

    return extract(page, nodes)


def extract_text(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` for every row of ``pages``.

    A null or empty page, or one without main text, has an empty text; repeated rows
    and null ids come out row by row; null URLs belong to the empty host; an empty
    table gives an empty result; other columns are ignored; a page of a host without a
    wrapper is read by its own expression.  Wrappers are copied per salt, so pages of
    a hot host are dealt over several keys where the wrappers are too large for Spark
    to broadcast.
    """
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).select(
        "*", url_host(F.col("url")).alias("host"))
    both = _with_hosts(keyed, wrappers.select("host", "nodes"))
    read = both.select("id", "url", text_column(F.col("html"), F.col("nodes")).alias("text"))
    return read.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                       F.length("text").cast("long").alias("n_chars"))
