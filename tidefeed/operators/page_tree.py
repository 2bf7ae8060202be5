"""A light element tree and CSS-style selectors for one page (small per-row helper).

The parser keeps whatever it could build and all walks use explicit stacks, so
unclosed or deeply nested markup costs memory in proportion to the page and
never recursion depth.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NO_TEXT = {"script", "style", "template"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "page", "at", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None", page: "_Elements"):
        self.tag, self.attrs, self.children, self.parent, self.page = tag, attrs, [], parent, page
        # place in document order, and the place after its last descendant (None: still open)
        self.at, self.end = len(page.nodes), None

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def descendants(self) -> list["Node"]:
        """Elements below this one, in document order."""
        return self.page.nodes[self.at + 1:self.end]

    def strings(self, skip: frozenset[int] = frozenset()) -> list[str]:
        """Text pieces below this element, without scripts and the skipped elements (by ``id``)."""
        out, stack = [], list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                out.append(child)
            elif child.tag not in NO_TEXT and id(child) not in skip:
                stack.extend(reversed(child.children))
        return out


class _Elements:
    """Elements of a page in document order, and the places of those with a tag, class or attribute."""

    def __init__(self):
        self.nodes: list[Node] = []
        self._places: dict[tuple, list[int]] | None = None

    def places(self, step: tuple) -> list[int] | range:
        """Places of the elements that may fit a step: those with the rarest thing it asks for."""
        if self._places is None:
            found: dict[tuple, list[int]] = {}
            for node in self.nodes:
                found.setdefault(("tag", node.tag), []).append(node.at)
                for name in node.attrs:
                    found.setdefault(("attribute", name), []).append(node.at)
                if "class" in node.attrs:
                    for cls in set(node.attrs["class"].split()):
                        found.setdefault(("class", cls), []).append(node.at)
            self._places = found
        tag, classes, tests = step
        asked = [("tag", tag)] if tag else []
        asked += [("class", c) for c in classes] + [("attribute", name) for name, _, _ in tests]
        return min((self._places.get(a, ()) for a in asked), key=len, default=range(len(self.nodes)))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = _Elements()
        self.root = self.at = Node("#root", {}, None, self.page)
        self.page.nodes.append(self.root)
        self.open_count: dict[str, int] = {}

    def _add(self, tag, attrs) -> Node:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.page)
        self.at.children.append(node)
        self.page.nodes.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open_count.get("p"):
            self.handle_endtag("p")
        node = self._add(tag, attrs)
        if tag in VOID:
            node.end = node.at + 1
        else:
            self.at = node
            self.open_count[tag] = self.open_count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        node = self._add(tag, attrs)
        node.end = node.at + 1

    def handle_endtag(self, tag):
        if not self.open_count.get(tag):
            return
        while True:
            closed, self.at = self.at, self.at.parent
            closed.end = len(self.page.nodes)
            self.open_count[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> tuple[Node, str]:
    """Root of a page's tree and the parser's complaint ('' if none); the tree has what came before it."""
    builder, error = _Builder(), ""
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError) as e:
        error = f"{type(e).__name__}: {e}"
    return builder.root, error


_PART = re.compile(r"""([a-zA-Z][\w-]*)|\.([\w-]+)|\[\s*([\w:.-]+)\s*(?:([\^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*)))?\s*\]""")
_TESTS = {"": lambda have, want: True, "=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}
_COMPILED: dict[str, list[list[tuple]]] = {}


def _alternatives(selector: str) -> list[list[tuple]]:
    """Alternatives of a comma list, each a chain of ``(tag, classes, attribute tests)``, innermost first."""
    if selector not in _COMPILED:
        found = []
        for alternative in selector.split(","):
            chain = []
            for step in alternative.split():
                tag, classes, tests = None, [], []
                for name, cls, attribute, op, *values in _PART.findall(step):
                    if name:
                        tag = name.lower()
                    elif cls:
                        classes.append(cls)
                    else:
                        tests.append((attribute.lower(), _TESTS[op], "".join(values)))
                chain.append((tag, classes, tests))
            found.append(chain[::-1])
        _COMPILED[selector] = found
    return _COMPILED[selector]


def _is(node: Node, step: tuple) -> bool:
    tag, classes, tests = step
    return ((tag is None or node.tag == tag)
            and (not classes or set(classes) <= set(node.get("class").split()))
            and all(name in node.attrs and test(node.attrs[name], want) for name, test, want in tests))


def _fits(node: Node, chain: list[tuple]) -> bool:
    if not _is(node, chain[0]):
        return False
    above, at = node.parent, 1
    while at < len(chain) and above is not None:  # nearest fitting ancestors are as good as any
        at += _is(above, chain[at])
        above = above.parent
    return at == len(chain)


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements below ``root`` that match a comma list of descendant selectors, in document order.

    Only elements that have the innermost step's tag, class or attribute are looked at.
    """
    nodes, first = root.page.nodes, root.at + 1
    last = len(nodes) if root.end is None else root.end
    alternatives = _alternatives(selector)
    if len(alternatives) == 1:
        chain = alternatives[0]
        places = root.page.places(chain[0])
        for k in range(bisect_left(places, first), bisect_left(places, last)):
            if _fits(nodes[places[k]], chain):
                yield nodes[places[k]]
        return
    found: set[int] = set()
    for chain in alternatives:
        places = root.page.places(chain[0])
        found.update(at for at in places[bisect_left(places, first):bisect_left(places, last)] if at not in found and _fits(nodes[at], chain))
    yield from (nodes[at] for at in sorted(found))
