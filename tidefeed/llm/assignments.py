"""Assignments of a source or configuration text (small per-text helper).

Reads ``name = expression``, ``name: expression`` (also ``:=``, ``=>``, quoted and
indexed names, ``<name>text</name>`` and ``("name", literal)``), where an expression
is literals, bare values and names joined by ``+``, ``.`` or nothing.  Every place is
read once, so the work is linear in the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: A name at a border, then an assignment operator that is no comparison, address or scope.
_ASSIGN = re.compile(
    r"""(?<![\w$.\-])([A-Za-z_$][\w$.\-]*+)["'`\]]*+[ \t]*+(?::=|=>|=(?![=~])|:(?![:=/]))[ \t]*+""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)>(?=[^<\s])")
_CALL = re.compile(r"""\(\s*+["']([A-Za-z_][\w.\-]*+)["']\s*+,\s*+(?=["'`])""")
_STRING = re.compile(r"""[A-Za-z]{0,2}(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""", re.S)
_BARE = re.compile(r"""(?:[^\s,;#"'`(){}\[\]<>=]|=(?!["'`]))++""")
_ELEMENT_TEXT = re.compile(r"[^<]*+")
_JOIN = re.compile(r"[ \t]*+\\?(?:\s*+\+\s*+|[ \t]*+\.[ \t]*+(?=[\"'])|\s++(?=[\"']))|")
_NAME = re.compile(r"[A-Za-z_$][\w$.\-]*+\Z")


class Literal(NamedTuple):
    start: int
    end: int


class Assignment(NamedTuple):
    """A target with the literals of its expression and the names the expression refers to."""

    name: str
    literals: tuple[Literal, ...]
    names: tuple[str, ...]


def _expression(text: str, at: int) -> tuple[list[Literal], list[str], int]:
    """Literals, names and the end of the bare value of the expression at a place."""
    literals, names = [], []
    while True:
        found = _STRING.match(text, at)
        if found:
            literals.append(Literal(*found.span(found.lastindex)))
        else:
            found = _BARE.match(text, at)
            if not found:
                return literals, names, at
            value = found[0].rstrip(".")
            names += [part for part in value.split("+") if _NAME.match(part)]
            called = text[found.end():found.end() + 1] in ("(", "[")
            if not literals and not called:  # configuration files need no quotes
                return [Literal(at, at + len(value))], names, found.end()
            if called:
                return literals, names, found.end()
        join = _JOIN.match(text, found.end())
        if join.end() == found.end():
            return literals, names, at
        at = join.end()


def assignments(text: str) -> list[Assignment]:
    """All assignments, in order of their targets; one that lies whole inside a bare value is part of it."""
    found, read = [], 0
    for m in _ASSIGN.finditer(text):
        if m.end() <= read:
            continue
        literals, names, end = _expression(text, m.end())
        read = max(read, end)
        found.append((m.start(), m[1], literals, names))
    for m in _CALL.finditer(text):
        found.append((m.start(), m[1], *_expression(text, m.end())[:2]))
    for m in _ELEMENT.finditer(text):
        found.append((m.start(), m[1], [Literal(*_ELEMENT_TEXT.match(text, m.end()).span())], []))
    found.sort(key=lambda f: f[0])
    return [Assignment(name, tuple(literals), tuple(names)) for _, name, literals, names in found if literals or names]
