"""Secrets in texts: fixed patterns, and literals that reach a name that sounds secret.

Patterns give the base spans.  Beside them a text is read as source or configuration
(``assignments``): literals are bound to the names they are assigned to, names assigned
to names pass their literals on, and a literal is scored by the most telling name it
reaches times how much it looks like a generated value.  Texts are judged one by one, so
nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assignments import Assignment, Literal, assignments
from .common import sliced

#: The base patterns, by kind, in the order kinds are listed, with the least length of the group named.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")
LEAST = 8

#: How telling the words of a name are (the last two words count together, as in ``api_key``).
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "secret": 1.0, "secrets": 1.0, "apikey": 1.0,
    "token": 0.9, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 0.9, "signingkey": 1.0,
    "encryptionkey": 1.0, "authkey": 1.0, "masterkey": 1.0, "bearer": 0.9, "authorization": 0.8, "pass": 0.8, "auth": 0.6, "pin": 0.6,
    "salt": 0.6, "key": 0.6, "signature": 0.5}
#: Last words that make a name speak about a secret rather than hold it.
ABOUT = frozenset("name names id ids path file files filename url uri link type types field label hint prompt length len size count "
                  "policy expiry expires ttl header param regex pattern format placeholder message error reset input form".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A text without any of these has no telling name.
_STEMS = re.compile("pass|pwd|secret|token|key|credential|bearer|auth|pin|salt|signature", re.I | re.A)
_PLACEHOLDER = re.compile(r"(?i)change.?me|example|dummy|sample|place.?holder|redacted|your[-_ ]|insert|todo|^(?:none|null|true|false|undefined)$"
                          r"|\$\{|\{\{|%\(|^\$|^<.*>$|^%s$|^[*.x_\-]+$|^(.)\1*$")
#: Score from which a literal is reported.
THRESHOLD = 0.5


def name_weight(name: str) -> float:
    """How much a name says that it holds a secret, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in ABOUT:
        return 0.0
    pairs = [a + b for a, b in zip(words, words[1:])]
    return max(NAME_WEIGHTS.get(w, 0.0) for w in words + pairs)


def strength(value: str) -> float:
    """How much a value looks generated, 0 to 1: bits a character, kinds of characters, length."""
    if len(value) < LEAST or any(c.isspace() for c in value) or _PLACEHOLDER.search(value):
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = (any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value)
             + any(not c.isalnum() for c in value))
    digits = any(c.isdigit() for c in value)
    return min(1.0, 0.2 * bits) * (0.4 + 0.2 * min(kinds, 3)) * (1.0 if digits else 0.7)


def literal_scores(text: str, found: list[Assignment]) -> dict[Literal, float]:
    """Score of every literal that reaches a telling name, names passing literals on in the order of the text.

    A name means its latest assignment before; every assignment is visited once for the
    most telling name that it reaches, so the work is linear in their number.
    """
    sources: list[list[int]] = []
    latest: dict[str, int] = {}
    for at, one in enumerate(found):
        sources.append([latest[n] for n in one.names if n in latest])
        latest[one.name] = at
    out: dict[Literal, float] = {}
    visited: set[int] = set()
    telling = sorted(((name_weight(one.name), -at) for at, one in enumerate(found)), reverse=True)
    for weight, minus in telling:
        if weight <= 0:
            break
        open_ones = [-minus]
        while open_ones:
            at = open_ones.pop()
            if at in visited:
                continue
            visited.add(at)
            open_ones += sources[at]
            literals = found[at].literals
            if sources[at] and len(literals) == 1 and text[literals[0].start:literals[0].end] in latest:
                continue  # the bare word is the name that was followed
            value = strength("".join(text[a:b] for a, b in literals))
            for one in literals:
                out[one] = max(out.get(one, 0.0), weight * value)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` of the fixed patterns, each kind leftmost first without overlaps."""
    lowered = text.lower()
    found = []
    if any(word in lowered for word in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text, by start, kind and end; literals that overlap a base span are not named again."""
    text = text or ""
    found = base_spans(text)
    named = [{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for a, k, b in found]
    if _STEMS.search(text):
        scores = literal_scores(text, assignments(text))
        taken, at, reach = [(a, b) for a, _, b in found], 0, 0
        for (a, b), score in sorted(scores.items()):
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            if score >= THRESHOLD and a < b and reach <= a:
                named.append({"kind": KINDS[3], "start": a, "end": b, "score": round(score, 6)})
    return sorted(named, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def secrets_column(text: Column) -> Column:
    """``array<struct<kind, start, end, score>>`` of each text, places in code points, ends exclusive."""

    @F.pandas_udf("array<struct<kind string, start int, end int, score double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for texts in sliced(batch, 1000):
                yield pd.Series([spans_of(t) for t in texts], dtype=object)

    return scan(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, found`` for every row of ``docs``: the spans of :func:`secrets_column` over the whole text.

    Null and empty texts have an empty list; repeated rows and null ids come out as they
    are; other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id"), secrets_column(F.col("text")).alias("found"))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    whole = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"))
    cut = F.aggregate(found, start, lambda s, x: F.when(x["start"] >= s["upto"], F.struct(
        F.concat(s["out"], F.substring(whole, s["upto"] + 1, x["start"] - s["upto"]), F.lit(mark)).alias("out"), x["end"].alias("upto"))).otherwise(
        F.struct(s["out"].alias("out"), F.greatest(s["upto"], x["end"]).alias("upto"))),
        lambda s: F.concat(s["out"], F.substring(whole, s["upto"] + 1, F.length(whole))))
    return F.when(text.isNotNull(), cut)


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from the rows of :func:`find_secrets`."""
    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
                        of(KINDS[3]).alias("n_literal"))
