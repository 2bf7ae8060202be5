"""Link scalar functions (Column -> Column), native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, pystrip

# RFC 3986 split: scheme, authority (host), path; query and fragment dropped.
URL_SPLIT = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)"

# Fixed values: (host, path fragment, points) rules that mark canonical pages.
DEFAULT_HOST_RULES: tuple[tuple[str, str, int], ...] = (
    ("www.nist.gov", "/publications/", 25),
    ("www.nist.gov", "/news-events/news/", 25),
    ("csrc.nist.gov", "/pubs/", 25),
    ("csrc.nist.gov", "/presentations/", 25),
)

# Notification-type rules for the sidebar score.
# (host, type prefix or exact types, points); see ``link_score_typed``.
DEFAULT_TYPED_HOST_RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...], int], ...] = (
    ("www.nist.gov", ("ai_",), ("publication", "presentation", "news"), 20),
    ("csrc.nist.gov", ("pqc_",), (), 20),
)
DEFAULT_CONTENT_SEGMENTS = ("/publications/", "/news-events/news/", "/presentations/")


def url_parts(c) -> tuple[Column, Column, Column]:
    """(scheme, host, path) of a stripped link; missing parts are ''."""
    raw = pystrip(c)
    return (F.regexp_extract(raw, URL_SPLIT, 1),
            F.regexp_extract(raw, URL_SPLIT, 2),
            F.regexp_extract(raw, URL_SPLIT, 3))


def url_struct(c) -> Column:
    """struct(raw, scheme, host, path) from one regex pass (query and fragment dropped)."""
    def split(raw):
        joined = F.regexp_replace(raw, "(?s)" + URL_SPLIT + ".*$", "$1\u0001$2\u0001$3")
        parts = F.split(joined, "\u0001")
        return F.struct(raw.alias("raw"), parts.getItem(0).alias("scheme"), parts.getItem(1).alias("host"),
                        parts.getItem(2).alias("path"))
    return let(pystrip(c), split)


def _rstrip_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def sanitize_link(c) -> Column:
    """``[](u)<u>`` -> ``u``; anything else unchanged (NULL stays NULL).

    Both copies of ``u`` have the same length, so the split point is fixed by
    the total length and no regex back-reference is needed.
    """
    s = F.col(c) if isinstance(c, str) else c
    n = (F.length(s) - 6) / 2
    n_int = F.floor(n).cast("int")
    inner = F.substring(s, 4, n_int)
    ok = (s.startswith("[](") & (F.length(s) >= 6) & ((F.length(s) - 6) % 2 == 0)
          & (F.concat(F.lit("[]("), inner, F.lit(")<"), inner, F.lit(">")) == s)
          & ~inner.contains("\n"))
    return F.when(ok, inner).otherwise(s)


def normalize_link(c, *, default_scheme: str | None = None, sanitize: bool = False) -> Column:
    """Lower scheme and host, strip trailing '/' from the path, drop query/fragment.

    ``default_scheme=None`` is the identity form (relative links stay relative);
    ``default_scheme='https'`` (with ``sanitize=True``) is the display-key form,
    which always renders ``scheme://host/path``.  One URL split per value.
    """
    raw = sanitize_link(c) if sanitize else c

    def build(u):
        scheme, host, path = F.lower(u["scheme"]), F.lower(u["host"]), _rstrip_slash(u["path"])
        if default_scheme is None:
            built = F.concat(
                F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
                F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
                path)
        else:
            built = F.concat(F.when(scheme != "", scheme).otherwise(F.lit(default_scheme)),
                             F.lit("://"), host, path)
        return F.when(u["raw"] == "", F.lit("")).otherwise(built)

    return let(url_struct(raw), build)


def absolutize_link(c, base) -> Column:
    """Prefix the site host to relative links; absolute (``http``…) links unchanged."""
    s = blank(c)
    b = F.lit(base) if isinstance(base, str) else base
    return (F.when(s == "", s)
             .when(s.startswith("http"), s)
             .otherwise(F.concat(F.regexp_replace(b, "/+$", ""),
                                 F.when(s.startswith("/"), F.lit("")).otherwise(F.lit("/")), s)))


def is_search_index_url(c) -> Column:
    """Search-result listing URLs, which give no summary."""
    return blank(c).rlike("(?i)(/publications/search|/search\\b)")


def link_score(c, rules: Sequence[tuple[str, str, int]] = DEFAULT_HOST_RULES) -> Column:
    """Canonical-page score of a link; higher is better, homepages score -50.

    Scored on the normalised link's host and path, which are the raw link's
    host lower-cased and path without trailing '/', so one URL split suffices.
    """
    def score_of(u):
        return let(F.struct(F.lower(u["host"]).alias("host"), _rstrip_slash(u["path"]).alias("path"),
                            u["scheme"].alias("scheme")), _score)

    def _score(v):
        host, path = v["host"], v["path"]
        empty = (v["scheme"] == "") & (host == "") & (path == "")
        slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
        score = (F.when(path != "", F.lit(10)).otherwise(F.lit(0))
                 + F.when(slashes > 1, F.lit(10)).otherwise(F.lit(0)))
        for rule_host, part, points in rules:
            score = score + F.when((host == rule_host) & (F.instr(path, part) > 0), F.lit(points)).otherwise(F.lit(0))
        score = score + F.when(path == "", F.lit(-50)).otherwise(F.lit(0))
        return F.when(empty, F.lit(0)).otherwise(score).cast("int")

    return let(url_struct(c), score_of)


def link_score_typed(link, ntype,
                     rules=DEFAULT_TYPED_HOST_RULES,
                     segments: Sequence[str] = DEFAULT_CONTENT_SEGMENTS) -> Column:
    """Sidebar score: path shape, host/type pairs, content segments, homepage penalty."""
    raw = blank(link)
    t = blank(ntype)
    return let(url_struct(sanitize_link(raw)), lambda u: let(
        F.struct(F.lower(u["host"]).alias("host"), _rstrip_slash(u["path"]).alias("path")),
        lambda v: _typed(raw, t, v["host"], v["path"], rules, segments)))


def _typed(raw, t, host, path, rules, segments):
    slashes = F.length(path) - F.length(F.regexp_replace(path, "/", ""))
    score = (F.when(path != "", F.lit(10)).otherwise(F.lit(0))
             + F.when(slashes > 1, F.lit(10)).otherwise(F.lit(0)))
    for rule_host, prefixes, exact, points in rules:
        type_ok = F.lit(False)
        for p in prefixes:
            type_ok = type_ok | t.startswith(p)
        if exact:
            type_ok = type_ok | t.isin(*exact)
        score = score + F.when((host == rule_host) & type_ok, F.lit(points)).otherwise(F.lit(0))
    seg_hit = F.lit(False)
    for seg in segments:
        seg_hit = seg_hit | (F.instr(path, seg) > 0)
    score = score + F.when(seg_hit, F.lit(10)).otherwise(F.lit(0))
    score = score + F.when(path == "", F.lit(-50)).otherwise(F.lit(0))
    return F.when(raw == "", F.lit(0)).otherwise(score).cast("int")
