"""Native HTML field extraction (title, h1, meta tags, language, page text, error tests)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, blank, clean_text, col_, contains_any, let, pystrip, word_count

# Entities decoded natively, '&amp;' last so '&amp;lt;' stays '&lt;'.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def unescape(c) -> Column:
    """Entities decoded, one after another; a text without ``&`` is left alone."""
    def decoded(s: Column) -> Column:
        out = s
        for ent, ch in ENTITIES:
            out = F.replace(out, F.lit(ent), F.lit(ch))
        return F.when(F.contains(s, F.lit("&")), out).otherwise(s)

    return let(blank(c), decoded)


def strip_tags(c) -> Column:
    return F.regexp_replace(blank(c), "<[^>]*>", " ")


def tag_text(html, tag: str) -> Column:
    """Cleaned text of the first ``<tag ...>...</tag>``."""
    inner = F.regexp_extract(col_(html), f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>", 1)
    return clean_text(unescape(strip_tags(inner)))


def first_paragraph(html) -> Column:
    """Text from the first ``<p>`` to the next ``</p>``, tags stripped."""
    inner = F.regexp_extract(col_(html), "(?s)<p>(.*?)</p>", 1)
    return clean_text(unescape(strip_tags(inner)))


def meta_content(html, attr: str, name: str) -> Column:
    """``content`` of ``<meta {attr}="{name}" content="...">`` (either attribute order)."""
    h = col_(html)
    a = F.regexp_extract(h, f'(?is)<meta\\s[^>]*{attr}\\s*=\\s*["\']{name}["\'][^>]*content\\s*=\\s*"([^"]*)"', 1)
    b = F.regexp_extract(h, f'(?is)<meta\\s[^>]*content\\s*=\\s*"([^"]*)"[^>]*{attr}\\s*=\\s*["\']{name}["\']', 1)
    return clean_text(unescape(F.coalesce(F.nullif(a, F.lit("")), b)))


def page_language(html) -> Column:
    """Declared ``<html lang>`` or 'en'."""
    lang = F.regexp_extract(col_(html), "(?is)<html[^>]*\\slang\\s*=\\s*[\"']([^\"']+)[\"']", 1)
    return F.when(lang == "", F.lit("en")).otherwise(lang)


def page_text(html) -> Column:
    """Visible text: scripts, styles and comments removed, tags stripped, entities decoded."""
    h = F.regexp_replace(col_(html), "(?is)<(?:script[^>]*>.*?</script\\s*>|style[^>]*>.*?</style\\s*>|!--.*?-->)", " ")
    return clean_text(unescape(strip_tags(h)))


# Page-level error tests.
ERROR_SOFT = ("redirect", "error", "not found", "404", "500", "maintenance",
              "you are being redirected", "potential security issue", "access denied", "forbidden",
              "temporarily unavailable")
ERROR_CRITICAL = ("404", "500", "not found", "access denied", "forbidden")
JS_DISABLED = ("javascript disabled", "requires javascript", "unauthorized frame window")
# Besides these, "error" with "occurred" anywhere after it.
BODY_ERRORS = ("not found", "page not found", "404", "500", "internal server error", "maintenance",
               "temporarily unavailable", "access denied", "forbidden", "you are being redirected")


def is_error_page(text, body) -> Column:
    """Page-level error: critical token or 3+ soft tokens (unless a JS-disabled notice),
    then a body under 100 characters, then error patterns in the body."""
    return let(F.lower(blank(text)), lambda low: let(F.lower(blank(body)), lambda b: _is_error_page(low, b)))


def _is_error_page(low: Column, body: Column) -> Column:
    def any_in(text: Column, phrases: Sequence[str]) -> Column:
        return any_of(F.contains(text, F.lit(p)) for p in phrases)

    at = F.instr(body, "error")
    occurred = (at > 0) & F.contains(F.substr(body, at + 5, F.length(body)), F.lit("occurred"))
    soft = sum(F.contains(low, F.lit(t)).cast("int") for t in ERROR_SOFT)
    return ((F.length(body) < 100)
            | ((any_in(low, ERROR_CRITICAL) | (soft >= 3)) & ~any_in(low, JS_DISABLED))
            | ((any_in(body, BODY_ERRORS) | occurred) & ~any_in(body, JS_DISABLED)))


# Abstract plausibility lists.
ABSTRACT_BOILERPLATE = (
    "official website of the united states government", "secure .gov websites use https",
    "lock ( lock", "locked padlock", "an official website", "u.s. department of commerce",
    "national institute of standards and technology", "here's how you know",
    "contact us", "about nist", "news", "events",
)
RESEARCH_INDICATORS = (
    "research", "study", "method", "approach", "system", "technique", "algorithm", "framework",
    "model", "analysis", "evaluation", "security", "cryptography", "quantum", "ai",
    "machine learning",
)


def is_likely_abstract(c) -> Column:
    """50+ chars, no boilerplate, 10+ words, some research word.

    The topic-list test of the source can never fire on cleaned text (no
    newline is left), so it is not evaluated.
    """
    return let(pystrip(blank(c)), lambda s: (F.length(s) >= 50) & let(F.lower(s), lambda low: ~contains_any(low, ABSTRACT_BOILERPLATE)
               & contains_any(low, RESEARCH_INDICATORS)) & (word_count(s) >= 10))
