"""Text scalar functions (Column -> Column), all native Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.split()`` / ``str.strip()`` whitespace set, written out so that
# Java regexes (whose plain ``\s`` is ASCII-only) split exactly where Python
# does.
WS_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A"
    "\\u2028\\u2029\\u202F\\u205F\\u3000]"
)
WS_RUN = WS_CLASS + "+"
NON_WS = WS_CLASS.replace("[", "[^", 1)

# Python's whitespace characters (same set as WS_CLASS).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")

# Invisible characters removed by the cleaner.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column -> Column lambda).

    Catalyst does not share a sub-expression that sits under ``coalesce`` or
    ``when`` branches, so a long text cleaned once and tested by thirty
    phrase checks would otherwise be cleaned thirty times per row.
    """
    return F.transform(F.array(value), body).getItem(0)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """NULL and '' are both "missing"; returns ''-for-NULL string column."""
    return F.coalesce(col_(c), F.lit(""))


def _spaced(c, dropped: str = "") -> Column:
    """Every white-space character as a space, and the characters of ``dropped`` left out.

    A character table: a pattern of all white space would be tried at every character.
    """
    return F.translate(blank(c), PY_WHITESPACE + dropped, " " * len(PY_WHITESPACE))


def collapse_ws(c) -> Column:
    """Python ``' '.join(s.split())``: collapse whitespace runs and strip."""
    return F.trim(F.regexp_replace(_spaced(c), " {2,}", " "))


def clean_text(c) -> Column:
    """Drop zero-width characters, collapse whitespace, trim; NULL -> ''."""
    return F.trim(F.regexp_replace(_spaced(c, ZERO_WIDTH), " {2,}", " "))


def normalize_text(c) -> Column:
    """trim + lower + collapse whitespace (identity / key normaliser)."""
    return collapse_ws(F.lower(blank(c)))


def first_nonempty(*cols) -> Column:
    """Python ``a or b or c or ''`` over string columns ('' and NULL are falsy)."""
    return F.coalesce(*[F.nullif(col_(c), F.lit("")) for c in cols], F.lit(""))


def word_count(c) -> Column:
    """``len(s.split())`` with Python whitespace."""
    return F.size(tokens(c))


def has_words(c, least: int) -> Column:
    """``len(s.split()) >= least``, reading only so far."""
    return blank(c).rlike(f"^{WS_CLASS}*+(?:{NON_WS}++{WS_CLASS}++){{{least - 1}}}{NON_WS}")


def tokens(c) -> Column:
    """``s.split()`` as an array (empty array for blank text)."""
    return F.array_remove(F.split(_spaced(c), " "), "")


def _regex_escape(term: str) -> str:
    out = []
    for ch in term:
        if ch.isalnum() or ch == " ":
            out.append(ch)
        else:
            out.append("\\" + ch if ch.isascii() else ch)
    return "".join(out)


def alternation(terms: Iterable[str]) -> str:
    """One compiled alternation for a phrase list (literal match)."""
    return "(?:" + "|".join(_regex_escape(t) for t in terms) + ")"


def contains_any(c, terms: Iterable[str]) -> Column:
    """Any of the phrases is a substring of ``c`` (case as given).

    Plain substring searches, the text bound once and the first hit ending the chain: a
    regular expression would try every phrase at every character.
    """
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return let(blank(c), lambda s: any_of(F.contains(s, F.lit(t)) for t in terms))


def any_of(conditions: Iterable[Column]) -> Column:
    """Conditions joined by OR as a balanced tree (long lists stay shallow), tried in order."""
    level = list(conditions)
    while len(level) > 1:
        level = [level[i] | level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def folded(c) -> Column:
    """Lower case in which letters that only look equal under ``(?iU)`` patterns are the plain ones."""
    return F.lower(F.translate(blank(c), "\u017f\u0131\u0130\u212a", "siik"))


def rewritten(s: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """Apply rules ``(word, pattern, replacement)`` one after another where their folded word occurs.

    No replacement may bring in the word of a later rule: words are looked for once.
    """
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(r).alias("r")) for w, p, r in rules])
    return let(s, lambda text: let(folded(text), lambda low: F.aggregate(
        F.filter(table, lambda rule: F.contains(low, rule["w"])), text,
        lambda done, rule: F.regexp_replace(done, rule["p"], rule["r"]))))


def cache_key(c, *, kind: str | None = None, trim: bool = True) -> Column:
    """md5 hex of the (trimmed) text, optionally prefixed ``km_``/``te_``."""
    text = pystrip(c) if trim else blank(c)
    key = F.md5(text)
    return F.concat(F.lit(kind + "_"), key) if kind else key


def pystrip(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.btrim(blank(c), F.lit(PY_WHITESPACE))


# Placeholder texts used when a listing gives no summary.
PUBLICATION_PLACEHOLDER = "Publication detailing quantum information science research."
NEWS_PLACEHOLDER_PREFIX = "News article about "


def title_fallback_summary(summary, title, series=None, *, limit: int = 200,
                           placeholder: str = PUBLICATION_PLACEHOLDER,
                           default_series: str = "Publication") -> Column:
    """Keep the summary when it differs from the title, else derive one from the title.

    The title is cut at ``limit`` characters (``...`` appended when cut) and
    prefixed with ``"<series>: "`` unless the series already appears in it; a
    result equal to the title gives ''.  ``series=None`` means the record has
    no series field, which falls back to ``default_series``.
    """
    s = pystrip(summary)
    t_raw = blank(title)
    t = pystrip(title)
    ser = blank(series) if series is not None else F.lit(default_series)
    cut = F.when(F.length(t_raw) > limit, F.concat(F.substring(t_raw, 1, limit), F.lit("..."))).otherwise(t_raw)
    with_series = F.when((ser != "") & (F.instr(F.lower(cut), F.lower(ser)) == 0),
                         F.concat(ser, F.lit(": "), cut)).otherwise(cut)
    return (F.when((s != "") & (t != "") & (F.lower(s) != F.lower(t)), s)
             .when(t_raw == "", F.lit(placeholder))
             .when(F.lower(pystrip(with_series)) == F.lower(t), F.lit(""))
             .otherwise(with_series))


def news_fallback_summary(summary, title) -> Column:
    """``summary or (title[:80] + '...' if len(title) > 50 else 'News article about <title>.')``."""
    s = blank(summary)
    t = blank(title)
    return (F.when(s != "", s)
             .when(F.length(t) > 50, F.concat(F.substring(t, 1, 80), F.lit("...")))
             .otherwise(F.concat(F.lit(NEWS_PLACEHOLDER_PREFIX), F.lower(t), F.lit("."))))
