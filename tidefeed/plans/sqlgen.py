"""DuckDB SQL text for the oracle: the same rules written as SQL expressions.

These helpers only build strings; DuckDB runs them in the driver's check.
RE2 has no look-around or back-references, so each rule is written in a form
both engines accept, and whitespace classes are spelled out (DuckDB's ``\\s``
is ASCII-only).
"""

from __future__ import annotations

from collections.abc import Sequence

WS = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
WS_INNER = WS[1:-1]
URL_SPLIT = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({blank(x)}, {q(WS + '+')}, ' ', 'g'))"


def clean_text(x: str) -> str:
    return collapse(f"regexp_replace({blank(x)}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g')")


def normalize_text(x: str) -> str:
    return collapse(f"lower({blank(x)})")


def pystrip(x: str) -> str:
    return f"regexp_replace({blank(x)}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def first_nonempty(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def url_part(x: str, group: int) -> str:
    return f"regexp_extract({pystrip(x)}, {q(URL_SPLIT)}, {group})"


def rstrip_slash(x: str) -> str:
    return f"regexp_replace({x}, '/+$', '')"


def normalize_link(x: str, default_scheme: str | None = None, sanitize: bool = False) -> str:
    raw = sanitize_link(x) if sanitize else x
    raw = pystrip(raw)
    scheme = f"lower({url_part(raw, 1)})"
    host = f"lower({url_part(raw, 2)})"
    path = rstrip_slash(url_part(raw, 3))
    if default_scheme is None:
        built = (f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || "
                 f"CASE WHEN {host} <> '' THEN '//' || {host} ELSE '' END || {path})")
    else:
        built = f"(CASE WHEN {scheme} <> '' THEN {scheme} ELSE {q(default_scheme)} END || '://' || {host} || {path})"
    return f"(CASE WHEN {raw} = '' THEN '' ELSE {built} END)"


def sanitize_link(x: str) -> str:
    n = f"((length({x}) - 6) // 2)"
    inner = f"substr({x}, 4, {n})"
    ok = (f"(starts_with({x}, '[](') AND length({x}) >= 6 AND (length({x}) - 6) % 2 = 0 "
          f"AND '[](' || {inner} || ')<' || {inner} || '>' = {x} AND strpos({inner}, chr(10)) = 0)")
    return f"(CASE WHEN {ok} THEN {inner} ELSE {x} END)"


DEFAULT_HOST_RULES = (
    ("www.nist.gov", "/publications/", 25),
    ("www.nist.gov", "/news-events/news/", 25),
    ("csrc.nist.gov", "/pubs/", 25),
    ("csrc.nist.gov", "/presentations/", 25),
)


def link_score(x: str, rules=DEFAULT_HOST_RULES) -> str:
    scheme = url_part(x, 1)
    host = f"lower({url_part(x, 2)})"
    path = rstrip_slash(url_part(x, 3))
    parts = [f"(CASE WHEN {path} <> '' THEN 10 ELSE 0 END)",
             f"(CASE WHEN length({path}) - length(replace({path}, '/', '')) > 1 THEN 10 ELSE 0 END)"]
    for h, p, pts in rules:
        parts.append(f"(CASE WHEN {host} = {q(h)} AND strpos({path}, {q(p)}) > 0 THEN {pts} ELSE 0 END)")
    parts.append(f"(CASE WHEN {path} = '' THEN -50 ELSE 0 END)")
    empty = f"({scheme} = '' AND {host} = '' AND {path} = '')"
    return f"(CASE WHEN {empty} THEN 0 ELSE {' + '.join(parts)} END)"


LABEL_KEYS = ("document_name", "title", "document_number")
DATE_TOKEN_KEYS = ("release_date_raw", "edited_date_raw", "last_edited_date_raw", "publish_date_raw",
                   "release_date", "edited_date", "last_edited_date", "publish_date")


def item_identity(cols: dict[str, str] | None = None) -> str:
    """Identity from column expressions (missing names default to '')."""
    cols = cols or {}

    def c(name):
        return cols.get(name, "''")
    label = normalize_text(first_nonempty(*[c(k) for k in LABEL_KEYS]))
    token = normalize_text(first_nonempty(*[c(k) for k in DATE_TOKEN_KEYS]))
    number = normalize_text(c("document_number"))
    link = normalize_link(c("link"))
    return (f"(CASE WHEN {label} <> '' AND {token} <> '' THEN 'label::' || {label} || '::date::' || {token} "
            f"WHEN {number} <> '' AND {token} <> '' THEN 'document::' || {number} || '::date::' || {token} "
            f"WHEN {label} <> '' THEN 'label::' || {label} "
            f"WHEN {link} <> '' THEN 'link::' || {link} "
            f"WHEN {token} <> '' THEN 'date::' || {token} ELSE 'empty-item' END)")


def display_key(title_keys: Sequence[str], date_keys: Sequence[str], link: str = "link",
                rtype: str = "resource_type") -> str:
    nl = normalize_link(link, default_scheme="https", sanitize=True)
    title = first_nonempty(*[normalize_text(k) for k in title_keys])
    date = first_nonempty(*[normalize_text(k) for k in date_keys])
    return (f"(CASE WHEN {nl} <> '' THEN 'link::' || {nl} ELSE 'type::' || {normalize_text(rtype)} "
            f"|| '::title::' || {title} || '::date::' || {date} END)")


# --- dates -----------------------------------------------------------------

ISO_RE = ("^(\\d{4}-\\d{2}-\\d{2})(?:[T ](\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,6})?)?)"
          "(?:Z|[+-]\\d{2}(?::?\\d{2})?)?)?$")

_STRPTIME = {
    "MMMM d, yyyy": ("%B %d, %Y", "^[A-Za-z]+ \\d{1,2}, \\d{4}$"),
    "MMMM d yyyy": ("%B %d %Y", "^[A-Za-z]+ \\d{1,2} \\d{4}$"),
    "MMMM yyyy": ("%B %Y", "^[A-Za-z]+ \\d{4}$"),
    "d MMMM yyyy": ("%d %B %Y", "^\\d{1,2} [A-Za-z]+ \\d{4}$"),
    "yyyy-M-d": ("%Y-%m-%d", "^\\d{4}-\\d{1,2}-\\d{1,2}$"),
    "M/d/yyyy": ("%m/%d/%Y", "^\\d{1,2}/\\d{1,2}/\\d{4}$"),
    "d/M/yyyy": ("%d/%m/%Y", "^\\d{1,2}/\\d{1,2}/\\d{4}$"),
    "MMMM d,yyyy": ("%B %d,%Y", "^[A-Za-z]+ \\d{1,2},\\d{4}$"),
    "MMM d, yyyy": ("%b %d, %Y", "^[A-Za-z]{3} \\d{1,2}, \\d{4}$"),
    "MMM yyyy": ("%b %Y", "^[A-Za-z]{3} \\d{4}$"),
    "M/d/yy": ("%m/%d/%y", "^\\d{1,2}/\\d{1,2}/\\d{2}$"),
}

PROFILES = {
    "listing": (["MMMM d, yyyy", "MMMM d yyyy", "MMMM yyyy", "d MMMM yyyy", "yyyy-M-d", "M/d/yyyy",
                 "d/M/yyyy", "MMMM d,yyyy"], "last", "clean_text", True),
    "news": (["MMMM d, yyyy", "MMMM d yyyy", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy"], "last", "collapse", True),
    "presentation": (["MMMM d, yyyy", "MMM d, yyyy", "yyyy-M-d", "MMMM yyyy", "MMM yyyy"], None, None, False),
    "dashboard": (["MMMM d, yyyy", "M/d/yyyy", "M/d/yy"], "first", None, False),
    "store": (["MMMM d, yyyy", "yyyy-M-d"], "first", "strip", False),
}


ZONE_AFTER_TIME_RE = "([T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,6})?)?)(?:Z|[+-]\\d{2}(?::?\\d{2})?)$"


def parse_iso(x: str) -> str:
    s = blank(x)
    no_zone = f"regexp_replace({s}, {q(ZONE_AFTER_TIME_RE)}, '\\1')"
    return f"(CASE WHEN regexp_matches({s}, {q(ISO_RE)}) THEN try_cast(replace({no_zone}, 'T', ' ') AS TIMESTAMP) END)"


def parse_date(x: str, profile: str = "dashboard") -> str:
    formats, iso, clean, ordinals = PROFILES[profile]
    s = blank(x)
    if clean == "clean_text":
        s = clean_text(s)
    elif clean == "collapse":
        s = collapse(s)
    elif clean == "strip":
        s = pystrip(s)
    if ordinals:
        s = f"regexp_replace({s}, '(\\d)(st|nd|rd|th)', '\\1', 'g')"
    spaced = f"regexp_replace({s}, {q(WS + '+')}, ' ', 'g')"
    edge = f"regexp_matches({s}, {q('^' + WS + '|' + WS + '$')})"
    tries = []
    for f in formats:
        fmt, gate = _STRPTIME[f]
        tries.append(f"(CASE WHEN regexp_matches({spaced}, {q(gate)}) THEN try_strptime({spaced}, {q(fmt)}) END)")
    if clean is None:
        tries = [f"(CASE WHEN NOT {edge} THEN coalesce({', '.join(tries)}) END)"]
    if iso == "first":
        tries = [parse_iso(s)] + tries
    elif iso == "last":
        tries = tries + [parse_iso(s)]
    return f"(CASE WHEN {s} <> '' THEN coalesce({', '.join(tries)}) END)"


def item_date(keys: Sequence[str], profile: str = "dashboard") -> str:
    return "coalesce(" + ", ".join(parse_date(k, profile) for k in keys) + ")"


def fmt_display(ts: str) -> str:
    return f"strftime({ts}, '%B %d, %Y')"


def fmt_raw(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


# --- HTML --------------------------------------------------------------------

ENTITIES = (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"),
            ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'"))


def unescape(x: str) -> str:
    s = blank(x)
    for ent, ch in ENTITIES:
        s = f"replace({s}, {q(ent)}, {ch})"
    return s


def strip_tags(x: str) -> str:
    return f"regexp_replace({blank(x)}, '<[^>]*>', ' ', 'g')"


def tag_text(html: str, tag: str) -> str:
    inner = f"regexp_extract({html}, {q(f'(?is)<{tag}(?:{chr(92)}s[^>]*)?>(.*?)</{tag}{chr(92)}s*>')}, 1)"
    return clean_text(unescape(strip_tags(inner)))


def first_paragraph(html: str) -> str:
    inner = f"regexp_extract({html}, '(?s)<p>(.*?)</p>', 1)"
    return clean_text(unescape(strip_tags(inner)))


# --- quality gates -------------------------------------------------------------

SENTENCE_RE = "[^.!?]*[.!?]"
NOT_WORD = "[^\\p{L}\\p{N}\\p{M}\\p{Pc}]"   # Python/Java-Unicode \\W as an RE2 class
WORD = "[\\p{L}\\p{N}\\p{M}\\p{Pc}]"


def ubound_after(alt: str) -> str:
    """``alt\\b`` for Unicode words: followed by a non-word char or the end."""
    return f"(?:{alt})(?:{NOT_WORD}|$)"


def tokens(x: str) -> str:
    c = collapse(x)
    return f"(CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, ' ') END)"


def word_count(x: str) -> str:
    return f"len({tokens(x)})"


def max_token_count(tok: str) -> str:
    return f"coalesce(list_max(map_values(list_histogram({tok}))), 0)"


def contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"strpos({x}, {q(t)}) > 0" for t in terms) + ")"


def split_sentences(x: str, clean: str = "clean_text") -> str:
    t = clean_text(x) if clean == "clean_text" else collapse(x)
    return (f"list_filter(list_transform(regexp_extract_all({t}, {q(SENTENCE_RE)}), lambda s: trim(s)), "
            f"lambda s: s <> '')")


def first_sentences(x: str, n: int = 2, clean: str = "clean_text") -> str:
    return f"array_to_string(list_slice({split_sentences(x, clean)}, 1, {n}), ' ')"


def sentence_marks(x: str) -> str:
    return f"(length({blank(x)}) - length(regexp_replace({blank(x)}, '[.!?]', '', 'g')))"


def mid_phrase_start(x: str, words) -> str:
    alt = "|".join(words)
    pat = "^[\"'(\\[{]*\\s*" + ubound_after(alt)
    return f"regexp_matches(lower({clean_text(x)}), {q(pat)})"


def _dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def has_gibberish(x: str, variant: str, Q) -> str:
    s = blank(x)
    low = f"lower({s})"
    tok = tokens(low)
    n = f"len({tok})"
    top = max_token_count(tok)
    if variant == "audit":
        return f"({n} >= 5 AND {top} > {n} * {_dbl(0.3)})"
    low_s = pystrip(low)
    if variant == "lenient":
        ends = f"regexp_matches({low_s}, '\\.\\.\\.|\\.+$')"
        rep = f"({n} > 0 AND {top} > {n} * {_dbl(0.4)})"
        tech = contains_any(low_s, Q.TECHNICAL_TERMS_LONG)
        return f"(CASE WHEN {s} = '' THEN FALSE WHEN {ends} THEN TRUE WHEN {rep} THEN NOT {tech} ELSE FALSE END)"
    words = f"regexp_extract_all({low_s}, {q(WORD + '+')})"
    last = f"{words}[-1]"
    allow = ", ".join(q(w) for w in Q.SHORT_WORD_ALLOW)
    short_tail = (f"(len({words}) > 0 AND NOT regexp_matches({low_s}, '[.!?]$') AND length({last}) < 3 "
                  f"AND {last} NOT IN ({allow}))")
    nonsense = (f"(regexp_matches({low_s}, '[a-z]{{20,}}') OR regexp_matches({low_s}, '[0-9]{{10,}}') OR "
                f"regexp_matches({low_s}, {q('[^a-z0-9' + WS_INNER + chr(92) + '.,:;!?' + chr(39) + chr(92) + '-()]{5,}')}))")
    return (f"(CASE WHEN {s} = '' THEN FALSE ELSE (strpos({low_s}, '...') > 0 OR {short_tail} OR "
            f"({n} > 0 AND {top} > {n} * {_dbl(0.3)}) OR {nonsense}) END)")


EMAIL_RE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}"


def has_email(x: str) -> str:
    pat = f"(?:^|{NOT_WORD}){EMAIL_RE}(?:{NOT_WORD}|$)"
    return f"regexp_matches({blank(x)}, {q(pat)})"


URL_NARROW = "(?i)https?://[^" + WS_INNER + "]+|www\\.[^" + WS_INNER + "]+"


def is_uninformative(x: str, variant: str, Q) -> str:
    s = blank(x)
    if variant == "summary":
        norm = clean_text(f"lower({s})")
        urls = f"regexp_extract_all({s}, {q(URL_NARROW)})"
        foreign = (f"(len(list_filter({urls}, lambda u: NOT (starts_with(lower(u), 'https://www.nist.gov') OR "
                   f"starts_with(lower(u), 'http://www.nist.gov')))) > 0)")
        gib = (f"({has_gibberish(s, 'lenient', Q)} AND ({word_count(s)} < 10 OR NOT "
               f"{contains_any(f'lower({s})', Q.TECHNICAL_TERMS_SHORT)}))")
        url_only = f"regexp_matches({pystrip(norm)}, {q('^https?://[^' + WS_INNER + ']*$')})"
        return (f"(CASE WHEN {s} = '' THEN TRUE ELSE ({contains_any(norm, Q.SUMMARY_BAD_INDICATORS)} OR "
                f"{url_only} OR {has_email(s)} OR {foreign} OR {gib}) END)")
    low = pystrip(f"lower({s})")
    forbidden = " OR ".join(f"starts_with({low}, {q(p)})" for p in Q.FORBIDDEN_PREFIXES)
    block = " AND ".join(f"strpos({low}, {q(p)}) > 0" for p in Q.JUNK_SECURITY_BLOCK)
    return (f"(({forbidden}) OR strpos({low}, 'conducted by researchers at the') > 0 OR ({block}) OR "
            f"{contains_any(low, Q.RESEARCHER_MENTIONS)} OR (strpos({low}, 'nist') > 0 AND strpos({low}, 'security concern') > 0) OR "
            f"regexp_matches({low}, {q('^https?://[^' + WS_INNER + ']*$')}) OR "
            f"(length({low}) < 50 AND regexp_matches({low}, 'https?://')) OR {has_email(s)} OR "
            f"{contains_any(low, Q.STRICT_INDICATORS)})")


def complete_sentences(x: str) -> str:
    s = blank(x)
    pieces = f"list_filter(list_transform(string_split_regex({s}, '[.!?]'), lambda p: {pystrip('p')}), lambda p: p <> '')"
    return (f"(length({pystrip(s)}) >= 20 AND len({pieces}) >= 2 AND {word_count(pieces + '[1]')} >= 3 "
            f"AND {word_count(pieces + '[2]')} >= 3)")


URL_BROAD = (
    "(?i)https?://[^" + WS_INNER + "]+", "(?i)www\\.[^" + WS_INNER + "]+",
    f"(?:^|{NOT_WORD})[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+(?:{NOT_WORD}|$)",
    f"(?i)(?:^|{NOT_WORD})doi\\.org/[^" + WS_INNER + "]+",
    f"(?i)(?:^|{NOT_WORD})nist\\.gov/", f"(?i)(?:^|{NOT_WORD})tsapps\\.nist\\.gov/",
    f"(?:^|{NOT_WORD})[a-zA-Z0-9-]+\\.[a-zA-Z]{{2,}}",
)


def mid_phrase(x: str, Q) -> str:
    return mid_phrase_start(x, Q.MID_PHRASE_WORDS)


def valid_summary(x: str, Q) -> str:
    s = blank(x)
    st = pystrip(s)
    any_url = " OR ".join(f"regexp_matches({s}, {q(p)})" for p in URL_BROAD)
    return (f"(length({st}) >= 20 AND NOT ({any_url}) AND NOT (strpos({s}, '://') > 0 OR strpos(lower({s}), 'www.') > 0 "
            f"OR strpos(lower({s}), 'http') > 0) AND NOT regexp_matches(substr({st}, 1, 1), '^\\p{{Ll}}$') "
            f"AND NOT {has_gibberish(s, 'strict', Q)} AND {complete_sentences(s)} AND NOT {mid_phrase(s, Q)} "
            f"AND NOT {is_uninformative(s, 'strict', Q)} AND regexp_matches({st}, '[.!?]$'))")


def bad_summary(x: str, Q) -> tuple[str, str]:
    """(reason_kind, reason) SQL expressions; NULL kind = good."""
    s = pystrip(x)
    low = f"lower({s})"
    sub_hit = "CASE " + " ".join(f"WHEN strpos({low}, {q(b)}) > 0 THEN {q(b)}" for b in Q.BAD_SUBSTRINGS) + " END"
    pats = [p.replace("\\s", WS) for p in Q.BAD_PATTERNS]
    pat_hit = "CASE " + " ".join(f"WHEN regexp_matches({low}, {q(pp)}) THEN {q(p)}" for pp, p in zip(pats, Q.BAD_PATTERNS)) + " END"
    last = f"right({s}, 1)"
    word = f"lower(regexp_extract({s}, {q('(' + WORD + '+)' + chr(92) + '.' + WS + '*$')}, 1))"
    cut_pat = f"(?i)(?:^|{NOT_WORD})[a-z]{{2,6}}\\.{WS}*$"
    abbrevs = ", ".join(q(a) for a in Q.CUT_OFF_ABBREVIATIONS)
    cut = f"(regexp_matches({s}, {q(cut_pat)}) AND {word} <> '' AND {word} IN ({abbrevs}))"
    kind = (f"(CASE WHEN {s} = '' THEN 'empty' WHEN length({s}) < 25 THEN 'too short' "
            f"WHEN ({sub_hit}) IS NOT NULL THEN 'boilerplate' WHEN ({pat_hit}) IS NOT NULL THEN 'boilerplate pattern' "
            f"WHEN {last} NOT IN ('.', '!', '?') THEN 'incomplete' WHEN {cut} THEN 'cut off' END)")
    reason = (f"(CASE WHEN {s} = '' THEN 'empty' WHEN length({s}) < 25 THEN 'too short (' || CAST(length({s}) AS VARCHAR) || ' chars)' "
              f"WHEN ({sub_hit}) IS NOT NULL THEN 'boilerplate: ''' || ({sub_hit}) || '''' "
              f"WHEN ({pat_hit}) IS NOT NULL THEN 'boilerplate pattern: ' || ({pat_hit}) "
              f"WHEN {last} NOT IN ('.', '!', '?') THEN 'incomplete — ends with ''' || {last} || '''' "
              f"WHEN {cut} THEN 'cut off at abbreviation ''' || {word} || '.''' ELSE '' END)")
    return kind, reason


def audit_flags(x: str, Q) -> dict[str, str]:
    s = blank(x)
    st = pystrip(s)
    words = tokens(st)
    lw = f"regexp_replace({words}[-1], '[.,!?;:]+$', '')"
    trunc = (f"(strpos({s}, '...') > 0 OR ({st} <> '' AND NOT regexp_matches({st}, '[.!?]$')) OR "
             f"(len({words}) > 0 AND length({lw}) = 1 AND regexp_matches({lw}, '^\\p{{Lu}}$')) OR "
             f"(len({words}) > 0 AND ends_with({st}, '.') AND length({lw}) <= 3 AND regexp_matches({lw}, '^\\p{{L}}+$')))")
    b1, b2 = f"(?:^|{NOT_WORD})", f"(?:{NOT_WORD}|$)"
    grammar = f"(?i){b1}these{WS}+system{b2}|{b1}thee{b2}|{b1}th{WS}+e{b2}"
    return {
        "url_only": f"regexp_matches({st}, {q('^https?://[^' + WS_INNER + ']+$|^www' + chr(92) + '.[^' + WS_INNER + ']+$')})",
        "has_urls": f"regexp_matches({s}, 'https?://|www\\.')",
        "truncation": trunc,
        "gibberish": has_gibberish(s, "audit", Q),
        "incomplete": f"({sentence_marks(s)} < 2)",
        "boilerplate": contains_any(f"lower({s})", Q.AUDIT_BOILERPLATE),
        "filler": contains_any(f"lower({s})", Q.AUDIT_FILLER),
        "grammar": f"regexp_matches({s}, {q(grammar)})",
    }


def audit_columns(x: str, Q) -> dict[str, str]:
    s = blank(x)
    flags = audit_flags(s, Q)
    marks = sentence_marks(s)
    score = "(CAST(1.0 AS DOUBLE)" + "".join(
        f" - (CASE WHEN {flags[k]} THEN {_dbl(float(w))} ELSE CAST(0.0 AS DOUBLE) END)" for k, _, w in Q.AUDIT_CHECKS) + ")"
    score = f"greatest({score}, CAST(0.0 AS DOUBLE))"
    issues = []
    for k, text, _ in Q.AUDIT_CHECKS:
        label = (q(text.split("{n}")[0]) + f" || CAST({marks} AS VARCHAR) || " + q(text.split("{n}")[1])
                 if "{n}" in text else q(text))
        issues.append(f"CASE WHEN {flags[k]} THEN {label} END")
    issue_list = f"list_filter([{', '.join(issues)}], lambda i: i IS NOT NULL)"
    empty = f"({s} = '')"
    return {
        "status": f"(CASE WHEN {empty} THEN 'FAIL' WHEN {score} >= {_dbl(0.7)} THEN 'PASS' ELSE 'FAIL' END)",
        "score": f"(CASE WHEN {empty} THEN CAST(0.0 AS DOUBLE) ELSE round({score}, 2) END)",
        "issues": f"(CASE WHEN {empty} THEN ['Empty summary'] ELSE {issue_list} END)",
        "sentence_count": f"(CASE WHEN {empty} THEN NULL ELSE {marks} END)",
        "audited": f"(NOT {empty})",
    }


def page_text(html: str) -> str:
    h = (f"regexp_replace({html}, '(?is)<script[^>]*>.*?</script\\s*>|<style[^>]*>.*?</style\\s*>|<!--.*?-->', ' ', 'g')")
    return clean_text(unescape(strip_tags(h)))


def meta_content(html: str, attr: str, name: str) -> str:
    a = f"regexp_extract({html}, {q(f'(?is)<meta{chr(92)}s[^>]*{attr}{chr(92)}s*={chr(92)}s*[{chr(34)}{chr(39)}]{name}[{chr(34)}{chr(39)}][^>]*content{chr(92)}s*={chr(92)}s*{chr(34)}([^{chr(34)}]*){chr(34)}')}, 1)"
    b = f"regexp_extract({html}, {q(f'(?is)<meta{chr(92)}s[^>]*content{chr(92)}s*={chr(92)}s*{chr(34)}([^{chr(34)}]*){chr(34)}[^>]*{attr}{chr(92)}s*={chr(92)}s*[{chr(34)}{chr(39)}]{name}[{chr(34)}{chr(39)}]')}, 1)"
    return clean_text(unescape(f"coalesce(nullif({a}, ''), {b})"))


def word_sub(x: str, word_pat: str, repl: str, flags: str = "i") -> str:
    """``re.sub(r'\\bWORD\\b', repl, x, flags)`` with Unicode word boundaries in RE2.

    The neighbouring non-word characters are captured and put back; a match
    consumes its right neighbour, so a second pass handles occurrences that
    share one boundary character with the previous one.
    """
    pat = f"(?{flags})(^|{NOT_WORD})(?:{word_pat})({NOT_WORD}|$)" if flags else f"(^|{NOT_WORD})(?:{word_pat})({NOT_WORD}|$)"
    r = repl.replace("'", "''")
    once = f"regexp_replace({x}, {q(pat)}, '\\1{r}\\2', 'g')"
    return f"regexp_replace({once}, {q(pat)}, '\\1{r}\\2', 'g')"


def third_person(x: str, Q, variant: str = "summary") -> str:
    s = f"regexp_replace({blank(x)}, {q('(?i)^' + WS + '*summary' + WS + '*[:' + chr(92) + '-]?' + WS + '*')}, '')"
    if variant == "summary":
        s = pystrip(s)
    leads = [
        "(?i)^(this\\s+abstract\\s+outlines(\\s+key\\s+areas(\\s+of)?)?)\\s*[:,]?\\s*",
        "(?i)^(the|this)\\s+(paper|article)\\s+presents\\s*[:,]?\\s*",
        "(?i)^(the|this)\\s+study\\s+presents\\s*[:,]?\\s*",
    ]
    if variant != "summary":
        leads.append("(?i)^(the|this)\\s+abstract\\s+is\\s+about\\s*[:,]?\\s*")
    for p in leads:
        s = f"regexp_replace({s}, {q(p.replace(chr(92) + 's', WS))}, '')"
    if variant == "summary":
        s = pystrip(s)
    verbs = Q.THIRD_PERSON_VERBS_SHORT if variant == "summary" else Q.THIRD_PERSON_VERBS_LONG
    for verb, repl in verbs:
        s = word_sub(s, "we " + verb, repl)
    for w, r in (("our", "their"), ("ours", "theirs"), ("us", "them"), ("I", "The researcher")):
        s = word_sub(s, w, r)
    if variant == "summary":
        s = word_sub(s, "we", "the researchers")
        for term in Q.PUBLISHER_TERMS:
            s = word_sub(s, term, "")
        s = f"regexp_replace({s}, {q('(?i)' + Q.PUBLISHER_NAME)}, '', 'g')"
        return clean_text(s)
    return pystrip(s)


def strip_summary_terms(x: str, Q) -> str:
    s = blank(x)
    for t in Q.PUBLISHER_TERMS:
        s = word_sub(s, t, "")
    s = pystrip(s)
    return pystrip(f"regexp_replace({s}, {q(WS + '{2,}')}, ' ', 'g')")


def strip_contact_info(x: str, Q) -> str:
    email = f"(^|{NOT_WORD}){EMAIL_RE}({NOT_WORD}|$)"
    text = f"regexp_replace({blank(x)}, {q(email)}, '\\1\\2', 'g')"
    found = f"regexp_extract_all(t, {q(SENTENCE_RE)})"
    sents = f"(CASE WHEN len({found}) = 0 THEN [t] ELSE {found} END)"
    keep = (f"array_to_string(list_transform(list_filter(sents, lambda z: NOT "
            f"{contains_any('lower(' + pystrip('z') + ')', Q.CONTACT_PHRASES)}), lambda z: {pystrip('z')}), ' ')")
    surg = "z"
    for ph in Q.CONTACT_PHRASES:
        esc = "".join(("\\" + ch) if not ch.isalnum() and ch != " " else ch for ch in ph)
        surg = f"regexp_replace({surg}, {q('(?i)' + esc)}, '', 'g')"
    surg = f"regexp_replace({surg}, {q(WS + '+')}, ' ', 'g')"
    surg = f"regexp_replace({surg}, {q(chr(92) + '.' + WS + '*' + chr(92) + '.')}, '.', 'g')"
    surg = pystrip(surg)
    cut = (f"array_to_string(list_filter(list_transform(sents, lambda z: {surg}), "
           f"lambda z: z <> '' AND {word_count('z')} > 3), ' ')")
    return (f"(SELECT CASE WHEN {blank(x)} = '' THEN '' WHEN {word_count(pystrip(keep))} < 10 AND len(sents) > 1 "
            f"THEN {pystrip(cut)} ELSE {pystrip(keep)} END FROM (SELECT {sents} AS sents FROM (SELECT {text} AS t) a) b)")
