"""Summary text functions and quality gates (Column -> Column, native expressions).

Every gate works on the whole text in the JVM: sentence splitting is
a linear split, phrase lists are plain substring searches over a text bound once, the
repeated-token share compares a sorted list with itself, and what decides most texts
cheaply (length, ends, a missing ``@``) is tested before any pattern runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (PY_WHITESPACE, WS_CLASS, WS_RUN, ZERO_WIDTH, alternation, any_of, blank, clean_text, collapse_ws, contains_any,
                   folded, has_words, let, pystrip, rewritten, tokens, word_count)

SENTENCE_RE = "[^.!?]*[.!?]"

# ---------------------------------------------------------------------------
# Fixed values (phrase lists, word lists and weights that decide results)
# ---------------------------------------------------------------------------

MID_PHRASE_WORDS = (
    "is", "are", "was", "were", "be", "being", "been", "has", "have", "had", "can", "could",
    "should", "would", "may", "might", "must", "will", "do", "does", "did", "using", "based",
    "focused", "designed", "aimed", "intended", "developed", "built", "created",
)

TECHNICAL_TERMS_LONG = (
    "quantum", "algorithm", "system", "model", "data", "analysis", "research", "study", "method",
    "technique", "performance", "results", "evaluation", "implementation",
)
TECHNICAL_TERMS_SHORT = (
    "quantum", "algorithm", "system", "model", "data", "analysis", "research", "study", "method",
    "technique",
)

SUMMARY_BAD_INDICATORS = (
    "potential security issue", "you are being redirected", "redirecting to",
    "this site is not secure", "javascript disabled", "404", "500", "not found", "access denied",
    "forbidden", "error occurred", "no meaningful content available", "contact us", "contact the",
    "for questions", "if you have questions", "if you have any questions", "encounter issues",
    "issues accessing", "email address", "serves as the point of contact", "point of contact",
)

STRICT_INDICATORS = (
    "potential security issue", "you are being redirected", "redirecting to",
    "this site is not secure", "please enable javascript", "javascript disabled",
    "official websites use .gov", ".gov website",
    "404", "500", "not found", "access denied", "forbidden", "error occurred",
    "no meaningful content available",
    "secure . gov websites use", "lock ( lock", "locked padlock", "httpsa lock",
    "safely connected to the website",
    "contact us", "contact the", "for questions", "if you have questions",
    "if you have any questions", "encounter issues", "issues accessing",
    "email address", "serves as the point of contact", "point of contact",
)

FORBIDDEN_PREFIXES = (
    "this abstract outlines", "this paper presents", "the paper presents", "this article presents",
    "the abstract is about",
)

JUNK_SECURITY_BLOCK = (
    "computer security division", "cryptographic technology", "secure systems and applications",
    "security components and mechanisms", "security engineering and risk management",
    "security testing",
)

RESEARCHER_MENTIONS = (
    "conducted by researchers", "researchers at the", "study conducted by",
    "research conducted by", "authors of the study", "the researchers", "conducted by",
)

SHORT_WORD_ALLOW = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "can", "could", "should", "may", "might", "must", "shall", "it",
    "he", "she", "they", "we", "I", "you", "this", "that", "these", "those", "and", "or", "but", "if",
    "then", "when", "where", "why", "how", "what", "which", "who", "all", "some", "any", "no", "not",
    "yes", "ok", "hi", "bye", "thanks", "please", "sorry", "excuse", "me", "my", "your", "his",
    "her", "its", "our", "their",
)

CONTACT_PHRASES = (
    "contact us", "contact the", "for questions", "if you have questions",
    "if you have any questions", "encounter issues", "issues accessing",
    "email address", "serves as the point of contact", "point of contact",
    "please contact", "reach out", "get in touch", "contact support",
)

BAD_SUBSTRINGS = (
    "secure .gov", ".gov websites use https", "a lock (", "lock a locked padlock", "locked padlock",
    "means you've safely connected", "means you've safely connected", "safely connected to the .",
    "official website of the united states", "you are being redirected", "redirecting to",
    "please enable javascript", "javascript disabled", "this site is not secure",
    "potential security issue",
    "access denied", "403 forbidden", "404 not found", "500 internal server", "error occurred",
    "not found",
    "no meaningful content available", "summary generation failed", "no content available",
)

BAD_PATTERNS = (
    "https?://\\s+means\\s+you",
    "a\\s+lock\\s*\\(",
    "locked\\s+padlock",
    "secure\\s*\\.?\\s*gov\\s+websites",
    "safely\\s+connected\\s+to\\s+the\\s+\\.",
)

CUT_OFF_ABBREVIATIONS = (
    "lith", "alum", "approx", "temp", "freq", "max", "min", "avg", "std", "dept", "univ", "inst",
    "corp", "fig", "vol", "eq", "ref", "sec", "tech", "mech", "chem",
)

AUDIT_BOILERPLATE = (
    "applied cybersecurity division",
    "national cybersecurity center of excellence",
    "ncce and nice focus on cybersecurity",
    "this dual effort aims to enhance",
    "practical solutions and education",
    "conducted by researchers at the",
    "an official website of the united states government",
)
AUDIT_FILLER = (
    "has progressed significantly", "impacted various aspects", "increasingly integrated",
    "growing need to", "various aspects of their daily life",
)
AUDIT_GRAMMAR = ("\\bthese\\s+system\\b", "\\bthee\\b", "\\bth\\s+e\\b")

# (issue text, report key, weight) in the order the audit applies them.
AUDIT_CHECKS = (
    ("url_only", "❌ URL-ONLY: Summary is just a URL", 1.0),
    ("has_urls", "❌ URL CONTAMINATION: Summary contains URLs", 0.15),
    ("truncation", "❌ TRUNCATION: Summary ends mid-word or with ellipsis", 0.20),
    ("gibberish", "❌ GIBBERISH: Excessive token repetition detected", 0.20),
    ("incomplete", "❌ INCOMPLETE: Only {n} sentence(s) (need 2+)", 0.25),
    ("boilerplate", "⚠️  BOILERPLATE: Generic filler detected", 0.15),
    ("filler", "⚠️  GENERIC AI: Irrelevant generic AI filler", 0.15),
    ("grammar", "⚠️  GRAMMAR: Grammar errors detected", 0.10),
)
AUDIT_PASS = 0.70
EMPTY_ISSUE = "Empty summary"

# Third-person rewrites: (verb, rewritten phrase) for "we <verb>".
THIRD_PERSON_VERBS_SHORT = (
    ("present", "The study presents"), ("propose", "The study proposes"),
    ("show", "The study shows"), ("develop", "The study develops"),
    ("introduce", "The study introduces"),
)
THIRD_PERSON_VERBS_LONG = (
    ("present", "The study presents"), ("propose", "The study proposes"),
    ("introduce", "The study introduces"), ("demonstrate", "The study demonstrates"),
    ("develop", "The study develops"), ("show", "The study shows"),
    ("analyze", "The study analyzes"), ("investigate", "The study investigates"),
    ("evaluate", "The study evaluates"), ("explore", "The study explores"),
    ("describe", "The study describes"), ("report", "The study reports"),
    ("find", "The study finds"), ("conclude", "The study concludes"),
    ("discuss", "The study discusses"), ("provide", "The study provides"),
    ("examine", "The study examines"), ("compare", "The study compares"),
    ("implement", "The study implements"), ("test", "The study tests"),
    ("build", "The study builds"), ("create", "The study creates"),
)
PUBLISHER_TERMS = ("NIST",)
PUBLISHER_NAME = "National Institute of Standards and Technology"

EMAIL_RE = "(?U)\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b"
URL_NARROW_RE = "(?i)https?://[^\\s]+|www\\.[^\\s]+"
URL_BROAD_RES = (
    "(?i)https?://[^\\s]+", "(?i)www\\.[^\\s]+", "\\b\\d+\\.\\d+\\.\\d+\\.\\d+\\b",
    "(?i)\\bdoi\\.org/[^\\s]+", "(?i)\\bnist\\.gov/[^\\s]*", "(?i)\\btsapps\\.nist\\.gov/[^\\s]*",
    "\\b[a-zA-Z0-9-]+\\.[a-zA-Z]{2,}(?:/[^\\s]*)?",
)


def _py_ws(pattern: str) -> str:
    """Swap ``\\s`` / ``[^\\s]`` for Python's Unicode whitespace class."""
    inner = WS_CLASS[1:-1]
    return (pattern.replace("[^\\s]", "[^" + inner + "]")
                   .replace("\\s", WS_CLASS))


# ---------------------------------------------------------------------------
# Sentences
# ---------------------------------------------------------------------------

def sentence_pieces(text: Column) -> Column:
    """The ``[^.!?]*[.!?]`` matches of ``text``, found in linear time.

    Splitting right after each terminator yields exactly those runs plus the
    unterminated tail, which is dropped.  (A regex ``find`` loop would rescan
    a long unterminated tail from every start position.)
    """
    parts = F.split(text, "(?<=[.!?])")
    return F.filter(parts, lambda p: F.substring(p, -1, 1).isin(".", "!", "?"))


def split_sentences(c, *, clean: str = "clean_text") -> Column:
    """All ``[^.!?]*[.!?]`` pieces, trimmed, non-empty; an unterminated tail is lost."""
    text = clean_text(c) if clean == "clean_text" else collapse_ws(c)
    return F.filter(F.transform(sentence_pieces(text), lambda s: F.trim(s)), lambda s: s != "")


def first_sentences(c, n: int = 2, *, clean: str = "clean_text") -> Column:
    """The first ``n`` whole sentences joined by a space; '' when there are none.

    Only the part of the text up to the ``n``-th terminator is cleaned and split.
    """
    return F.array_join(split_sentences(sentence_head(c, n), clean=clean), " ")


def sentence_head(c, n: int = 2) -> Column:
    """The text up to its ``n``-th terminator (to its last one if it has fewer), as it is."""
    return F.regexp_extract(blank(c), "^(?:[^.!?]*+[.!?]){1,%d}" % n, 0)


def limit_two_sentences(c) -> Column:
    """Model-output variant: the first two raw pieces joined as found (then stripped);
    one piece alone; no terminated piece at all -> the text stripped, plus '.'
    when it does not end in '.!?'."""
    s = blank(c)
    pieces = sentence_pieces(s)
    st = pystrip(s)
    return (F.when(s == "", F.lit(""))
             .when(F.size(pieces) >= 2, pystrip(F.array_join(F.slice(pieces, 1, 2), " ")))
             .when(F.size(pieces) == 1, pystrip(pieces.getItem(0)))
             .otherwise(F.concat(st, F.when(st.rlike("[.!?]$"), F.lit("")).otherwise(F.lit(".")))))


def sentence_marks(c) -> Column:
    """Number of ``[^.!?]*[.!?]`` matches, i.e. of '.', '!' and '?' characters."""
    s = blank(c)
    return (F.length(s) - F.length(F.regexp_replace(s, "[.!?]", ""))).cast("long")


def mid_phrase_start(c) -> Column:
    """First sentence starts (after quotes/brackets) with an auxiliary verb or participle.

    Anchored on the lower-cased text as it is: white space and invisible characters are
    stepped over where cleaning would drop them, so the rest of the text is not touched.
    """
    unseen = "[" + ZERO_WIDTH + "]*+"
    skipped = "[" + WS_CLASS[1:-1] + ZERO_WIDTH + "]*+"
    words = "|".join(unseen.join(w) for w in MID_PHRASE_WORDS)
    return F.lower(blank(c)).rlike(f"(?U)^{skipped}(?:[\"'(\\[{{]{unseen})*+{skipped}(?:{words}){unseen}(?!\\w)")


def truncate_sentence(c, max_chars: int = 800) -> Column:
    """Cut to ``max_chars`` at the last sentence end inside the cut."""
    s = pystrip(c)
    snippet = F.substring(s, 1, max_chars)
    cut = F.regexp_replace(snippet, "([.!?])[^.!?]*$", "$1")
    return F.when((s == "") | (F.length(s) <= max_chars), s).otherwise(pystrip(cut))


# ---------------------------------------------------------------------------
# URLs and contact details
# ---------------------------------------------------------------------------

def extract_urls(c, mode: str = "narrow") -> Column:
    s = blank(c)
    if mode == "narrow":
        return F.regexp_extract_all(s, F.lit(_py_ws(URL_NARROW_RE)), 0)
    found = [F.regexp_extract_all(s, F.lit(_py_ws(p)), 0) for p in URL_BROAD_RES]
    return F.array_distinct(F.flatten(F.array(*found)))


def has_urls(c, mode: str = "broad") -> Column:
    """Any URL-like token (one regex pass, only over texts with ``://`` or a dot inside a word)."""
    pats = [p.replace("(?i)", "") for p in (URL_BROAD_RES if mode == "broad" else URL_NARROW_RE.split("|"))]
    whole = "(?i)(?:" + "|".join(_py_ws(p) for p in pats) + ")"
    return let(blank(c), lambda s: (F.contains(s, F.lit("://")) | s.rlike(_py_ws("\\.[^\\s]"))) & s.rlike(whole))


def strip_urls(c, mode: str = "narrow") -> Column:
    s = blank(c)
    if mode == "narrow":
        pats = URL_NARROW_RE.split("|")
        pats = [pats[0], "(?i)" + pats[1]]
    else:
        pats = list(URL_BROAD_RES)
        pats[2] = "\\b\\d+\\.\\d+\\.\\d+\\.\\d+\\b"
    for p in pats:
        s = F.regexp_replace(s, _py_ws(p), "")
    return collapse_ws(s)


def strip_contact_info(c) -> Column:
    """Drop e-mails and sentences with a contact phrase; if too little remains, cut the phrases only.

    Text, sentences and the first result are each bound once; the e-mail pattern runs
    only where there is an ``@``.
    """
    def surgical(s):
        out = s
        for phrase in CONTACT_PHRASES:      # removed one phrase after another, in list order
            out = F.regexp_replace(out, "(?i)" + alternation([phrase]), "")
        out = F.regexp_replace(out, WS_RUN, " ")
        out = F.regexp_replace(out, "\\." + WS_CLASS + "*\\.", ".")
        return pystrip(out)

    def of_sentences(text, sentences):
        # sentences are searched one by one only where the text has a phrase at all
        kept = F.when(contains_any(F.lower(text), CONTACT_PHRASES), F.filter(
            sentences, lambda s: ~contains_any(F.lower(s), CONTACT_PHRASES))).otherwise(sentences)
        whole = pystrip(F.array_join(F.transform(kept, lambda s: pystrip(s)), " "))
        cut = F.filter(F.transform(sentences, surgical), lambda s: (s != "") & (word_count(s) > 3))
        return let(whole, lambda result: F.when(
            ~has_words(result, 10) & (F.size(sentences) > 1), pystrip(F.array_join(cut, " "))).otherwise(result))

    def of_text(text):
        return let(sentence_pieces(text), lambda found: let(
            F.when(F.size(found) == 0, F.array(text)).otherwise(found), lambda sentences: of_sentences(text, sentences)))

    return let(blank(c), lambda s: F.when(s == "", F.lit("")).otherwise(let(
        F.when(F.instr(s, "@") > 0, F.regexp_replace(s, EMAIL_RE, "")).otherwise(s), of_text)))


# ---------------------------------------------------------------------------
# Third person
# ---------------------------------------------------------------------------

def third_person(c, variant: str = "summary") -> Column:
    """Rewrite first-person phrasing into the third person.

    ``summary`` applies the 5-verb rule set with publisher removal and final
    whitespace clean-up; ``model`` the 22-verb set used on generated text.
    """
    s = blank(c)
    s = F.regexp_replace(s, "(?i)^" + WS_CLASS + "*summary" + WS_CLASS + "*[:\\-]?" + WS_CLASS + "*", "")
    if variant == "summary":
        s = pystrip(s)
    lead = [
        "(?i)^(this\\s+abstract\\s+outlines(\\s+key\\s+areas(\\s+of)?)?)\\s*[:,]?\\s*",
        "(?i)^(the|this)\\s+(paper|article)\\s+presents\\s*[:,]?\\s*",
        "(?i)^(the|this)\\s+study\\s+presents\\s*[:,]?\\s*",
    ]
    if variant != "summary":
        lead.append("(?i)^(the|this)\\s+abstract\\s+is\\s+about\\s*[:,]?\\s*")
    for p in lead:
        s = F.regexp_replace(s, _py_ws(p), "")
    if variant == "summary":
        s = pystrip(s)
    verbs = THIRD_PERSON_VERBS_SHORT if variant == "summary" else THIRD_PERSON_VERBS_LONG
    rules = [("we " + verb, "(?iU)\\bwe " + verb + "\\b", repl) for verb, repl in verbs]
    rules += [("our", "(?iU)\\bour\\b", "their"), ("ours", "(?iU)\\bours\\b", "theirs"),
              ("us", "(?iU)\\bus\\b", "them"), ("i", "(?iU)\\bI\\b", "The researcher")]
    if variant != "summary":
        return pystrip(rewritten(s, rules))
    rules.append(("we", "(?iU)\\bwe\\b", "the researchers"))
    rules += [(term.lower(), "(?iU)\\b" + term + "\\b", "") for term in PUBLISHER_TERMS]
    dropped = rewritten(s, rules)
    # dropping a term may bring the name's parts together, so the name is looked for afterwards
    return clean_text(rewritten(dropped, [(PUBLISHER_NAME.lower(), "(?i)" + PUBLISHER_NAME, "")]))


# ---------------------------------------------------------------------------
# Gibberish and informativeness
# ---------------------------------------------------------------------------

def repeats_over(tok: Column, share: float) -> Column:
    """Some token makes up more than ``share`` of the list: in the sorted list it is found again that many places on."""
    least = (F.floor(F.size(tok) * F.lit(share)) + 1).cast("int")
    return (F.size(tok) > 0) & let(F.sort_array(tok), lambda order: F.exists(
        F.zip_with(order, F.slice(order, least, F.size(order)), lambda a, b: a.eqNullSafe(b)), lambda same: same))


def has_gibberish(c, variant: str = "audit") -> Column:
    """Three named variants: ``audit``, ``strict`` and ``lenient`` (see README)."""
    return let(blank(c), lambda s: let(F.lower(s), lambda low: let(
        tokens(low), lambda tok: _has_gibberish(s, low, tok, variant))))


def _has_gibberish(s: Column, low: Column, tok: Column, variant: str) -> Column:
    n = F.size(tok)
    if variant == "audit":
        return (n >= 5) & repeats_over(tok, 0.3)
    if variant == "lenient":
        low_s = low
        ends = low_s.rlike("\\.\\.\\.|\\.+" + WS_CLASS + "*$")
        repeated = repeats_over(tok, 0.4)
        technical = contains_any(low_s, TECHNICAL_TERMS_LONG)
        return F.when(s == "", F.lit(False)).when(ends, F.lit(True)).when(
            repeated, ~technical).otherwise(F.lit(False))
    if variant == "strict":
        low_s = pystrip(low)
        # last \w+ run, read from the reversed text so the regex is anchored
        last_word = F.reverse(F.regexp_extract(F.reverse(low_s), "(?U)^\\W*(\\w+)", 1))
        ends_punct = low_s.rlike("[.!?]$")
        short_tail = ((last_word != "") & ~ends_punct & (F.length(last_word) < 3)
                      & ~last_word.isin(*SHORT_WORD_ALLOW))
        # 5+ characters in a row outside [a-z0-9 whitespace .,:;!?'-()]: allowed characters
        # become spaces (itself allowed) by a character table, then any 5 non-spaces in a
        # row are 5 disallowed ones.
        allowed = "abcdefghijklmnopqrstuvwxyz0123456789.,:;!?'-()" + PY_WHITESPACE
        allowed_to_space = F.translate(low_s, allowed, " " * len(allowed))
        nonsense = (low_s.rlike("[a-z]{20,}") | low_s.rlike("\\d{10,}")
                    | allowed_to_space.rlike("[^ ]{5}"))
        return F.when(s == "", F.lit(False)).otherwise(
            low_s.contains("...") | short_tail | nonsense | repeats_over(tok, 0.3))
    raise ValueError(f"unknown gibberish variant {variant!r}")


def _uninformative(s: Column, norm: Column) -> Column:
    """The ``summary`` tests on a text and its lower-cased cleaned form; patterns run only where they can match."""
    foreign = F.exists(extract_urls(s, "narrow"), lambda u: ~(F.lower(u).startswith("https://www.nist.gov")
                                                              | F.lower(u).startswith("http://www.nist.gov")))
    linked = (F.instr(norm, "http") > 0) | (F.instr(norm, "www.") > 0)
    # most texts are long and technical: only the others are cut into tokens and sorted
    gibberish = (~has_words(s, 10) | ~contains_any(F.lower(s), TECHNICAL_TERMS_SHORT)) & has_gibberish(s, "lenient")
    return (contains_any(norm, SUMMARY_BAD_INDICATORS)
            | pystrip(norm).rlike(_py_ws("^https?://[^\\s]*$"))
            | ((F.instr(s, "@") > 0) & s.rlike(EMAIL_RE))
            | (linked & foreign)
            | gibberish)


def is_uninformative(c, variant: str = "summary") -> Column:
    """``summary``: error/contact phrases, URL-only, e-mail, foreign URL, gibberish.
    ``strict``: adds forbidden leads, keyword block and researcher mentions."""
    s = blank(c)
    if variant == "summary":
        return let(s, lambda text: F.when(text == "", F.lit(True)).otherwise(
            let(clean_text(F.lower(text)), lambda norm: _uninformative(text, norm))))
    if variant == "strict":
        return let(s, lambda text: let(pystrip(F.lower(text)), lambda low: _strictly_uninformative(text, low)))
    raise ValueError(f"unknown variant {variant!r}")


def _strictly_uninformative(s: Column, low: Column) -> Column:
    block = F.lit(True)
    for p in JUNK_SECURITY_BLOCK:
        block = block & F.contains(low, F.lit(p))
    return (any_of(low.startswith(p) for p in FORBIDDEN_PREFIXES)
            | F.contains(low, F.lit("conducted by researchers at the"))
            | block
            | contains_any(low, RESEARCHER_MENTIONS)
            | (F.contains(low, F.lit("nist")) & F.contains(low, F.lit("security concern")))
            | low.rlike(_py_ws("^https?://[^\\s]*$"))
            | ((F.length(low) < 50) & low.rlike("https?://"))
            | ((F.instr(s, "@") > 0) & s.rlike(EMAIL_RE))
            | contains_any(low, STRICT_INDICATORS))


def complete_sentences(c) -> Column:
    """At least 20 chars, two pieces between '.!?', the first two with 3+ words each."""
    return let(blank(c), _complete_sentences)


def _complete_sentences(s: Column) -> Column:
    pieces = F.filter(F.transform(F.split(s, "[.!?]"), lambda p: pystrip(p)), lambda p: p != "")
    return (F.length(pystrip(s)) >= 20) & let(F.slice(pieces, 1, 2), lambda two: (F.size(two) == 2) & F.forall(two, lambda p: word_count(p) >= 3))


def valid_summary(c) -> Column:
    """Generated-summary gate: all checks must pass; the text is bound once and cheap checks come first."""
    return let(blank(c), lambda s: let(pystrip(s), lambda st: _valid_summary(s, st)))


def _valid_summary(s: Column, st: Column) -> Column:
    low = F.lower(s)
    return ((F.length(st) >= 20)
            & F.substring(st, -1, 1).isin(".", "!", "?")
            & ~F.substring(st, 1, 1).rlike("^\\p{Ll}$")
            & ~(F.contains(s, F.lit("://")) | F.contains(low, F.lit("www.")) | F.contains(low, F.lit("http")))
            & ~mid_phrase_start(s)
            & _complete_sentences(s)
            & ~is_uninformative(s, "strict")
            & ~has_urls(s, "broad")
            & ~has_gibberish(s, "strict"))


def bad_summary(c) -> Column:
    """struct(is_bad, reason, reason_kind): first failing cache-cleanup rule."""
    return let(pystrip(blank(c)), lambda s: let(F.lower(s), lambda low: _bad_summary(s, low)))


def _pattern_hit(low: Column) -> Column:
    """First bad pattern found; a pattern runs only over texts with its last long word."""
    def hit(p: str) -> Column:
        word = re.findall("[a-z]{4,}", re.sub(r"\\.", " ", p))[-1]
        return F.contains(low, F.lit(word)) & low.rlike(_py_ws(p))
    return F.coalesce(*[F.when(hit(p), F.lit(p)) for p in BAD_PATTERNS])


def _bad_summary(s: Column, low: Column) -> Column:
    long_enough = F.length(s) >= 25
    sub_hit = F.coalesce(*[F.when(F.contains(low, F.lit(sub)), F.lit(sub)) for sub in BAD_SUBSTRINGS])
    return let(F.when(long_enough, sub_hit), lambda sub: let(F.when(long_enough & sub.isNull(), _pattern_hit(low)), lambda pat: _bad_kind(s, sub, pat)))


def _bad_kind(s: Column, sub: Column, pat: Column) -> Column:
    last_char = F.substring(s, -1, 1)
    # the word before a last full stop, read from the end so that the pattern is anchored
    word = F.lower(F.reverse(F.regexp_extract(F.reverse(s), "(?U)^\\.(\\w+)", 1)))
    kind = (F.when(s == "", F.lit("empty"))
             .when(F.length(s) < 25, F.lit("too short"))
             .when(sub.isNotNull(), F.lit("boilerplate"))
             .when(pat.isNotNull(), F.lit("boilerplate pattern"))
             .when(~last_char.isin(".", "!", "?"), F.lit("incomplete"))
             .when(word.isin(*CUT_OFF_ABBREVIATIONS), F.lit("cut off")))
    return let(kind, lambda k: F.struct(
        k.isNotNull().alias("is_bad"),
        (F.when(k == "empty", F.lit("empty"))
          .when(k == "too short", F.concat(F.lit("too short ("), F.length(s).cast("string"), F.lit(" chars)")))
          .when(k == "boilerplate", F.concat(F.lit("boilerplate: '"), sub, F.lit("'")))
          .when(k == "boilerplate pattern", F.concat(F.lit("boilerplate pattern: "), pat))
          .when(k == "incomplete", F.concat(F.lit("incomplete — ends with '"), last_char, F.lit("'")))
          .when(k == "cut off", F.concat(F.lit("cut off at abbreviation '"), word, F.lit(".'")))
          .otherwise(F.lit(""))).alias("reason"),
        F.coalesce(k, F.lit("")).alias("reason_kind")))


def _audit_flags(s: Column) -> dict[str, Column]:
    st = pystrip(s)
    low = F.lower(s)
    # the last token without its punctuation, read from the end
    last = F.reverse(F.regexp_extract(F.reverse(st), "^[^" + WS_CLASS[1:-1] + "]+", 0))
    truncation = s.contains("...") | let(F.regexp_replace(last, "[.,!?;:]+$", ""), lambda word: (st != "") & (
        ~st.rlike("[.!?]$") | word.rlike("^\\p{Lu}$") | (st.endswith(".") & word.rlike("^\\p{L}{1,3}$"))))
    return {
        "url_only": st.rlike("^https?://\\S+$|^www\\.\\S+$".replace("\\S", "[^" + WS_CLASS[1:-1] + "]")),
        "has_urls": s.rlike("https?://|www\\."),
        "truncation": truncation,
        "gibberish": has_gibberish(s, "audit"),
        "incomplete": sentence_marks(s) < 2,
        "boilerplate": contains_any(low, AUDIT_BOILERPLATE),
        "filler": contains_any(low, AUDIT_FILLER),
        # a cheap pattern for what all grammar patterns begin with goes first
        "grammar": folded(s).rlike("th(?:e[se]|" + WS_CLASS + "+e)") & s.rlike("(?iU)" + "|".join(_py_ws(p) for p in AUDIT_GRAMMAR)),
    }


def audit_summary(c) -> Column:
    """struct(status, score, issues, sentence_count, audited).

    Score starts at 1.0 and loses each failed check's weight in order, as
    doubles; PASS is decided on the unrounded score, then it is rounded to 2
    places.  An empty text is FAIL / 0.0 and ``audited`` false (it is left out
    of the report).  Every check is evaluated once per text.
    """
    def with_flags(s):
        flags = _audit_flags(s)
        packed = F.struct(*[flags[k].alias(k) for k, _, _ in AUDIT_CHECKS],
                          sentence_marks(s).alias("marks"), (s == "").alias("empty"))
        return let(packed, _audit_from_flags)

    return let(blank(c), with_flags)


def _audit_from_flags(f: Column) -> Column:
    marks = f["marks"]
    # x - 0.0 == x exactly, so subtracting every weight-or-zero in order equals
    # subtracting only the failed checks' weights in order.
    score = F.lit(1.0)
    issues = []
    for key, text, weight in AUDIT_CHECKS:
        score = score - F.when(f[key], F.lit(float(weight))).otherwise(F.lit(0.0))
        label = (F.concat(F.lit(text.split("{n}")[0]), marks.cast("string"), F.lit(text.split("{n}")[1]))
                 if "{n}" in text else F.lit(text))
        issues.append(F.when(f[key], label))
    score = F.greatest(score, F.lit(0.0))
    empty = f["empty"]
    return F.struct(
        F.when(empty, F.lit("FAIL")).when(score >= F.lit(AUDIT_PASS), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.when(empty, F.lit(0.0)).otherwise(F.round(score, 2)).alias("score"),
        F.when(empty, F.array(F.lit(EMPTY_ISSUE))).otherwise(F.array_compact(F.array(*issues))).alias("issues"),
        F.when(empty, F.lit(None).cast("long")).otherwise(marks).alias("sentence_count"),
        (~empty).alias("audited"),
    )


def issue_key(issue: Column) -> Column:
    """Report key of an issue: the text before its first ':'."""
    return F.substring_index(issue, ":", 1)


def clean_summary(c) -> Column:
    """gate -> third person -> first two sentences -> gate again; '' on any failure."""
    return let(blank(c), lambda s: F.when((s == "") | is_uninformative(s, "summary"), F.lit("")).otherwise(
        let(first_sentences(third_person(s, "summary"), 2), lambda two: F.when(
            is_uninformative(two, "summary") | mid_phrase_start(two), F.lit("")).otherwise(two))))


def is_padded(summary, abstract) -> Column:
    """Summary longer than half of an abstract of 30+ words."""
    sw = word_count(summary)
    aw = word_count(abstract)
    return ((blank(summary) != "") & (blank(abstract) != "") & (aw > 30) & (sw > aw * F.lit(0.5)))


def first_sentence_or_text(c) -> Column:
    """First whole sentence, or the text itself plus '.' when it has none."""
    first = F.try_element_at(split_sentences(c), F.lit(1))
    s = pystrip(c)
    return F.when(F.size(split_sentences(c)) > 0, first).when(
        s == "", F.lit("")).otherwise(F.concat(s, F.when(s.rlike("[.!?]$"), F.lit("")).otherwise(F.lit("."))))


def strip_summary_terms(c, terms: Sequence[str] = PUBLISHER_TERMS) -> Column:
    """Display clean-up that drops the publisher's name and squeezes spaces."""
    s = blank(c)
    for t in terms:
        s = F.regexp_replace(s, "(?iU)\\b" + t + "\\b", "")
    s = pystrip(s)
    return pystrip(F.regexp_replace(s, WS_CLASS + "{2,}", " "))
