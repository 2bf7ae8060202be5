"""Date functions: profile-driven parsing, display formats, item/notification dates.

All results are ``TIMESTAMP_NTZ``: the source data carries naive local times and
zone suffixes are dropped, never converted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, WS_RUN, blank, let, clean_text, collapse_ws, col_, first_nonempty, normalize_text, pystrip

# ISO-8601 date, optional time (T or space) and optional zone, which is dropped.
ISO_RE = ("^(\\d{4}-\\d{2}-\\d{2})(?:[T ](\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,6})?)?)"
          "(?:Z|[+-]\\d{2}(?::?\\d{2})?)?)?$")
ORDINAL_RE = "(\\d)(st|nd|rd|th)"
TWO_DIGIT_YEAR_RE = "^(\\d{1,2})/(\\d{1,2})/(\\d{2})$"

# The five parse profiles, formats tried in order.  ``iso`` says
# where the ISO branch sits; ``clean`` how the input is tidied first;
# ``ordinals`` whether "19th" becomes "19".
PROFILES: dict[str, dict] = {
    "listing": {
        "formats": ["MMMM d, yyyy", "MMMM d yyyy", "MMMM yyyy", "d MMMM yyyy",
                    "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "MMMM d,yyyy"],
        "iso": "last", "clean": "clean_text", "ordinals": True,
    },
    "news": {
        "formats": ["MMMM d, yyyy", "MMMM d yyyy", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy"],
        "iso": "last", "clean": "collapse", "ordinals": True,
    },
    "presentation": {
        "formats": ["MMMM d, yyyy", "MMM d, yyyy", "yyyy-M-d", "MMMM yyyy", "MMM yyyy"],
        "iso": None, "clean": None, "ordinals": False,
    },
    "dashboard": {
        "formats": ["MMMM d, yyyy", "M/d/yyyy", "M/d/yy"],
        "iso": "first", "clean": None, "ordinals": False,
    },
    "store": {
        "formats": ["MMMM d, yyyy", "yyyy-M-d"],
        "iso": "first", "clean": "strip", "ordinals": False,
    },
}

# Key lists used by the dashboard.
NEWS_DATE_KEYS = ("last_edited_date_raw", "last_edited_date", "publish_date_raw", "publish_date")
PUBLICATION_DATE_KEYS = ("release_date_raw", "release_date")
PRESENTATION_DATE_KEYS = ("release_date",)
NOTIFICATION_ITEM_DATE_KEYS = ("release_date_raw", "release_date", "last_edited_date_raw",
                               "last_edited_date", "publish_date_raw", "publish_date")
DATE_TOKEN_KEYS = ("release_date_raw", "edited_date_raw", "last_edited_date_raw", "publish_date_raw",
                   "release_date", "edited_date", "last_edited_date", "publish_date")
DUE_DATE_KEYS = ("comment_due_date_raw", "comment_due_date")


ZONE_AFTER_TIME_RE = "([T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,6})?)?)(?:Z|[+-]\\d{2}(?::?\\d{2})?)$"


def parse_iso(c) -> Column:
    """``datetime.fromisoformat`` for date / date-time strings; zone dropped."""
    s = blank(c)
    no_zone = F.regexp_replace(s, ZONE_AFTER_TIME_RE, "$1")
    return F.when(s.rlike(ISO_RE), no_zone.try_cast("timestamp_ntz"))


def _strptime(s: Column, fmt: str) -> Column:
    if fmt == "M/d/yy":
        # Python's %y: 69-99 -> 19xx, 00-68 -> 20xx.
        yy = F.regexp_extract(s, TWO_DIGIT_YEAR_RE, 3)
        year = F.when(yy.cast("int") >= 69, F.concat(F.lit("19"), yy)).otherwise(F.concat(F.lit("20"), yy))
        text = F.concat(year, F.lit("-"), F.regexp_extract(s, TWO_DIGIT_YEAR_RE, 1), F.lit("-"),
                        F.regexp_extract(s, TWO_DIGIT_YEAR_RE, 2))
        return F.when(s.rlike(TWO_DIGIT_YEAR_RE), F.try_to_date(text, "yyyy-M-d").cast("timestamp_ntz"))
    # every strptime format here is date-only: a DATE has no zone to apply
    return F.try_to_date(s, fmt).cast("timestamp_ntz")


def parse_date(c, profile: str = "dashboard") -> Column:
    """First format of the profile that parses, else NULL (``TIMESTAMP_NTZ``)."""
    spec = PROFILES[profile]
    raw = blank(c)
    if spec["clean"] == "clean_text":
        s = clean_text(raw)
    elif spec["clean"] == "collapse":
        s = collapse_ws(raw)
    elif spec["clean"] == "strip":
        s = pystrip(raw)
    else:
        s = raw
    if spec["ordinals"]:
        s = F.regexp_replace(s, ORDINAL_RE, "$1")
    # strptime reads a format space as "one or more whitespace"; input with
    # leading or trailing whitespace never matches.  The cleaned text is bound
    # once (``let``) instead of being re-cleaned for every format tried.
    def attempt(v):
        s, spaced = v["s"], v["spaced"]
        tries = [_strptime(spaced, f).cast("timestamp_ntz") for f in spec["formats"]]
        if spec["clean"] is None:
            edge_ws = s.rlike("^" + WS_CLASS + "|" + WS_CLASS + "$")
            tries = [F.when(~edge_ws, F.coalesce(*tries))]
        if spec["iso"] == "first":
            tries = [parse_iso(s)] + tries
        elif spec["iso"] == "last":
            tries = tries + [parse_iso(s)]
        return F.when(s != "", F.coalesce(*tries)).cast("timestamp_ntz")

    return let(s, lambda sv: let(F.struct(sv.alias("s"), F.regexp_replace(sv, WS_RUN, " ").alias("spaced")), attempt))


NTZ_EPOCH = "1970-01-01 00:00:00"


def ntz_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp, independent of the session time zone.

    (Casting a naive timestamp to an instant would apply the session zone and
    shift by an hour across daylight-saving changes.)
    """
    return F.timestamp_diff("MICROSECOND", F.lit(NTZ_EPOCH).cast("timestamp_ntz"), col_(c).cast("timestamp_ntz"))


def format_date(ts, style: str = "display") -> Column:
    """``display`` -> 'March 06, 2026'; ``raw`` -> '2026-03-06'."""
    pattern = {"display": "MMMM dd, yyyy", "raw": "yyyy-MM-dd"}[style]
    return F.date_format(col_(ts), pattern)


def item_date(keys: Sequence[str], profile: str = "dashboard") -> Column:
    """First **parseable** value over an ordered key list."""
    return F.coalesce(*[parse_date(k, profile) for k in keys])


def date_token(keys: Sequence[str] = DATE_TOKEN_KEYS) -> Column:
    """First **non-empty** value over the identity date keys, normalised."""
    return normalize_text(first_nonempty(*keys))


def normalize_item_dates(df, pairs: Sequence[tuple[str, str | None]], profile: str = "dashboard"):
    """Rewrite each (display, raw) pair from ``raw or display`` when it parses."""
    out = df
    for display_key, raw_key in pairs:
        source = first_nonempty(raw_key, display_key) if raw_key else blank(display_key)
        parsed = parse_date(source, profile)
        cols = {display_key: F.when(parsed.isNotNull(), format_date(parsed, "display")).otherwise(F.col(display_key))}
        if raw_key:
            cols[raw_key] = F.when(parsed.isNotNull(), format_date(parsed, "raw")).otherwise(F.col(raw_key))
        out = out.withColumns(cols)
    return out


def notification_date(item: str = "item", scrape_col: str = "scrape_date") -> Column:
    """Best date of a notification: raw ISO keys, display keys, then its scrape date.

    The stored ``timestamp`` is never consulted: loading turns it into a
    datetime, which the ISO parser then rejects, so the scrape date decides.
    """
    raw_keys = ("release_date_raw", "edited_date_raw", "last_edited_date_raw", "publish_date_raw")
    disp_keys = ("release_date", "edited_date", "last_edited_date", "publish_date")
    tries = [parse_iso(F.col(f"{item}.{k}")) for k in raw_keys]
    tries += [F.try_to_date(F.nullif(F.col(f"{item}.{k}"), F.lit("")), "MMMM d, yyyy").cast("timestamp_ntz")
              for k in disp_keys]
    tries.append(F.col(scrape_col).try_cast("timestamp_ntz"))
    return F.coalesce(*tries)


# Comment-deadline phrasings, tried in order.
DUE_DATE_PATTERNS = (
    "Comments Due:\\s*([A-Za-z]+\\s+\\d{1,2},\\s+\\d{4})",
    "provide comments by\\s+([A-Za-z]+\\s+\\d{1,2},\\s+\\d{4})",
    "comment period[^.]{0,200}?close(?:s|d)?[^.]{0,80}?on\\s+([A-Za-z]+\\s+\\d{1,2},\\s+\\d{4})",
    "will close[^.]{0,200}?on\\s+([A-Za-z]+\\s+\\d{1,2},\\s+\\d{4})",
)


def extract_due_date(c) -> Column:
    """First deadline phrase that matches **and** parses -> struct(display, raw)."""
    text = collapse_ws(c)
    tries = []
    for pat in DUE_DATE_PATTERNS:
        found = F.regexp_extract(text, "(?i)" + pat, 1)
        tries.append(F.when(found != "", parse_date(found, "dashboard")))
    parsed = F.coalesce(*tries)
    return F.struct(
        F.coalesce(format_date(parsed, "display"), F.lit("")).alias("comment_due_date"),
        F.coalesce(format_date(parsed, "raw"), F.lit("")).alias("comment_due_date_raw"),
    )


def news_date_flags(df):
    """Add ``show_last_edited`` and ``show_published`` display flags."""
    le = pystrip("last_edited_date")
    pub = pystrip("publish_date")
    le_raw = pystrip("last_edited_date_raw")
    pub_raw = pystrip("publish_date_raw")
    has_le = (le != "") | (le_raw != "")
    matches = (((le_raw != "") & (pub_raw != "") & (le_raw == pub_raw))
               | ((le != "") & (pub != "") & (le == pub)))
    return df.withColumns({"show_last_edited": has_le & ~matches, "show_published": pub != ""})
