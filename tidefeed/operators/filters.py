"""Row filters and predicates over items and notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DUE_DATE_KEYS, NOTIFICATION_ITEM_DATE_KEYS, item_date, parse_date
from ..functions.links import sanitize_link, url_parts
from ..functions.text import blank, col_, pystrip


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(value).cast("timestamp_ntz")


def filter_since(df: DataFrame, cutoff, keys: Sequence[str]) -> DataFrame:
    """Keep rows whose first parseable date over ``keys`` is on or after ``cutoff``."""
    return df.where(item_date(keys) >= _ts(cutoff))


def filter_since_fallback(df: DataFrame, cutoffs: Sequence, keys: Sequence[str]) -> DataFrame:
    """Strict window first; if it keeps nothing, the next (wider) window.

    The newest date is a scalar subquery (one partial-aggregate pass), so the
    window choice needs neither a join nor a driver round trip.
    """
    d = item_date(keys)
    newest = df.select(d.alias("_d")).agg(F.max("_d")).scalar()
    chosen = None
    for c in reversed(list(cutoffs)):
        chosen = _ts(c) if chosen is None else F.when(newest >= _ts(c), _ts(c)).otherwise(chosen)
    return df.where(d >= chosen)


def filter_recent(df: DataFrame, cutoff, *, date_col: str = "release_date", profile: str = "listing",
                  on_missing: str = "keep", on_unparsed: str = "keep") -> DataFrame:
    """Cutoff filter with an explicit rule for undated rows.

    ``on_missing`` applies when the date text is empty, ``on_unparsed`` when
    it is present but does not parse ('keep' or 'drop').
    """
    raw = blank(date_col)
    parsed = parse_date(date_col, profile)
    keep = (F.when(raw == "", F.lit(on_missing == "keep"))
             .when(parsed.isNull(), F.lit(on_unparsed == "keep"))
             .otherwise(parsed >= _ts(cutoff)))
    return df.where(keep)


# Per-source undated-row rules (topic, section) -> (on_missing, on_unparsed, cutoff applies).
RECENT_POLICY = {
    ("pqc", "publications"): ("drop", "drop", True),
    ("pqc", "presentations"): ("keep", "drop", True),
    ("qis", "presentations"): ("keep", "keep", True),
    ("ai", "presentations"): ("keep", "keep", True),
    ("ai", "news"): ("keep", "keep", True),
    ("qis", "publications"): ("keep", "keep", False),
    ("pqc", "news"): ("keep", "keep", False),
}


def filter_recent_source(df: DataFrame, cutoff, topic: str, section: str, *, date_col: str = "release_date") -> DataFrame:
    """``filter_recent`` with the rule of a source (sources without a rule keep every row)."""
    on_missing, on_unparsed, applies = RECENT_POLICY.get((topic, section), ("keep", "keep", False))
    if not applies:
        return df
    return filter_recent(df, cutoff, date_col=date_col, on_missing=on_missing, on_unparsed=on_unparsed)


def filter_notifications_since(df: DataFrame, cutoff, *, item: str = "item") -> DataFrame:
    """Keep notifications whose item date (six keys) is on or after ``cutoff``."""
    from .notifications import conform_item
    keys = [f"{item}.{k}" for k in NOTIFICATION_ITEM_DATE_KEYS]
    return conform_item(df, item).where(item_date(keys) >= _ts(cutoff))


def is_draft_open(category: str = "category", link: str = "link") -> Column:
    """Draft categories, or a public-draft link path ending ``/ipd`` or ``/2pd``..``/9pd``."""
    cat = F.lower(pystrip(category))
    _, _, path = url_parts(sanitize_link(blank(link)))
    path = F.regexp_replace(F.lower(path), "/+$", "")
    return cat.isin("drafts open for comment", "drafts") | (
        (blank(link) != "") & path.rlike("/(?:ipd|[2-9]pd)$"))


def is_comment_current(as_of, keys: Sequence[str] = DUE_DATE_KEYS) -> Column:
    """The comment due date is ``as_of``'s day or later."""
    due = item_date(keys)
    return due.isNotNull() & (F.to_date(due) >= F.to_date(_ts(as_of)))


def by_type(df: DataFrame, types: Sequence[str] | None = None, prefix: str | None = None,
            *, type_col: str = "type") -> DataFrame:
    """Notifications of the given types, or whose type starts with ``prefix``."""
    cond = F.lit(True)
    if types is not None:
        cond = cond & F.col(type_col).isin(*types)
    if prefix is not None:
        cond = cond & F.col(type_col).startswith(prefix)
    return df.where(cond)


# Resource types that never get a summary.
PRESENTATION_WORDS = ("presentation", "slide", "poster", "conference talk")


def is_presentation(resource_type: str = "resource_type", *, exact: bool = False) -> Column:
    """Substring rule (summary step) or, with ``exact``, the display rule that
    only matches 'presentation' / 'presentations'."""
    rt = F.lower(pystrip(F.coalesce(col_(resource_type).cast("string"), F.lit(""))))
    if exact:
        return rt.isin("presentation", "presentations")
    hit = F.lit(False)
    for w in PRESENTATION_WORDS:
        hit = hit | (F.instr(rt, w) > 0)
    return hit


def drop_presentations(df: DataFrame, resource_type: str = "resource_type", *, exact: bool = False) -> DataFrame:
    """Rows that may get a summary (not a presentation, slide, poster or talk)."""
    return df.where(~is_presentation(resource_type, exact=exact))


def tag_source(df: DataFrame, topic: str, category: str | None = None, source: str | None = None) -> DataFrame:
    """Attach constant topic / category / source columns for one source."""
    cols = {"topic": F.lit(topic)}
    if category is not None:
        cols["category"] = F.lit(category)
    if source is not None:
        cols["source"] = F.lit(source)
    return df.withColumns(cols)
