"""Sorts, limits and paging windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DUE_DATE_KEYS, item_date
from .common import bind
from .filters import is_comment_current, is_draft_open
from .positions import with_positions


def _sorted(df: DataFrame, order: Sequence[Column], position: str | None) -> DataFrame:
    """Rows in order, with their places (from 0) as a column if one is named."""
    return with_positions(df, order, position) if position else df.orderBy(*order)


def sort_newest(df: DataFrame, keys: Sequence[str], *, seq: str = "seq", position: str | None = None) -> DataFrame:
    """Newest first by the first parseable date; undated last; ties keep ``seq`` order."""
    return _sorted(bind(df, "item_date", item_date(keys)), [F.desc_nulls_last("item_date"), F.col(seq)], position)


def comment_drafts(df: DataFrame, as_of, *, seq: str = "seq", position: str | None = None) -> DataFrame:
    """Drafts open for comment whose deadline is today or later, soonest first.

    Adds the displayed columns: ``due`` ('Not listed' when missing),
    ``published`` ('—' when missing) and ``title``.
    """
    due = item_date(DUE_DATE_KEYS)
    out = bind(df.where(is_draft_open() & is_comment_current(as_of)), "_due", due)
    out = (out.withColumn("due_date", F.date_format("_due", "yyyy-MM-dd"))
               .withColumn("due", F.coalesce(F.nullif(F.col("comment_due_date"), F.lit("")), F.lit("Not listed")))
               .withColumn("published", F.coalesce(F.nullif(F.col("release_date"), F.lit("")), F.lit("—")))
               .withColumn("title", F.coalesce(F.col("document_name"), F.lit("Draft Publication"))))
    return _sorted(out, [F.asc_nulls_last("_due"), F.col(seq)], position).drop("_due")


def stop_after_stale_pages(pages: DataFrame, *, listing: str = "listing", page: str = "page",
                           items: str = "n_items", added: str = "n_added", stale: int = 3,
                           max_pages: int | None = None) -> DataFrame:
    """Pages of each listing that the crawl would read before it stops.

    Input: one row per (listing, page) with the number of items on the page
    and how many of them were in range.  The crawl stops at the first empty
    page, after ``stale`` pages in a row without an in-range item, or, if the caller
    sets ``max_pages``, after that many pages.  The streak is a window of ``stale``
    pages per listing; the page it stops at is one aggregated row per listing.
    """
    streak = Window.partitionBy(listing).orderBy(page).rowsBetween(-(stale - 1), 0)
    read = pages if max_pages is None else pages.where(F.col(page) < max_pages)
    marked = (read.withColumn("_empty", F.col(items) == 0)
                .withColumn("_stale_run", F.sum((F.col(added) == 0).cast("int")).over(streak))
                .withColumn("_run_len", F.count(F.lit(1)).over(streak)))
    streak_ends = (F.col("_run_len") == stale) & (F.col("_stale_run") == stale)
    # pages from here on are not read: an empty page itself, and what follows a stale streak
    limit = F.when(F.col("_empty"), F.col(page)).when(streak_ends, F.col(page) + 1)
    stops = marked.groupBy(F.col(listing).alias("_listing")).agg(F.min(limit).alias("_limit"))
    joined = read.join(stops, read[listing].eqNullSafe(F.col("_listing")), "left")
    return joined.where(F.col("_limit").isNull() | (F.col(page) < F.col("_limit"))).drop("_listing", "_limit")


def head_preview(df: DataFrame, n: int, order: Sequence[Column], *, position: str | None = None) -> DataFrame:
    """First ``n`` rows by ``order`` (a report preview; the limit is the feature), with their places if a column is named."""
    head = df.orderBy(*order).limit(n)
    if position is None:
        return head
    return head.withColumn(position, F.row_number().over(Window.orderBy(*order)) - 1)  # n rows
