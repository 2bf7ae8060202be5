"""Enrichment joins: items x pages (summaries, due dates, article dates) and items x cache.

Pages are keyed by their normalised URL and reduced to one row per key
(earliest page) before the join, so the join key is unique on the pages side
and a popular link cannot fan out.  Only the rows that need a value are
joined; the others bypass the join and are unioned back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import extract_due_date, format_date, ntz_micros, parse_date
from ..functions.html import meta_content, page_text
from ..functions.links import normalize_link, sanitize_link
from ..functions.quality import is_uninformative, mid_phrase_start
from ..functions.text import blank, first_nonempty
from .common import bind
from .dedupe import first_per_key
from .filters import is_draft_open


def pages_by_link(pages: DataFrame, *cols: Column) -> DataFrame:
    """One row per normalised page URL (first page_id wins) with the given columns."""
    keyed = pages.select(normalize_link("url").alias("_plink"), "page_id", *cols)
    return first_per_key(keyed.where(F.col("_plink") != ""), ["_plink"], ["page_id"]).drop("page_id")


def enrich_summary(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill empty summaries from the linked page's meta description.

    Rows that already have a summary, or have no link, do not take part in the join.
    """
    need = (blank("summary") == "") & (blank("link") != "")
    todo = items.where(need).withColumn("_plink", normalize_link("link"))
    meta = pages_by_link(pages, meta_content("html", "name", "description").alias("_meta"))
    filled = (todo.join(meta, "_plink", "left")
                  .withColumn("summary", F.coalesce(F.nullif(F.col("_meta"), F.lit("")), F.col("summary")))
                  .drop("_plink", "_meta"))
    return items.where(~need).unionByName(filled)


def enrich_due_dates(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Open drafts without a due date but with a link take it from the linked page text."""
    need = (is_draft_open() & (blank("comment_due_date") == "") & (blank("comment_due_date_raw") == "")
            & (blank("link") != ""))
    todo = items.where(need).withColumn("_plink", normalize_link(sanitize_link(F.col("link"))))
    due = pages_by_link(pages, extract_due_date(page_text("html")).alias("_due"))
    filled = (todo.join(due, "_plink", "left")
                  .withColumn("comment_due_date", F.coalesce(F.col("_due.comment_due_date"), F.lit("")))
                  .withColumn("comment_due_date_raw", F.coalesce(F.col("_due.comment_due_date_raw"), F.lit("")))
                  .drop("_plink", "_due"))
    return items.where(~need).unionByName(filled)


def enrich_news_dates(items: DataFrame, article_dates: DataFrame, profile: str = "news") -> DataFrame:
    """Overwrite publish dates and set last-edited dates from the linked article.

    ``article_dates`` is the output of ``extract.article_dates`` (url, published, modified).
    Where the article gives no publish date, the item's own raw date is parsed again.
    """
    keyed = article_dates.select(normalize_link("url").alias("_plink"), "page_id", "published", "modified")
    dates = first_per_key(keyed.where(F.col("_plink") != ""), ["_plink"], ["page_id"]).drop("page_id")
    j = items.withColumn("_plink", normalize_link("link")).join(dates, "_plink", "left")
    pub = parse_date(first_nonempty("published", "publish_date_raw"), profile)
    mod = parse_date(F.col("modified"), profile)
    return (j.withColumn("publish_date", F.coalesce(format_date(pub, "display"), F.col("publish_date")))
             .withColumn("publish_date_raw", F.coalesce(format_date(pub, "raw"), F.col("publish_date_raw")))
             .withColumn("last_edited_date", F.coalesce(format_date(mod, "display"), F.col("last_edited_date")))
             .withColumn("last_edited_date_raw", F.coalesce(format_date(mod, "raw"), F.col("last_edited_date_raw")))
             .drop("_plink", "published", "modified"))


def cache_lookup(items: DataFrame, cache: DataFrame, *, as_of, ttl_hours: int = 48,
                 key_col: str = "cache_key") -> DataFrame:
    """Attach ``cached_summary``: a cache entry under the item's key, younger than the TTL,
    that still passes the summary gates (informative, not mid-phrase)."""
    as_of_col = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    # one entry per (key, topic): the newest write, as a keyed store keeps it
    latest = first_per_key(cache.select(F.col("key").alias(key_col), "topic", "ts", "summary"),
                           [key_col, "topic"], [-ntz_micros(F.col("ts"))])
    fresh = latest.where(F.col("ts") >= as_of_col - F.make_dt_interval(hours=F.lit(ttl_hours)))
    joined = items.join(fresh.select(key_col, "topic", F.col("summary").alias("_cached")), [key_col, "topic"], "left")
    # the gates read whole texts: only entries that an item asks for are judged, each item's once
    refused = (blank("_cached") != "") & (is_uninformative("_cached", "summary") | mid_phrase_start("_cached"))
    return bind(joined, "cached_summary", F.when(F.col("_cached").isNotNull() & ~refused, F.col("_cached"))).drop("_cached")
