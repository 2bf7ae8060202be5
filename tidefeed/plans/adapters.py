"""Adapters: the given tables read as feed records (items, notifications, summary cache).

Each adapter reads whole tables; the same definitions are written in SQL in
``catalog.py`` so the DuckDB check computes the same inputs independently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import first_paragraph, tag_text
from ..sources.snapshots import ITEM_FIELDS
from ..sources.tables import read_pages, read_table

AS_OF = "2024-01-31 00:00:00"

# Fixed values (adapter): document categories by doc_id % 4, event type -> notification type.
DOC_CATEGORIES = ("Final Publications", "Drafts Open for Comment", "Drafts", "General Publications")
EVENT_TYPES = (("click", "publication"), ("view", "news"), ("purchase", "presentation"),
               ("signup", "ai_news"), ("error", "pqc_publication"))
CACHE_TOPICS = ("qis", "pqc", "ai_publications")


def conform(df: DataFrame, fields=ITEM_FIELDS) -> DataFrame:
    """Add any missing canonical item field as a NULL string column."""
    missing = {f: F.lit(None).cast("string") for f in fields if f not in df.columns}
    return df.withColumns(missing) if missing else df


def items_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items from pages: title = first ``<h1>``, link = url, summary = first paragraph."""
    pages = read_pages(spark, sf_dir)
    out = pages.select(
        F.col("page_id").alias("seq"), F.lit("qis").alias("topic"), F.lit("news").alias("section"),
        tag_text("html", "h1").alias("title"), F.col("url").alias("link"),
        first_paragraph("html").alias("summary"))
    return conform(out)


def in_prev_crawl(link="link"):
    """The previous crawl did not follow links with a query string."""
    return F.instr(F.col(link) if isinstance(link, str) else link, "?") == 0


def in_curr_crawl(link="link"):
    """The current crawl does not follow fragment links."""
    return F.instr(F.col(link) if isinstance(link, str) else link, "#") == 0


def items_docs(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """Publications from documents, with dates written in the styles the sources use.

    document_name = first line of the text; summary = the whole text; ``keep`` names
    columns of documents to carry along.
    """
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", *keep])
    d = F.date_add(F.lit("2022-07-01").cast("date"), ((F.col("doc_id") * 37) % 700).cast("int"))
    m6 = F.col("doc_id") % 6
    day = F.dayofmonth(d)
    ordinal = (F.when(day.isin(11, 12, 13), F.lit("th"))
                .when(day % 10 == 1, F.lit("st")).when(day % 10 == 2, F.lit("nd"))
                .when(day % 10 == 3, F.lit("rd")).otherwise(F.lit("th")))
    release = (F.when(m6 == 0, F.date_format(d, "MMMM dd, yyyy"))
                .when(m6 == 1, F.date_format(d, "M/d/yyyy"))
                .when(m6 == 2, F.date_format(d, "yyyy-MM-dd"))
                .when(m6 == 3, F.concat(F.date_format(d, "MMMM d"), ordinal, F.date_format(d, ", yyyy")))
                .when(m6 == 4, F.lit(""))
                .otherwise(F.lit("TBD")))
    category = F.element_at(F.array(*[F.lit(c) for c in DOC_CATEGORIES]), (F.col("doc_id") % 4 + 1).cast("int"))
    draft = (F.col("doc_id") % 4).isin(1, 2)
    out = docs.select(
        F.col("doc_id").alias("seq"), F.lit("pqc").alias("topic"), F.lit("publications").alias("section"),
        F.substring_index(F.col("text"), "\n", 1).alias("document_name"),
        F.col("text").alias("summary"),
        category.alias("category"),
        release.alias("release_date"),
        F.when(F.col("doc_id") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("")).alias("release_date_raw"),
        F.when(draft, F.date_format(F.date_add(d, 60), "yyyy-MM-dd")).otherwise(F.lit("")).alias("comment_due_date_raw"),
        F.lit("").alias("comment_due_date"), *keep)
    return conform(out)


def notifications_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications from events: type by event type, item titled by user, dated by the event day."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    ntype = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(t)) for e, t in EVENT_TYPES])
    item = F.struct(
        F.concat(F.lit("item "), F.col("user_id").cast("string")).alias("title"),
        F.lit("").alias("document_name"),
        F.lit("").alias("document_number"),
        F.concat(F.lit("https://www.example.gov/news-events/news/"), F.col("user_id").cast("string")).alias("link"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("publish_date_raw"),
        F.lit("").alias("release_date_raw"),
        F.lit("").alias("release_date"),
        F.lit("").alias("summary"))
    return ev.select(F.col("event_id").alias("seq"), ntype.alias("type"),
                     F.col("ts").cast("timestamp_ntz").alias("timestamp"),
                     F.col("ts").cast("timestamp_ntz").alias("scrape_date"), item.alias("item"))


def cache_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary cache from documents: key = md5(text), age by doc_id, summary = the text."""
    from ..functions.text import cache_key
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    topic = F.element_at(F.array(*[F.lit(t) for t in CACHE_TOPICS]), (F.col("doc_id") % 3 + 1).cast("int"))
    ts = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("doc_id") % 72).cast("int"))
    return docs.select(F.col("doc_id").alias("seq"), topic.alias("topic"), cache_key(F.col("text")).alias("key"),
                       F.lit("item").alias("kind"), ts.alias("ts"), F.col("text").alias("summary"))

