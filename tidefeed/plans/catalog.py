"""Registered queries: one per operator, each with its DuckDB oracle (when SQL can say it).

Every query reads whole tables (or data Spark derives from them); the oracle
recomputes the same adapter in SQL so both sides start from the raw parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from . import sqlgen as S
from ..functions import dates as D
from ..functions import identity as I
from ..functions import links as L
from ..functions import text as T
from ..functions.html import page_language, tag_text, meta_content
from ..operators import dedupe as DD
from ..operators import diff as DF
from ..operators import filters as FL
from ..operators.merge import merge_items
from ..session import materialize
from ..sources.tables import read_pages, read_table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

AS_OF = A.AS_OF
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------------------
# SQL forms of the adapters (same definitions as adapters.py)
# ---------------------------------------------------------------------------

SQL_ITEMS_PAGES = f"""
SELECT page_id AS seq, 'qis' AS topic, 'news' AS section,
       {S.tag_text('html', 'h1')} AS title, url AS link, {S.first_paragraph('html')} AS summary
FROM pages"""

_DOC_D = "(DATE '2022-07-01' + CAST((doc_id * 37) % 700 AS INTEGER))"
_ORD = (f"(CASE WHEN day({_DOC_D}) IN (11, 12, 13) THEN 'th' WHEN day({_DOC_D}) % 10 = 1 THEN 'st' "
        f"WHEN day({_DOC_D}) % 10 = 2 THEN 'nd' WHEN day({_DOC_D}) % 10 = 3 THEN 'rd' ELSE 'th' END)")
SQL_ITEMS_DOCS = f"""
SELECT doc_id AS seq, 'pqc' AS topic, 'publications' AS section,
       split_part(text, chr(10), 1) AS document_name, text AS summary,
       (['Final Publications', 'Drafts Open for Comment', 'Drafts', 'General Publications'])[doc_id % 4 + 1] AS category,
       CASE doc_id % 6
         WHEN 0 THEN strftime({_DOC_D}, '%B %d, %Y')
         WHEN 1 THEN CAST(month({_DOC_D}) AS VARCHAR) || '/' || CAST(day({_DOC_D}) AS VARCHAR) || '/' || CAST(year({_DOC_D}) AS VARCHAR)
         WHEN 2 THEN strftime({_DOC_D}, '%Y-%m-%d')
         WHEN 3 THEN strftime({_DOC_D}, '%B ') || CAST(day({_DOC_D}) AS VARCHAR) || {_ORD} || strftime({_DOC_D}, ', %Y')
         WHEN 4 THEN ''
         ELSE 'TBD' END AS release_date,
       CASE WHEN doc_id % 3 = 0 THEN strftime({_DOC_D}, '%Y-%m-%d') ELSE '' END AS release_date_raw,
       CASE WHEN doc_id % 4 IN (1, 2) THEN strftime({_DOC_D} + 60, '%Y-%m-%d') ELSE '' END AS comment_due_date_raw,
       '' AS comment_due_date
FROM documents"""

SQL_NOTIFICATIONS = """
SELECT event_id AS seq,
       CASE event_type WHEN 'click' THEN 'publication' WHEN 'view' THEN 'news' WHEN 'purchase' THEN 'presentation'
                       WHEN 'signup' THEN 'ai_news' WHEN 'error' THEN 'pqc_publication' END AS type,
       ts AS "timestamp", ts AS scrape_date,
       'item ' || CAST(user_id AS VARCHAR) AS title, '' AS document_name, '' AS document_number,
       'https://www.example.gov/news-events/news/' || CAST(user_id AS VARCHAR) AS link,
       strftime(ts, '%Y-%m-%d') AS publish_date_raw, '' AS release_date_raw, '' AS release_date, '' AS summary
FROM events"""


def _docs(spark, sf):
    return A.items_docs(spark, sf)


# ---------------------------------------------------------------------------
# 2.1 sources
# ---------------------------------------------------------------------------

@query("read_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def q_read_pages(spark, sf):
    return read_pages(spark, sf).select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


# ---------------------------------------------------------------------------
# 2.2 text and link functions
# ---------------------------------------------------------------------------

@query("clean_text", f"SELECT doc_id, {S.clean_text('text')} AS cleaned FROM documents")
def q_clean_text(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", T.clean_text("text").alias("cleaned"))


@query("normalize_text", f"SELECT doc_id, {S.normalize_text('text')} AS normalized FROM documents")
def q_normalize_text(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", T.normalize_text("text").alias("normalized"))


@query("normalize_link", f"""SELECT page_id, {S.normalize_link('url')} AS link_norm,
       {S.normalize_link('url', default_scheme='https', sanitize=True)} AS display_link FROM pages""")
def q_normalize_link(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", L.normalize_link("url").alias("link_norm"),
                    L.normalize_link("url", default_scheme="https", sanitize=True).alias("display_link"))


@query("sanitize_link", f"""SELECT page_id,
       {S.sanitize_link("('[](' || url || ')<' || url || '>')")} AS wrapped_same,
       {S.sanitize_link("('[](' || url || ')<' || url || '/>')")} AS wrapped_other,
       {S.sanitize_link('url')} AS plain FROM pages""")
def q_sanitize_link(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    same = F.concat(F.lit("[]("), F.col("url"), F.lit(")<"), F.col("url"), F.lit(">"))
    other = F.concat(F.lit("[]("), F.col("url"), F.lit(")<"), F.col("url"), F.lit("/>"))
    return p.select("page_id", L.sanitize_link(same).alias("wrapped_same"),
                    L.sanitize_link(other).alias("wrapped_other"), L.sanitize_link("url").alias("plain"))


@query("item_label", f"SELECT seq, {S.normalize_text(S.first_nonempty('document_name'))} AS label FROM ({SQL_ITEMS_DOCS}) d")
def q_item_label(spark, sf):
    return _docs(spark, sf).select("seq", I.item_label().alias("label"))


_DOC_COLS = {"document_name": "document_name", "release_date": "release_date",
             "release_date_raw": "release_date_raw"}
_PAGE_COLS = {"title": "title", "link": "link"}


@query("item_identity", f"""
SELECT 'docs' AS src, seq, {S.item_identity(_DOC_COLS)} AS identity FROM ({SQL_ITEMS_DOCS}) d
UNION ALL
SELECT 'pages' AS src, seq, {S.item_identity(_PAGE_COLS)} AS identity FROM ({SQL_ITEMS_PAGES}) p""")
def q_item_identity(spark, sf):
    d = _docs(spark, sf).select(F.lit("docs").alias("src"), "seq", I.item_identity().alias("identity"))
    p = A.items_pages(spark, sf).select(F.lit("pages").alias("src"), "seq", I.item_identity().alias("identity"))
    return d.unionByName(p)


_NOTE_COLS = {"title": "title", "document_name": "document_name", "document_number": "document_number",
              "link": "link", "publish_date_raw": "publish_date_raw", "release_date_raw": "release_date_raw",
              "release_date": "release_date"}


@query("notification_identity",
       f"SELECT seq, {S.normalize_text('type')} || '::' || {S.item_identity(_NOTE_COLS)} AS nid FROM ({SQL_NOTIFICATIONS}) n")
def q_notification_identity(spark, sf):
    from ..operators.notifications import with_nid
    return with_nid(A.notifications_events(spark, sf)).select("seq", "nid")


@query("display_key", f"""SELECT seq, {S.display_key(['document_name'], ['release_date_raw', 'release_date'],
                                                       link="NULL::VARCHAR", rtype="NULL::VARCHAR")} AS display_key
FROM ({SQL_ITEMS_DOCS}) d""")
def q_display_key(spark, sf):
    return _docs(spark, sf).select("seq", I.display_key(["document_name"], ["release_date_raw", "release_date"]).alias("display_key"))


@query("cache_key", f"""SELECT doc_id, md5({S.pystrip('text')}) AS key, 'km_' || md5({S.pystrip('text')}) AS km_key,
       md5(text) AS untrimmed_key FROM documents""")
def q_cache_key(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", T.cache_key("text").alias("key"), T.cache_key("text", kind="km").alias("km_key"),
                       T.cache_key("text", trim=False).alias("untrimmed_key"))


# ---------------------------------------------------------------------------
# 2.3 dates
# ---------------------------------------------------------------------------

_PROFILES = ("listing", "news", "presentation", "dashboard", "store")


def _sql_parse_all(col: str) -> str:
    return ", ".join(f"strftime({S.parse_date(col, p)}, '%Y-%m-%d %H:%M:%S') AS {p}" for p in _PROFILES)


@query("parse_date", f"SELECT seq, release_date, {_sql_parse_all('release_date')} FROM ({SQL_ITEMS_DOCS}) d")
def q_parse_date(spark, sf):
    d = _docs(spark, sf)
    return d.select("seq", "release_date",
                    *[F.date_format(D.parse_date("release_date", p), "yyyy-MM-dd HH:mm:ss").alias(p) for p in _PROFILES])


@query("format_date", f"""SELECT seq, {S.fmt_display(S.parse_date('release_date', 'listing'))} AS display,
       {S.fmt_raw(S.parse_date('release_date', 'listing'))} AS raw FROM ({SQL_ITEMS_DOCS}) d""")
def q_format_date(spark, sf):
    d = _docs(spark, sf)
    parsed = D.parse_date("release_date", "listing")
    return d.select("seq", D.format_date(parsed, "display").alias("display"), D.format_date(parsed, "raw").alias("raw"))


def _sql_normalize_pair(display: str, raw: str) -> tuple[str, str]:
    parsed = S.parse_date(S.first_nonempty(raw, display), "dashboard")
    return (f"CASE WHEN {parsed} IS NOT NULL THEN {S.fmt_display(parsed)} ELSE {display} END",
            f"CASE WHEN {parsed} IS NOT NULL THEN {S.fmt_raw(parsed)} ELSE {raw} END")


_NR = _sql_normalize_pair("release_date", "release_date_raw")
_ND = _sql_normalize_pair("comment_due_date", "comment_due_date_raw")


@query("normalize_item_dates", f"""SELECT seq, {_NR[0]} AS release_date, {_NR[1]} AS release_date_raw,
       {_ND[0]} AS comment_due_date, {_ND[1]} AS comment_due_date_raw FROM ({SQL_ITEMS_DOCS}) d""")
def q_normalize_item_dates(spark, sf):
    d = D.normalize_item_dates(_docs(spark, sf), [("release_date", "release_date_raw"),
                                                   ("comment_due_date", "comment_due_date_raw")])
    return d.select("seq", "release_date", "release_date_raw", "comment_due_date", "comment_due_date_raw")


@query("item_date", f"""SELECT seq, strftime({S.item_date(['release_date_raw', 'release_date'])}, '%Y-%m-%d %H:%M:%S') AS item_date
FROM ({SQL_ITEMS_DOCS}) d""")
def q_item_date(spark, sf):
    d = _docs(spark, sf)
    return d.select("seq", F.date_format(D.item_date(["release_date_raw", "release_date"]), "yyyy-MM-dd HH:mm:ss").alias("item_date"))


@query("date_token", f"""SELECT seq, {S.normalize_text(S.first_nonempty('release_date_raw', 'release_date'))} AS date_token
FROM ({SQL_ITEMS_DOCS}) d""")
def q_date_token(spark, sf):
    return _docs(spark, sf).select("seq", D.date_token().alias("date_token"))


# ---------------------------------------------------------------------------
# 2.4 page fields
# ---------------------------------------------------------------------------


# ---------------------------------------------------------------------------
# 2.6 / 2.7 merge, diff, dedupe (flagship: new_items)
# ---------------------------------------------------------------------------

def _sql_merge(src: str, fields: list[str], keys: list[str], ident_cols: dict[str, str]) -> str:
    """Closed-form merge in SQL with window functions (oracle form)."""
    part = ", ".join(keys + ["identity"])
    field_sel = ", ".join(
        f"arg_min({f}, ({f} IS NULL OR {f} = '', p0, p1)) AS {f}" for f in fields)
    return f"""
WITH r AS (SELECT *, {S.item_identity(ident_cols)} AS identity, {S.link_score('link')} AS score,
                  (link IS NOT NULL AND link <> '') AS has_link FROM ({src}) s),
w AS (SELECT *, max(CASE WHEN has_link THEN score END) OVER (PARTITION BY {part} ORDER BY seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             min(seq) OVER (PARTITION BY {part}) AS first_seq FROM r),
f AS (SELECT *, (seq <> first_seq AND score > coalesce(before, 0)) AS win FROM w),
p AS (SELECT *, CASE WHEN win THEN 0 ELSE 1 END AS p0, CASE WHEN win THEN -seq ELSE seq END AS p1 FROM f)
SELECT {', '.join(keys)}, identity, min(seq) AS seq, {field_sel} FROM p GROUP BY {part}"""


_PAGE_FIELDS = ["title", "link", "summary"]
SQL_MERGE_PAGES = _sql_merge(SQL_ITEMS_PAGES, _PAGE_FIELDS, ["topic", "section"], _PAGE_COLS)


def _merged_pages(spark, sf, where=None):
    items = A.items_pages(spark, sf)
    if where is not None:
        items = items.where(where)
    items = materialize(items.withColumn("identity", I.item_identity()))
    return merge_items(items, group_cols=("topic", "section"), fields=_PAGE_FIELDS)


@query("merge_items", SQL_MERGE_PAGES)
def q_merge_items(spark, sf):
    return _merged_pages(spark, sf)


SQL_PREV_WHERE = " WHERE strpos(url, '?') = 0"      # previous crawl: no query-string links
SQL_CURR_WHERE = " WHERE strpos(url, '#') = 0"      # current crawl: no fragment links
SQL_PREV = _sql_merge(SQL_ITEMS_PAGES + SQL_PREV_WHERE, _PAGE_FIELDS, ["topic", "section"], _PAGE_COLS)
SQL_CURR = _sql_merge(SQL_ITEMS_PAGES + SQL_CURR_WHERE, _PAGE_FIELDS, ["topic", "section"], _PAGE_COLS)


@query("new_items", f"""SELECT c.* FROM ({SQL_CURR}) c
WHERE NOT EXISTS (SELECT 1 FROM ({SQL_PREV}) p WHERE p.topic = c.topic AND p.section = c.section AND p.identity = c.identity)""")
def q_new_items(spark, sf):
    items = materialize(A.items_pages(spark, sf).withColumn("identity", I.item_identity()))
    cur = merge_items(items.where(A.in_curr_crawl()), group_cols=("topic", "section"), fields=_PAGE_FIELDS)
    prev = merge_items(items.where(A.in_prev_crawl()), group_cols=("topic", "section"), fields=_PAGE_FIELDS)
    return DF.new_items(cur, prev, merged=True)


@query("has_changed", f"""SELECT (SELECT count(*) FROM (SELECT identity FROM ({SQL_CURR}) c
    EXCEPT SELECT identity FROM ({SQL_PREV}) p) x) + (SELECT count(*) FROM (SELECT identity FROM ({SQL_PREV}) p
    EXCEPT SELECT identity FROM ({SQL_CURR}) c) y) > 0 AS changed""")
def q_has_changed(spark, sf):
    items = materialize(A.items_pages(spark, sf).withColumn("identity", I.item_identity()))
    cur = items.where(A.in_curr_crawl())
    prev = items.where(A.in_prev_crawl())
    return DF.has_changed(cur, prev, group_cols=("topic", "section"))


@query("compare_snapshots", f"""SELECT coalesce(c.topic, p.topic) AS topic, coalesce(c.section, p.section) AS section,
       coalesce(c.identity, p.identity) AS identity,
       CASE WHEN p.identity IS NULL THEN 'added' WHEN c.identity IS NULL THEN 'removed' ELSE 'kept' END AS status
FROM (SELECT topic, section, identity FROM ({SQL_CURR}) c0) c
FULL OUTER JOIN (SELECT topic, section, identity FROM ({SQL_PREV}) p0) p
  ON c.topic = p.topic AND c.section = p.section AND c.identity = p.identity""")
def q_compare_snapshots(spark, sf):
    items = materialize(A.items_pages(spark, sf).withColumn("identity", I.item_identity()))
    cur = items.where(A.in_curr_crawl())
    prev = items.where(A.in_prev_crawl())
    return DF.compare_snapshots(cur, prev)


@query("changed_items", f"""SELECT coalesce(c.topic, p.topic) AS topic, coalesce(c.section, p.section) AS section,
       coalesce(c.identity, p.identity) AS identity,
       CASE WHEN p.identity IS NULL THEN 'added' WHEN c.identity IS NULL THEN 'removed'
            WHEN c.link IS DISTINCT FROM p.link THEN 'changed' ELSE 'kept' END AS status
FROM (SELECT topic, section, identity, link FROM ({SQL_CURR}) c0) c
FULL OUTER JOIN (SELECT topic, section, identity, link FROM ({SQL_PREV}) p0) p
  ON c.topic = p.topic AND c.section = p.section AND c.identity = p.identity""")
def q_changed_items(spark, sf):
    items = materialize(A.items_pages(spark, sf).withColumn("identity", I.item_identity()))
    return DF.compare_snapshots(items.where(A.in_curr_crawl()), items.where(A.in_prev_crawl()), compare=["link"], fields=_PAGE_FIELDS)


_DISPLAY_KEY_DOCS = S.display_key(["document_name"], ["release_date_raw", "release_date"],
                                  link="NULL::VARCHAR", rtype="NULL::VARCHAR")


@query("dedupe_display", f"""SELECT seq, document_name, release_date FROM (
  SELECT *, row_number() OVER (PARTITION BY {_DISPLAY_KEY_DOCS} ORDER BY seq) AS rn FROM ({SQL_ITEMS_DOCS}) d) x
WHERE rn = 1""")
def q_dedupe_display(spark, sf):
    d = DD.dedupe_display(_docs(spark, sf), ["document_name"], ["release_date_raw", "release_date"])
    return d.select("seq", "document_name", "release_date")


@query("dedupe_exact", f"""SELECT seq, document_name FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(document_name, '') ORDER BY seq) AS rn FROM ({SQL_ITEMS_DOCS}) d) x
WHERE rn = 1""")
def q_dedupe_exact(spark, sf):
    return DD.dedupe_exact(_docs(spark, sf), ["document_name"]).select("seq", "document_name")


@query("union_sources", f"""SELECT topic, section, seq FROM ({SQL_ITEMS_PAGES}) p
UNION ALL SELECT topic, section, seq FROM ({SQL_ITEMS_DOCS}) d""")
def q_union_sources(spark, sf):
    return DF.union_sources(A.items_pages(spark, sf), _docs(spark, sf)).select("topic", "section", "seq")


@query("section_counts", f"""WITH u AS (SELECT topic, section FROM ({SQL_ITEMS_PAGES}) p
                          UNION ALL SELECT topic, section FROM ({SQL_ITEMS_DOCS}) d),
t AS (SELECT DISTINCT topic FROM u),
g AS (SELECT topic, s.section FROM t, (VALUES ('publications'), ('presentations'), ('news')) s(section)
      UNION SELECT DISTINCT topic, section FROM u)
SELECT g.topic, g.section, CAST(count(u.topic) AS BIGINT) AS n FROM g LEFT JOIN u ON g.topic = u.topic AND g.section = u.section
GROUP BY g.topic, g.section""")
def q_section_counts(spark, sf):
    from ..operators.reports import section_counts
    return section_counts(DF.union_sources(A.items_pages(spark, sf), _docs(spark, sf)))


# ---------------------------------------------------------------------------
# 2.5 filters and predicates, 2.8 ordering
# ---------------------------------------------------------------------------

CUTOFF_365 = "2023-01-31 00:00:00"   # AS_OF - 365 days
CUTOFF_730 = "2022-01-31 00:00:00"   # AS_OF - 730 days
_PUB_KEYS = ["release_date_raw", "release_date"]
_SQL_PUB_DATE = S.item_date(_PUB_KEYS)


@query("filter_since", f"""SELECT seq, document_name FROM ({SQL_ITEMS_DOCS}) d
WHERE {_SQL_PUB_DATE} >= TIMESTAMP '{CUTOFF_365}'""")
def q_filter_since(spark, sf):
    return FL.filter_since(_docs(spark, sf), CUTOFF_365, _PUB_KEYS).select("seq", "document_name")


@query("filter_since_fallback", f"""WITH d AS (SELECT *, {_SQL_PUB_DATE} AS dt FROM ({SQL_ITEMS_DOCS}) x)
SELECT seq, document_name FROM d
WHERE dt >= CASE WHEN (SELECT max(dt) FROM d) >= TIMESTAMP '{CUTOFF_365}' THEN TIMESTAMP '{CUTOFF_365}'
                 ELSE TIMESTAMP '{CUTOFF_730}' END""")
def q_filter_since_fallback(spark, sf):
    out = FL.filter_since_fallback(_docs(spark, sf), [CUTOFF_365, CUTOFF_730], _PUB_KEYS)
    return out.select("seq", "document_name")


_POLICIES = (("drop_both", "drop", "drop"), ("keep_missing", "keep", "drop"), ("keep_both", "keep", "keep"))


def _sql_recent(on_missing, on_unparsed):
    parsed = S.parse_date("release_date", "listing")
    return (f"CASE WHEN coalesce(release_date, '') = '' THEN {str(on_missing == 'keep').upper()} "
            f"WHEN {parsed} IS NULL THEN {str(on_unparsed == 'keep').upper()} "
            f"ELSE {parsed} >= TIMESTAMP '{CUTOFF_365}' END")


@query("recent_policy", " UNION ALL ".join(
    f"SELECT '{n}' AS policy, seq FROM ({SQL_ITEMS_DOCS}) d WHERE {_sql_recent(m, u)}" for n, m, u in _POLICIES))
def q_recent_policy(spark, sf):
    d = _docs(spark, sf)
    parts = [FL.filter_recent(d, CUTOFF_365, on_missing=m, on_unparsed=u).select(F.lit(n).alias("policy"), "seq")
             for n, m, u in _POLICIES]
    return DF.union_sources(*parts)


_SQL_DRAFT_OPEN = (f"(lower({S.pystrip('category')}) IN ('drafts open for comment', 'drafts') OR "
                   f"(coalesce(link, '') <> '' AND regexp_matches(regexp_replace(lower({S.url_part(S.sanitize_link('coalesce(link, chr(0))'), 3)}), '/+$', ''), '/(?:ipd|[2-9]pd)$')))")
_SQL_DUE = S.item_date(["comment_due_date_raw", "comment_due_date"])
_SQL_CURRENT = f"({_SQL_DUE} IS NOT NULL AND CAST({_SQL_DUE} AS DATE) >= CAST({AS_OF_SQL} AS DATE))"
_SQL_DOCS_LINK = f"SELECT *, NULL::VARCHAR AS link FROM ({SQL_ITEMS_DOCS}) d0"


@query("is_draft_open", f"SELECT seq, {_SQL_DRAFT_OPEN} AS draft_open, {_SQL_CURRENT} AS comment_current FROM ({_SQL_DOCS_LINK}) d")
def q_is_draft_open(spark, sf):
    d = _docs(spark, sf)
    return d.select("seq", FL.is_draft_open().alias("draft_open"), FL.is_comment_current(AS_OF).alias("comment_current"))


@query("comment_drafts", f"""SELECT seq, coalesce(nullif(comment_due_date, ''), 'Not listed') AS due,
       coalesce(nullif(release_date, ''), '—') AS published, coalesce(document_name, 'Draft Publication') AS title,
       strftime({_SQL_DUE}, '%Y-%m-%d') AS due_date, row_number() OVER (ORDER BY {_SQL_DUE} NULLS LAST, seq) - 1 AS position
FROM ({_SQL_DOCS_LINK}) d WHERE {_SQL_DRAFT_OPEN} AND {_SQL_CURRENT}""")
def q_comment_drafts(spark, sf):
    from ..operators.ordering import comment_drafts
    listed = _docs(spark, sf).drop("summary", "abstract", "description")
    return comment_drafts(listed, AS_OF, position="position").select("seq", "due", "published", "title", "due_date", "position")


@query("sort_newest", f"""SELECT seq, row_number() OVER (ORDER BY {_SQL_PUB_DATE} DESC NULLS LAST, seq) - 1 AS position,
       strftime({_SQL_PUB_DATE}, '%Y-%m-%d') AS item_date FROM ({SQL_ITEMS_DOCS}) d""")
def q_sort_newest(spark, sf):
    from ..operators.ordering import sort_newest
    keys = _docs(spark, sf).select("seq", *_PUB_KEYS)
    return sort_newest(keys, _PUB_KEYS, position="position").select("seq", "position", F.date_format("item_date", "yyyy-MM-dd").alias("item_date"))


@query("drop_presentations", f"""SELECT seq FROM ({SQL_NOTIFICATIONS}) n
WHERE NOT (strpos(lower(type), 'presentation') > 0 OR strpos(lower(type), 'slide') > 0
           OR strpos(lower(type), 'poster') > 0 OR strpos(lower(type), 'conference talk') > 0)""")
def q_drop_presentations(spark, sf):
    n = A.notifications_events(spark, sf)
    return FL.drop_presentations(n, resource_type="type").select("seq")


@query("tag_source", f"""SELECT seq, 'ai' AS topic, 'General Publications' AS category, 'documents' AS source
FROM ({SQL_ITEMS_DOCS}) d""")
def q_tag_source(spark, sf):
    d = FL.tag_source(_docs(spark, sf), "ai", "General Publications", "documents")
    return d.select("seq", "topic", "category", "source")


@query("by_type", f"SELECT seq, type FROM ({SQL_NOTIFICATIONS}) n WHERE starts_with(type, 'ai_') OR type IN ('news')")
def q_by_type(spark, sf):
    n = A.notifications_events(spark, sf)
    return DF.union_sources(FL.by_type(n, prefix="ai_"), FL.by_type(n, types=["news"])).select("seq", "type")


# ---------------------------------------------------------------------------
# Notifications (events adapter)
# ---------------------------------------------------------------------------

_NID_SQL = f"{S.normalize_text('type')} || '::' || {S.item_identity(_NOTE_COLS)}"
SQL_NOTES_NID = f"SELECT *, {_NID_SQL} AS nid FROM ({SQL_NOTIFICATIONS}) n0"
_TS_FMT_SQL = "'%Y-%m-%dT%H:%M:%S.%f'"
_TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _iso(c):
    return F.date_format(c, _TS_FMT)


SQL_DEDUPE_NOTES = f"""SELECT nid, min(seq) AS seq, arg_min(type, seq) AS type,
       strftime(max("timestamp"), {_TS_FMT_SQL}) AS "timestamp",
       strftime(arg_max(scrape_date, ("timestamp", -seq)), {_TS_FMT_SQL}) AS scrape_date,
       arg_min(title, seq) AS title, arg_min(publish_date_raw, seq) AS publish_date_raw
FROM ({SQL_NOTES_NID}) n GROUP BY nid"""


def _flat_notes(df):
    return df.select("nid", "seq", "type", _iso("timestamp").alias("timestamp"), _iso("scrape_date").alias("scrape_date"),
                     F.col("item.title").alias("title"), F.col("item.publish_date_raw").alias("publish_date_raw"))


@query("dedupe_notifications", SQL_DEDUPE_NOTES)
def q_dedupe_notifications(spark, sf):
    from ..operators.notifications import dedupe_notifications
    return _flat_notes(dedupe_notifications(A.notifications_events(spark, sf)))


SPLIT_TS = "2024-01-20 00:00:00"


@query("upsert_notifications", f"""WITH store AS (
  SELECT nid, min(seq) AS seq, arg_min(type, seq) AS type, max("timestamp") AS ts,
         arg_max(scrape_date, ("timestamp", -seq)) AS sd, arg_min(title, seq) AS title
  FROM ({SQL_NOTES_NID}) n WHERE "timestamp" < TIMESTAMP '{SPLIT_TS}' GROUP BY nid),
new AS (SELECT nid, min(seq) AS seq, arg_min(type, seq) AS type, arg_min(title, seq) AS title
  FROM ({SQL_NOTES_NID}) n WHERE "timestamp" >= TIMESTAMP '{SPLIT_TS}' GROUP BY nid)
SELECT coalesce(s.nid, n.nid) AS nid, coalesce(s.type, n.type) AS type,
       strftime(coalesce(s.ts, {AS_OF_SQL}), {_TS_FMT_SQL}) AS "timestamp",
       strftime(coalesce(s.sd, {AS_OF_SQL}), {_TS_FMT_SQL}) AS scrape_date,
       coalesce(s.title, n.title) AS title
FROM store s FULL OUTER JOIN new n ON s.nid = n.nid""")
def q_upsert_notifications(spark, sf):
    from ..operators.notifications import dedupe_notifications, upsert_notifications
    ev = A.notifications_events(spark, sf)
    store = materialize(dedupe_notifications(ev.where(F.col("timestamp") < F.lit(SPLIT_TS).cast("timestamp_ntz"))))
    new = ev.where(F.col("timestamp") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))
    out = upsert_notifications(store, new, as_of=AS_OF)
    return out.select("nid", "type", _iso("timestamp").alias("timestamp"), _iso("scrape_date").alias("scrape_date"),
                      F.col("item.title").alias("title"))


_SQL_NOTE_DATE = f"coalesce({S.parse_iso('publish_date_raw')}, scrape_date)"
_SQL_AGE = f"CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us({_SQL_NOTE_DATE})) / 86400000000.0) AS BIGINT)"


@query("bucket_by_week", f"""SELECT nid, seq, {_SQL_AGE} AS age_days,
       CASE WHEN {_SQL_AGE} BETWEEN 0 AND 7 THEN 'week_1' WHEN {_SQL_AGE} BETWEEN 8 AND 14 THEN 'week_2' ELSE 'archived' END AS bucket
FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY seq) AS rn FROM ({SQL_NOTES_NID}) n) x
WHERE rn = 1 AND {_SQL_NOTE_DATE} IS NOT NULL""")
def q_bucket_by_week(spark, sf):
    from ..operators.notifications import bucket_by_week
    return bucket_by_week(A.notifications_events(spark, sf), AS_OF).select("nid", "seq", "age_days", "bucket")


@query("active_notifications", f"""SELECT seq, nid FROM ({SQL_NOTES_NID}) n
WHERE {S.parse_iso('publish_date_raw')} IS NOT NULL
  AND epoch_us({AS_OF_SQL}) - epoch_us({S.parse_iso("publish_date_raw")}) < CAST(172800000000 AS BIGINT)""")
def q_active_notifications(spark, sf):
    from ..operators.notifications import active_notifications, with_nid
    return active_notifications(with_nid(A.notifications_events(spark, sf)), AS_OF).select("seq", "nid")


@query("last_scrape_info", f"""SELECT strftime(max(scrape_date), {_TS_FMT_SQL}) AS last_scrape, count(*) AS scrape_count,
       count(*) FILTER (WHERE CAST(scrape_date AS DATE) = (SELECT CAST(max(scrape_date) AS DATE) FROM events_n)) AS new_items_this_session
FROM events_n""".replace("events_n", f"({SQL_NOTIFICATIONS}) e"))
def q_last_scrape_info(spark, sf):
    from ..operators.notifications import last_scrape_info
    out = last_scrape_info(A.notifications_events(spark, sf))
    return out.select(_iso("last_scrape").alias("last_scrape"), "scrape_count", "new_items_this_session")


_SQL_SIDEBAR_LABEL = "lower(trim(coalesce(nullif(document_name, ''), nullif(title, ''), '')))"


def _sql_typed_score(link, ntype):
    host = f"lower({S.url_part(S.sanitize_link(link), 2)})"
    path = S.rstrip_slash(S.url_part(S.sanitize_link(link), 3))
    return (f"(CASE WHEN coalesce({link}, '') = '' THEN 0 ELSE "
            f"(CASE WHEN {path} <> '' THEN 10 ELSE 0 END) "
            f"+ (CASE WHEN length({path}) - length(replace({path}, '/', '')) > 1 THEN 10 ELSE 0 END) "
            f"+ (CASE WHEN {host} = 'www.nist.gov' AND (starts_with({ntype}, 'ai_') OR {ntype} IN ('publication', 'presentation', 'news')) THEN 20 ELSE 0 END) "
            f"+ (CASE WHEN {host} = 'csrc.nist.gov' AND starts_with({ntype}, 'pqc_') THEN 20 ELSE 0 END) "
            f"+ (CASE WHEN strpos({path}, '/publications/') > 0 OR strpos({path}, '/news-events/news/') > 0 OR strpos({path}, '/presentations/') > 0 THEN 10 ELSE 0 END) "
            f"+ (CASE WHEN {path} = '' THEN -50 ELSE 0 END) END)")


_SQL_SIDEBAR_KEY = f"(coalesce(type, '') || '::' || CASE WHEN {_SQL_SIDEBAR_LABEL} = '' THEN lower(trim(coalesce(link, ''))) ELSE {_SQL_SIDEBAR_LABEL} END)"


@query("dedupe_sidebar", f"""SELECT seq, type, title FROM (
  SELECT *, row_number() OVER (PARTITION BY {_SQL_SIDEBAR_KEY} ORDER BY {_sql_typed_score('link', 'type')} DESC, seq) AS rn
  FROM ({SQL_NOTIFICATIONS}) n) x WHERE rn = 1""")
def q_dedupe_sidebar(spark, sf):
    return DD.dedupe_sidebar(A.notifications_events(spark, sf)).select("seq", "type", F.col("item.title").alias("title"))


_SIDEBAR_TYPES = ("publication", "presentation", "news")


@query("group_notifications", f"""WITH b AS (
  SELECT *, {_SQL_AGE} AS age,
         CASE WHEN {_SQL_AGE} BETWEEN 0 AND 7 THEN 'week_1' WHEN {_SQL_AGE} BETWEEN 8 AND 14 THEN 'week_2' ELSE 'archived' END AS bucket
  FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY seq) AS rn FROM ({SQL_NOTES_NID}) n) x
  WHERE rn = 1 AND {_SQL_NOTE_DATE} IS NOT NULL AND type IN ('publication', 'presentation', 'news'))
SELECT bucket, type, seq, title FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket, {_SQL_SIDEBAR_KEY} ORDER BY {_sql_typed_score('link', 'type')} DESC, seq) AS rn2
  FROM b) y WHERE rn2 = 1""")
def q_group_notifications(spark, sf):
    from ..operators.notifications import group_notifications
    out = group_notifications(A.notifications_events(spark, sf), AS_OF, _SIDEBAR_TYPES)
    return out.select("bucket", "type", "seq", F.col("item.title").alias("title"))


NOTE_CUTOFF = "2024-01-15 00:00:00"


@query("filter_notifications_since", f"""SELECT seq FROM ({SQL_NOTIFICATIONS}) n
WHERE {S.item_date(['release_date_raw', 'release_date', 'publish_date_raw'])} >= TIMESTAMP '{NOTE_CUTOFF}'""")
def q_filter_notifications_since(spark, sf):
    return FL.filter_notifications_since(A.notifications_events(spark, sf), NOTE_CUTOFF).select("seq")


# ---------------------------------------------------------------------------
# 2.9 summary text functions and quality gates (whole document texts)
# ---------------------------------------------------------------------------

from ..functions import quality as Q  # noqa: E402

SQL_DOCS = "SELECT doc_id, text FROM documents"


def _docs_text(spark, sf):
    return read_table(spark, sf, "documents", ["doc_id", "text"])


_SQL_SENT = S.split_sentences("text")


@query("split_sentences", f"""SELECT doc_id, len({_SQL_SENT}) AS n_sentences,
       coalesce({_SQL_SENT}[1], '') AS first_sentence, coalesce({_SQL_SENT}[-1], '') AS last_sentence FROM documents""")
def q_split_sentences(spark, sf):
    d = _docs_text(spark, sf).withColumn("_s", Q.split_sentences("text"))
    return d.select("doc_id", F.size("_s").cast("long").alias("n_sentences"),
                    F.coalesce(F.try_element_at("_s", F.lit(1)), F.lit("")).alias("first_sentence"),
                    F.coalesce(F.try_element_at("_s", F.lit(-1)), F.lit("")).alias("last_sentence"))


@query("first_two_sentences", f"""SELECT doc_id, {S.first_sentences('text')} AS two,
       {S.first_sentences('text', 2, 'collapse')} AS two_display FROM documents""")
def q_first_two_sentences(spark, sf):
    d = _docs_text(spark, sf)
    return d.select("doc_id", Q.first_sentences("text").alias("two"),
                    Q.first_sentences("text", 2, clean="collapse").alias("two_display"))


@query("mid_phrase_start", f"""SELECT doc_id, {S.mid_phrase_start('text', Q.MID_PHRASE_WORDS)} AS mid_phrase,
       {S.sentence_marks('text')} AS sentence_marks FROM documents""")
def q_mid_phrase_start(spark, sf):
    d = _docs_text(spark, sf)
    return d.select("doc_id", Q.mid_phrase_start("text").alias("mid_phrase"), Q.sentence_marks("text").alias("sentence_marks"))


@query("has_gibberish", f"""SELECT doc_id, {S.has_gibberish('text', 'audit', Q)} AS audit,
       {S.has_gibberish('text', 'strict', Q)} AS strict, {S.has_gibberish('text', 'lenient', Q)} AS lenient FROM documents""")
def q_has_gibberish(spark, sf):
    d = _docs_text(spark, sf)
    return d.select("doc_id", *[Q.has_gibberish("text", v).alias(v) for v in ("audit", "strict", "lenient")])


@query("is_uninformative", f"""SELECT doc_id, {S.is_uninformative('text', 'summary', Q)} AS summary_gate,
       {S.is_uninformative('text', 'strict', Q)} AS strict_gate FROM documents""")
def q_is_uninformative(spark, sf):
    d = _docs_text(spark, sf)
    return d.select("doc_id", Q.is_uninformative("text", "summary").alias("summary_gate"),
                    Q.is_uninformative("text", "strict").alias("strict_gate"))


@query("complete_sentences", f"SELECT doc_id, {S.complete_sentences('text')} AS complete FROM documents")
def q_complete_sentences(spark, sf):
    return _docs_text(spark, sf).select("doc_id", Q.complete_sentences("text").alias("complete"))


@query("valid_summary", f"""SELECT doc_id, {S.valid_summary('text', Q)} AS valid_text,
       {S.valid_summary(S.first_sentences('text'), Q)} AS valid_two FROM documents""")
def q_valid_summary(spark, sf):
    d = _docs_text(spark, sf)
    return d.select("doc_id", Q.valid_summary("text").alias("valid_text"),
                    Q.valid_summary(Q.first_sentences("text")).alias("valid_two"))


_BAD = S.bad_summary("text", Q)


@query("bad_summary", f"SELECT doc_id, {_BAD[0]} IS NOT NULL AS is_bad, {_BAD[1]} AS reason, coalesce({_BAD[0]}, '') AS reason_kind FROM documents")
def q_bad_summary(spark, sf):
    d = _docs_text(spark, sf).withColumn("_b", Q.bad_summary("text"))
    return d.select("doc_id", "_b.is_bad", "_b.reason", "_b.reason_kind")


_AUD = S.audit_columns("text", Q)


@query("audit_summary", f"""SELECT doc_id, {_AUD['status']} AS status, {_AUD['score']} AS score,
       array_to_string({_AUD['issues']}, ' | ') AS issues, {_AUD['sentence_count']} AS sentence_count,
       {_AUD['audited']} AS audited FROM documents""")
def q_audit_summary(spark, sf):
    d = _docs_text(spark, sf).withColumn("_a", Q.audit_summary("text"))
    return d.select("doc_id", "_a.status", "_a.score", F.array_join("_a.issues", " | ").alias("issues"),
                    "_a.sentence_count", "_a.audited")


@query("audit_report", f"""WITH a AS (SELECT {_AUD['status']} AS status, {_AUD['score']} AS score,
                                  {_AUD['issues']} AS issues, {_AUD['audited']} AS audited FROM documents),
d AS (SELECT * FROM a WHERE audited),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
             sum(CAST(round(score * 100) AS BIGINT)) AS h FROM d),
i AS (SELECT split_part(issue, ':', 1) AS issue_type, count(*) AS issue_count
      FROM (SELECT unnest(issues) AS issue FROM d) u GROUP BY 1)
SELECT t.total, t.passed, t.total - t.passed AS failed, CAST(floor(t.passed * 100 / t.total) AS BIGINT) AS pass_pct,
       CAST(floor((t.total - t.passed) * 100 / t.total) AS BIGINT) AS fail_pct,
       round(CAST(t.h AS DOUBLE) / t.total) / CAST(100.0 AS DOUBLE) AS avg_score,
       i.issue_type, i.issue_count, CAST(floor(i.issue_count * 100 / t.total) AS BIGINT) AS issue_pct
FROM i, t""")
def q_audit_report(spark, sf):
    from ..operators.reports import audit, audit_report
    return audit_report(audit(_docs_text(spark, sf), "text"))


_CACHE_SQL = """SELECT doc_id AS seq, (['qis', 'pqc', 'ai_publications'])[doc_id % 3 + 1] AS topic, text AS summary,
       TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id % 72 AS BIGINT)) AS ts FROM documents"""
_CBAD = S.bad_summary("summary", Q)


@query("cache_cleanup", f"""SELECT topic, CASE WHEN {_CBAD[0]} IS NOT NULL THEN 'remove' ELSE 'keep' END AS action,
       coalesce({_CBAD[0]}, '') AS reason, count(*) AS n FROM ({_CACHE_SQL}) c GROUP BY ALL""")
def q_cache_cleanup(spark, sf):
    from ..operators.reports import cache_cleanup
    _, report = cache_cleanup(A.cache_docs(spark, sf))
    return report


# ---------------------------------------------------------------------------
# Remaining text / link functions
# ---------------------------------------------------------------------------

@query("truncate_sentence", f"""SELECT doc_id, CASE WHEN {S.pystrip('text')} = '' OR length({S.pystrip('text')}) <= 800
       THEN {S.pystrip('text')} ELSE {S.pystrip("regexp_replace(substr(" + S.pystrip('text') + ", 1, 800), '([.!?])[^.!?]*$', '" + chr(92) + "1')")} END AS truncated
FROM documents""")
def q_truncate_sentence(spark, sf):
    return _docs_text(spark, sf).select("doc_id", Q.truncate_sentence("text", 800).alias("truncated"))


@query("is_padded", f"""SELECT doc_id, (text <> '' AND {S.first_sentences('text')} <> '' AND {S.word_count('text')} > 30
       AND {S.word_count(S.first_sentences('text'))} > {S.word_count('text')} * CAST(0.5 AS DOUBLE)) AS padded FROM documents""")
def q_is_padded(spark, sf):
    d = _docs_text(spark, sf)
    return d.select("doc_id", Q.is_padded(Q.first_sentences("text"), F.col("text")).alias("padded"))


def _sql_title_fallback(summary, title):
    s, t = S.pystrip(summary), S.pystrip(title)
    traw = S.blank(title)
    cut = f"(CASE WHEN length({traw}) > 200 THEN substr({traw}, 1, 200) || '...' ELSE {traw} END)"
    ws = f"(CASE WHEN strpos(lower({cut}), 'publication') = 0 THEN 'Publication: ' || {cut} ELSE {cut} END)"
    return (f"(CASE WHEN {s} <> '' AND {t} <> '' AND lower({s}) <> lower({t}) THEN {s} "
            f"WHEN {traw} = '' THEN {S.q(T.PUBLICATION_PLACEHOLDER)} "
            f"WHEN lower({S.pystrip(ws)}) = lower({t}) THEN '' ELSE {ws} END)")


@query("title_fallback_summary", f"""SELECT seq, {_sql_title_fallback("CASE WHEN seq % 2 = 0 THEN summary ELSE '' END", 'document_name')} AS summary
FROM ({SQL_ITEMS_DOCS}) d""")
def q_title_fallback_summary(spark, sf):
    d = _docs(spark, sf)
    summ = F.when(F.col("seq") % 2 == 0, F.col("summary")).otherwise(F.lit(""))
    return d.select("seq", T.title_fallback_summary(summ, F.col("document_name")).alias("summary"))


@query("news_fallback_summary", f"""SELECT seq, CASE WHEN coalesce(summary, '') <> '' THEN summary
       WHEN length(title) > 50 THEN substr(title, 1, 80) || '...' ELSE 'News article about ' || lower(title) || '.' END AS summary
FROM ({SQL_ITEMS_PAGES}) p""")
def q_news_fallback_summary(spark, sf):
    return A.items_pages(spark, sf).select("seq", T.news_fallback_summary("summary", "title").alias("summary"))


@query("absolutize_link", f"""SELECT page_id, CASE WHEN rel = '' THEN rel WHEN starts_with(rel, 'http') THEN rel
       ELSE 'https://csrc.example.gov' || CASE WHEN starts_with(rel, '/') THEN '' ELSE '/' END || rel END AS link
FROM (SELECT page_id, {S.url_part('url', 3)} AS rel FROM pages) p""")
def q_absolutize_link(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"]).withColumn("rel", L.url_parts("url")[2])
    return p.select("page_id", L.absolutize_link("rel", "https://csrc.example.gov/").alias("link"))


def _sql_due(text):
    pats = [f"regexp_extract({S.collapse(text)}, {S.q('(?i)' + p)}, 1)" for p in D.DUE_DATE_PATTERNS]
    parsed = "coalesce(" + ", ".join(f"CASE WHEN {p} <> '' THEN {S.parse_date(p, 'dashboard')} END" for p in pats) + ")"
    return parsed


@query("third_person", f"""SELECT doc_id, {S.third_person('text', Q, 'summary')} AS summary_form,
       {S.third_person('text', Q, 'model')} AS model_form FROM documents""")
def q_third_person(spark, sf):
    d = _docs_text(spark, sf)
    return d.select("doc_id", Q.third_person("text", "summary").alias("summary_form"),
                    Q.third_person("text", "model").alias("model_form"))


_TP = S.third_person("text", Q, "summary")
_TWO = S.first_sentences(_TP)


@query("strip_terms", f"SELECT doc_id, {S.strip_summary_terms('text', Q)} AS text FROM documents")
def q_strip_terms(spark, sf):
    return _docs_text(spark, sf).select("doc_id", Q.strip_summary_terms("text").alias("text"))


@query("repair_summaries", f"""WITH d AS (SELECT seq, summary, document_name, {S.pystrip('summary')} AS cur FROM ({SQL_ITEMS_DOCS}) x),
e AS (SELECT *, {S.first_sentences('cur', 2, 'collapse')} AS norm FROM d),
f AS (SELECT *, (cur = '' OR {S.mid_phrase_start('cur', Q.MID_PHRASE_WORDS)} OR norm <> cur) AS cand,
             CASE WHEN cur <> '' AND lower(cur) <> lower({S.pystrip('document_name')}) THEN cur ELSE '' END AS best FROM e),
g AS (SELECT *, {S.first_sentences('best', 2, 'collapse')} AS best_two FROM f)
SELECT seq, cand AS repair_candidate,
       CASE WHEN NOT cand THEN summary
            WHEN best_two <> '' AND NOT {S.mid_phrase_start('best_two', Q.MID_PHRASE_WORDS)} THEN best_two
            WHEN norm <> '' AND NOT {S.mid_phrase_start('norm', Q.MID_PHRASE_WORDS)} THEN norm ELSE summary END AS summary
FROM g""")
def q_repair_summaries(spark, sf):
    from ..operators.reports import repair_summaries
    return repair_summaries(_docs(spark, sf)).select("seq", "repair_candidate", "summary")


@query("cache_lookup", f"""WITH c AS ({_CACHE_SQL}),
latest AS (SELECT md5({S.pystrip('summary')}) AS cache_key, topic, arg_max(summary, ts) AS summary, max(ts) AS ts
           FROM c GROUP BY 1, 2),
i AS (SELECT seq, (['qis', 'pqc', 'ai_publications'])[seq % 3 + 1] AS topic, md5({S.pystrip('summary')}) AS cache_key
      FROM ({SQL_ITEMS_DOCS}) d)
SELECT i.seq, l.summary IS NOT NULL AS hit FROM i LEFT JOIN latest l
  ON l.cache_key = i.cache_key AND l.topic = i.topic AND l.ts >= {AS_OF_SQL} - INTERVAL 48 HOUR
  AND NOT (coalesce(l.summary, '') <> '' AND ({S.is_uninformative('l.summary', 'summary', Q)} OR {S.mid_phrase_start('l.summary', Q.MID_PHRASE_WORDS)}))""")
def q_cache_lookup(spark, sf):
    from ..operators.enrich import cache_lookup
    topic = F.element_at(F.array(*[F.lit(t) for t in A.CACHE_TOPICS]), (F.col("seq") % 3 + 1).cast("int"))
    items = _docs(spark, sf).select("seq", topic.alias("topic"), T.cache_key("summary").alias("cache_key"))
    out = cache_lookup(items, A.cache_docs(spark, sf), as_of=AS_OF, ttl_hours=48)
    return out.select("seq", F.col("cached_summary").isNotNull().alias("hit"))


# ---------------------------------------------------------------------------
# 2.4 page extraction (one mapInPandas pass; rows-only checks, unit-tested by hand)
# ---------------------------------------------------------------------------

from ..functions import html as H  # noqa: E402
from ..operators import extract as X  # noqa: E402


_ABS_LOW = f"lower({S.pystrip('text')})"


@query("is_likely_abstract", f"""SELECT doc_id, (length({S.pystrip('text')}) >= 50 AND NOT {S.contains_any(_ABS_LOW, H.ABSTRACT_BOILERPLATE)}
       AND {S.word_count('text')} >= 10 AND {S.contains_any(_ABS_LOW, H.RESEARCH_INDICATORS)}) AS likely_abstract FROM documents""")
def q_is_likely_abstract(spark, sf):
    return _docs_text(spark, sf).select("doc_id", H.is_likely_abstract("text").alias("likely_abstract"))


@query("page_language", """SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<html[^>]*\\slang\\s*=\\s*["'']([^"'']+)["'']', 1), ''), 'en') AS lang FROM pages""")
def q_page_language(spark, sf):
    return read_pages(spark, sf).select("page_id", H.page_language("html").alias("lang"))


# ---------------------------------------------------------------------------
# 2.1 snapshot / notification / cache stores, 2.10 streaming
# ---------------------------------------------------------------------------

import uuid  # noqa: E402

from ..session import scratch_path  # noqa: E402


def _scratch(spark, name):
    return scratch_path(spark, f"tidefeed-{name}-{uuid.uuid4().hex}")


@query("write_snapshot", f"""SELECT topic, section, count(*) AS n FROM ({SQL_MERGE_PAGES}) m GROUP BY topic, section""")
def q_write_snapshot(spark, sf):
    from ..sources.snapshots import write_snapshot
    items = materialize(A.items_pages(spark, sf).select("seq", "topic", "section", "title", "link", "summary"))
    return write_snapshot(items, _scratch(spark, "snap"), as_of=AS_OF)


@query("latest_snapshot", f"""SELECT seq, identity, title, link FROM ({SQL_CURR}) c""")
def q_latest_snapshot(spark, sf):
    from ..sources.snapshots import latest_snapshot, read_snapshots, write_snapshot
    path = _scratch(spark, "snaps")
    items = materialize(A.items_pages(spark, sf).select("seq", "topic", "section", "title", "link", "summary"))
    write_snapshot(items.where(A.in_prev_crawl()), path, as_of="2024-01-30 00:00:00")
    write_snapshot(items.where(A.in_curr_crawl()), path, as_of=AS_OF)
    return latest_snapshot(read_snapshots(spark, path), "qis").select("seq", "identity", "title", "link")


@query("read_notifications", SQL_DEDUPE_NOTES)
def q_read_notifications(spark, sf):
    from ..sources.notifications_io import read_notifications, write_notifications
    path = _scratch(spark, "notes")
    write_notifications(A.notifications_events(spark, sf), path, dedupe=False)
    from ..operators.notifications import with_nid
    return _flat_notes(with_nid(read_notifications(spark, path)))


@query("write_summary_cache", f"""WITH c AS ({_CACHE_SQL})
SELECT topic, md5({S.pystrip('summary')}) AS key, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts
FROM c GROUP BY 1, 2""")
def q_write_summary_cache(spark, sf):
    from ..sources.cache_io import cache_store, put_cache
    store = cache_store(spark, _scratch(spark, "cache-store"), buckets=8)
    cache = materialize(A.cache_docs(spark, sf).select("topic", "key", "kind", "ts", "summary"), compression="zstd")
    put_cache(store, cache)
    # the same entries written again one hour later overwrite the first write
    put_cache(store, cache.withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.lit(1))))
    return store.read().select("topic", "key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


FEED_FILES, FEED_SLICES = 2, 8
# items without their day, so that an identity (type, item) comes back in later slices
_SQL_UNDATED = f"""SELECT *, {_NID_SQL} AS nid, seq * {FEED_SLICES} // (SELECT max(event_id) + 1 FROM events) AS slice
FROM (SELECT * REPLACE ('' AS publish_date_raw) FROM ({SQL_NOTIFICATIONS}) n0) u"""


def _undated_slices(spark, sf):
    ev = A.notifications_events(spark, sf)
    upto = ev.agg(F.max("seq") + 1).scalar()
    return (ev.withColumn("item", F.col("item").withField("publish_date_raw", F.lit("")))
              .withColumn("slice", F.floor(F.col("seq") * FEED_SLICES / upto)))


def _feed(spark, rows):
    """A stream that delivers the slices of ``rows`` one after the other, one a micro-batch."""
    src = _scratch(spark, "stream-src")
    kept = materialize(rows)
    for k in range(FEED_SLICES):
        kept.where(F.col("slice") == k).drop("slice").repartition(FEED_FILES).write.mode("append").parquet(src)
    return spark.readStream.schema(kept.drop("slice").schema).option("maxFilesPerTrigger", FEED_FILES).parquet(src)


@query("stream_new_items", f"SELECT nid, min(seq) AS seq, min(slice) AS batch_id FROM ({_SQL_UNDATED}) n GROUP BY nid")
def q_stream_new_items(spark, sf):
    from ..streaming.streams import latest_table, stream_first_seen
    table = _scratch(spark, "stream-table")
    feed = _feed(spark, _undated_slices(spark, sf))
    stream_first_seen(feed, table, _scratch(spark, "stream-ckpt"), buckets=8).awaitTermination()
    return latest_table(spark, table).select("nid", "seq", "batch_id")


# Slices are ten days apart and the horizon is four: state of a slice is gone from the third slice after it on.
@query("stream_new_items_horizon", f"""WITH s AS (SELECT nid, list(DISTINCT slice ORDER BY slice) AS slices FROM ({_SQL_UNDATED}) n GROUP BY nid)
SELECT nid, unnest(list_reduce(list_transform(slices, lambda x: [x]),
       lambda seen, x: CASE WHEN x[1] >= seen[-1] + 3 THEN list_concat(seen, x) ELSE seen END)) AS slice FROM s""")
def q_stream_new_items_horizon(spark, sf):
    from ..streaming.streams import stream_new_items
    table = _scratch(spark, "stream-table")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    timed = _undated_slices(spark, sf).withColumn("timestamp", start + F.make_dt_interval(days=(F.col("slice") * 10).cast("int")))
    new = stream_new_items(_feed(spark, timed), horizon="4 days").select("nid", "timestamp")
    new.writeStream.format("parquet").option("checkpointLocation", _scratch(spark, "stream-ckpt")).trigger(
        availableNow=True).start(table).awaitTermination()
    written = spark.read.schema("nid string, timestamp timestamp_ntz").parquet(table)
    return written.select("nid", (F.datediff(F.col("timestamp"), start) / 10).cast("long").alias("slice"))


@query("stream_upsert_notifications", SQL_DEDUPE_NOTES)
def q_stream_upsert_notifications(spark, sf):
    from ..streaming.streams import latest_table, stream_upsert_notifications
    table = _scratch(spark, "upsert-table")
    # events dealt by number, so every identity of several events is merged across batches
    feed = _feed(spark, A.notifications_events(spark, sf).withColumn("slice", F.col("seq") % FEED_SLICES))
    stream_upsert_notifications(feed, table, _scratch(spark, "upsert-ckpt"), buckets=8).awaitTermination()
    return _flat_notes(latest_table(spark, table))


# ---------------------------------------------------------------------------
# Cascade, append, banner, preview, paging
# ---------------------------------------------------------------------------

def _sql_cascade():
    ab = S.clean_text("summary")
    tp = lambda x: S.first_sentences(S.third_person(x, Q, "summary"))
    mid = lambda x: S.mid_phrase_start(x, Q.MID_PHRASE_WORDS)
    uninf = lambda x: S.is_uninformative(x, "summary", Q)
    return f"""WITH c AS ({_CACHE_SQL}),
latest AS (SELECT md5({S.pystrip('summary')}) AS key, topic, arg_max(summary, ts) AS summary, max(ts) AS ts FROM c GROUP BY 1, 2),
hit AS (SELECT key, topic, summary FROM latest WHERE ts >= {AS_OF_SQL} - INTERVAL 48 HOUR
        AND NOT (coalesce(summary, '') <> '' AND ({uninf('summary')} OR {mid('summary')}))),
i AS (SELECT seq, (['qis', 'pqc', 'ai_publications'])[seq % 3 + 1] AS topic, {ab} AS abstract FROM ({SQL_ITEMS_DOCS}) d),
j AS (SELECT i.*, h.summary AS cached FROM i LEFT JOIN hit h ON h.key = md5({S.pystrip('i.abstract')}) AND h.topic = i.topic),
k AS (SELECT *, {tp('cached')} AS cached_out, {S.strip_contact_info('abstract', Q)} AS cl FROM j),
m AS (SELECT *, {tp(S.first_sentences('cl'))} AS own, {S.split_sentences('cl')}[1] AS first1 FROM k)
SELECT seq, CASE WHEN abstract = '' THEN ''
                 WHEN coalesce(cached, '') <> '' AND NOT {mid('cached_out')} THEN cached_out
                 WHEN cl = '' OR {uninf('cl')} THEN ''
                 WHEN own <> '' AND NOT {mid('own')} THEN own
                 WHEN first1 IS NOT NULL AND NOT {uninf('first1')} AND NOT {mid('first1')} THEN first1
                 ELSE '' END AS generated_summary
FROM m"""


@query("summary_cascade", _sql_cascade())
def q_summary_cascade(spark, sf):
    from ..operators.summaries import summary_cascade
    topic = F.element_at(F.array(*[F.lit(t) for t in A.CACHE_TOPICS]), (F.col("seq") % 3 + 1).cast("int"))
    items = _docs(spark, sf).withColumn("topic", topic)
    out = summary_cascade(items, cache=A.cache_docs(spark, sf), as_of=AS_OF)
    return out.select("seq", "generated_summary")


_SQL_PREV_ITEMS = SQL_ITEMS_PAGES + SQL_PREV_WHERE
_SQL_CURR_ITEMS = SQL_ITEMS_PAGES + SQL_CURR_WHERE


@query("append_new", f"""WITH e AS ({_SQL_PREV_ITEMS}), n AS ({_SQL_CURR_ITEMS}),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(title, '') ORDER BY seq) AS rn FROM n) x
          WHERE rn = 1 AND coalesce(title, '') NOT IN (SELECT coalesce(title, '') FROM e))
SELECT 'existing' AS src, seq, title FROM e UNION ALL SELECT 'new' AS src, seq, title FROM fresh""")
def q_append_new(spark, sf):
    items = materialize(A.items_pages(spark, sf).select("seq", "title", "link"))
    existing = items.where(A.in_prev_crawl()).withColumn("src", F.lit("existing"))
    new = items.where(A.in_curr_crawl()).withColumn("src", F.lit("new"))
    return DF.append_new(existing, new, key="title").select("src", "seq", "title")


@query("new_item_banner", f"""WITH n AS (SELECT c.* FROM ({SQL_CURR}) c WHERE NOT EXISTS (SELECT 1 FROM ({SQL_PREV}) p
        WHERE p.topic = c.topic AND p.section = c.section AND p.identity = c.identity)),
t AS (SELECT DISTINCT topic FROM n),
g AS (SELECT topic, s.section FROM t, (VALUES ('publications'), ('presentations'), ('news')) s(section)
      UNION SELECT DISTINCT topic, section FROM n)
SELECT g.topic, g.section, CAST(count(n.identity) AS BIGINT) AS n, CAST(count(n.identity) AS BIGINT) AS banner,
       count(n.identity) >= 1 AS show
FROM g LEFT JOIN n ON g.topic = n.topic AND g.section = n.section GROUP BY g.topic, g.section""")
def q_new_item_banner(spark, sf):
    from ..operators.reports import new_item_banner
    new = q_new_items(spark, sf)
    return new_item_banner(new, False)


@query("head_preview", f"""SELECT seq, document_name, CAST(row_number() OVER (ORDER BY {_SQL_PUB_DATE} DESC NULLS LAST, seq) - 1 AS INTEGER) AS position
FROM ({SQL_ITEMS_DOCS}) d ORDER BY {_SQL_PUB_DATE} DESC NULLS LAST, seq LIMIT 5""")
def q_head_preview(spark, sf):
    from ..operators.ordering import head_preview
    d = _docs(spark, sf).withColumn("_d", D.item_date(_PUB_KEYS))
    return head_preview(d, 5, [F.desc_nulls_last("_d"), F.col("seq")], position="position").select("seq", "document_name", "position")


_SQL_PAGES_TABLE = f"""SELECT source AS listing, CAST(doc_id // 20 AS INTEGER) AS page, count(*) AS n_items,
       count(*) FILTER (WHERE {S.parse_date('release_date', 'listing')} >= TIMESTAMP '{CUTOFF_365}') AS n_added
FROM (SELECT d.*, x.release_date FROM documents d JOIN ({SQL_ITEMS_DOCS}) x ON x.seq = d.doc_id) y GROUP BY 1, 2"""


@query("stop_after_stale_pages", f"""WITH p AS (SELECT * FROM ({_SQL_PAGES_TABLE}) z),
m AS (SELECT *, sum(CASE WHEN n_added = 0 THEN 1 ELSE 0 END) OVER w3 AS stale_run, count(*) OVER w3 AS run_len
      FROM p WINDOW w3 AS (PARTITION BY listing ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, least(min(CASE WHEN n_items = 0 THEN page END) OVER (PARTITION BY listing),
                      min(CASE WHEN n_items <> 0 AND run_len = 3 AND stale_run = 3 THEN page + 1 END) OVER (PARTITION BY listing)) AS lim
      FROM m)
SELECT listing, page, n_items, n_added FROM s WHERE lim IS NULL OR page < lim""")
def q_stop_after_stale_pages(spark, sf):
    from ..operators.ordering import stop_after_stale_pages
    dated = A.items_docs(spark, sf, keep=["source"]).select("seq", "source", "release_date")
    in_range = D.parse_date("release_date", "listing") >= F.lit(CUTOFF_365).cast("timestamp_ntz")
    pages = (dated.groupBy(F.col("source").alias("listing"), (F.col("seq") / 20).cast("int").alias("page"))
                  .agg(F.count(F.lit(1)).alias("n_items"), F.count_if(in_range).alias("n_added")))
    return stop_after_stale_pages(pages)


@query("limit_two_sentences", f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN ''
       WHEN len(regexp_extract_all(text, {S.q(S.SENTENCE_RE)})) >= 2
         THEN {S.pystrip("array_to_string(list_slice(regexp_extract_all(text, " + S.q(S.SENTENCE_RE) + "), 1, 2), ' ')")}
       WHEN len(regexp_extract_all(text, {S.q(S.SENTENCE_RE)})) = 1
         THEN {S.pystrip("regexp_extract_all(text, " + S.q(S.SENTENCE_RE) + ")[1]")}
       ELSE {S.pystrip('text')} || CASE WHEN regexp_matches({S.pystrip('text')}, '[.!?]$') THEN '' ELSE '.' END END AS two
FROM documents""")
def q_limit_two_sentences(spark, sf):
    return _docs_text(spark, sf).select("doc_id", Q.limit_two_sentences("text").alias("two"))


@query("drop_presentations_exact", f"""SELECT seq FROM ({SQL_NOTIFICATIONS}) n
WHERE NOT (lower({S.pystrip('type')}) IN ('presentation', 'presentations'))""")
def q_drop_presentations_exact(spark, sf):
    n = A.notifications_events(spark, sf)
    return FL.drop_presentations(n, resource_type="type", exact=True).select("seq")


from . import catalog_pages, catalog_stores  # noqa: E402,F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
