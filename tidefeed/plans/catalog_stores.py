"""Registered queries over import readers, stored payloads, report totals and the whole feed run."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import html_pages as P
from . import sqlgen as S
from ..functions import quality as Q
from ..operators import extract as X
from ..functions.identity import item_identity
from ..operators.diff import compare_snapshots, has_changed, new_items, union_sources
from ..operators.filters import filter_recent_source
from ..operators.merge import merge_items
from ..operators.reports import audit, audit_totals, repair_counts, repair_summaries
from ..operators.summaries import summary_cascade
from ..session import materialize, scratch_path, shuffles_removed
from ..sources.cache_io import cache_store, expire_cache, extraction_table, put_cache, read_summary_cache
from ..sources.snapshots import open_keyed_snapshot, read_snapshot_json, stored_counts, write_keyed_snapshot
from ..sources.tables import read_table
from . import adapters as A
from .catalog import _AUD, _CACHE_SQL, _PAGE_FIELDS, AS_OF_SQL, REGISTRY, SQL_ITEMS_DOCS, query
from .catalog_pages import _record_sql

#: Documents that the readers are given, whatever the number of rows.
FILES = 8
_PART = f"{{0}} * {FILES} // (SELECT max(doc_id) + 1 FROM documents)"


#: Rows of a document that a task writes.
TASK_ROWS = 20_000


def _json_files(spark, sf, rows, entry, before: str, after: str, name: str):
    """Write rows (``n``) as ``FILES`` JSON documents, entries in order of ``n``; returns the folder.

    A document is a folder of compressed files that follow one another by name, so that many tasks write it.
    """
    path = scratch_path(spark, f"tidefeed-{name}-{uuid.uuid4().hex}")
    upto, count = read_table(spark, sf, "documents", ["doc_id"]).agg(F.max("doc_id") + 1, F.count(F.lit(1))).first()
    placed = rows.withColumn("part", F.floor(F.col("n") * FILES / upto))
    bounds = placed.groupBy("part").agg(F.min("n").alias("low"), F.max("n").alias("high")).withColumnRenamed("part", "of")  # a row per document
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // TASK_ROWS)
    ranges = placed.select("part", "n", entry.alias("entry")).repartitionByRange(tasks, "part", "n")
    same = Window.partitionBy("part", "n")  # rows of one number are in one range
    ranges = ranges.select("part", "n", "entry", F.row_number().over(same.orderBy("n")).alias("at"), F.count(F.lit(1)).over(same).alias("alike"))
    found = ranges.join(F.broadcast(bounds), F.col("part").eqNullSafe(F.col("of")))
    first = F.col("n").eqNullSafe(F.col("low")) & (F.col("at") == 1)
    last = F.col("n").eqNullSafe(F.col("high")) & (F.col("at") == F.col("alike"))
    value = F.concat(F.when(first, before).otherwise(","), "entry", F.when(last, after).otherwise(""))
    written = found.select("part", "n", "at", value.alias("value")).sortWithinPartitions("part", "n", "at").select("part", "value")
    with shuffles_removed(spark):
        written.write.partitionBy("part").text(path, compression="lz4")
    return path


@query("read_snapshot", f"""SELECT 'pqc' AS topic, 'publications' AS section, row_number() OVER (PARTITION BY {_PART.format('seq')} ORDER BY seq) - 1 AS seq,
       document_name, summary, release_date FROM ({SQL_ITEMS_DOCS}) d""")
def q_read_snapshot(spark, sf):
    items = A.items_docs(spark, sf).withColumn("n", F.col("seq"))
    entry = F.to_json(F.struct("document_name", "summary", "release_date"))
    path = _json_files(spark, sf, items, entry, '{"timestamp": "2024-01-31T00:00:00", "data": {"publications": [', "]}}", "envelopes")
    return read_snapshot_json(spark, path, "pqc", folders=True).select("topic", "section", "seq", "document_name", "summary", "release_date")


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'item' WHEN 1 THEN 'km' ELSE 'te' END"
_KEY = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'km_' ELSE 'te_' END || md5(CAST(doc_id AS VARCHAR))"


def _cache_docs(spark, sf):
    """Cache maps of documents: a text, or a stored payload of either kind."""
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    n, text = F.col("doc_id"), F.col("text")
    km = F.to_json(F.struct(F.lit("d").alias("domain"), text.alias("problem"), text.alias("keywords")))
    te = F.to_json(F.struct(text.alias("technical_core"), text.alias("system_entities")))
    entry = F.struct(F.lit("2024-01-30T10:00:00").alias("timestamp"), F.when(n % 3 == 1, km).when(n % 3 == 2, te).otherwise(text).alias("summary"))
    kind = F.when(n % 3 == 1, "km_").when(n % 3 == 2, "te_").otherwise("")
    member = F.concat(F.lit('"'), kind, F.md5(n.cast("string").cast("binary")), F.lit('": '), F.to_json(entry))
    return read_summary_cache(spark, _json_files(spark, sf, d.withColumn("n", n), member, "{", "}", "cache-maps"), "pqc", folders=True)


@query("read_summary_cache", f"""SELECT 'pqc' AS topic, {_KEY} AS key, {_KIND} AS kind, text AS summary FROM documents""")
def q_read_summary_cache(spark, sf):
    payload = F.when(F.col("kind") == "km", F.get_json_object("summary", "$.problem")).when(
        F.col("kind") == "te", F.get_json_object("summary", "$.technical_core")).otherwise(F.col("summary"))
    return _cache_docs(spark, sf).select("topic", "key", "kind", payload.alias("summary"))


@query("extraction_table", f"""WITH k AS (SELECT doc_id, text, unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]*,[ \\t\\n\\x0B\\f\\r]*')) AS u FROM documents)
SELECT 'km' AS kind, {_KEY} AS key, text AS main, u AS listed FROM k WHERE doc_id % 3 = 1
UNION ALL SELECT 'te', {_KEY}, text, u FROM k WHERE doc_id % 3 = 2""")
def q_extraction_table(spark, sf):
    cache = _cache_docs(spark, sf)
    km = extraction_table(cache, "km").select(F.lit("km").alias("kind"), "key", F.col("problem").alias("main"), F.col("keywords").alias("listed"))
    te = extraction_table(cache, "te").select(F.lit("te").alias("kind"), "key", F.col("technical_core").alias("main"), F.col("system_entities").alias("listed"))
    return km.unionByName(te)


@query("audit_totals", f"""WITH a AS (SELECT {_AUD['status']} AS status, {_AUD['score']} AS score, {_AUD['audited']} AS audited FROM documents),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
             sum(CAST(round(score * 100) AS BIGINT)) AS h FROM a WHERE audited)
SELECT total, passed, failed, CAST(floor(passed * 100 / total) AS BIGINT) AS pass_pct, CAST(floor(failed * 100 / total) AS BIGINT) AS fail_pct,
       round(CAST(h AS DOUBLE) / total) / CAST(100.0 AS DOUBLE) AS avg_score FROM t""")
def q_audit_totals(spark, sf):
    return audit_totals(audit(read_table(spark, sf, "documents", ["doc_id", "text"]), "text"))


@query("repair_counts", f"""WITH d AS (SELECT seq, summary, document_name, {S.pystrip('summary')} AS cur FROM ({SQL_ITEMS_DOCS}) x),
e AS (SELECT *, {S.first_sentences('cur', 2, 'collapse')} AS norm FROM d),
f AS (SELECT *, (cur = '' OR {S.mid_phrase_start('cur', Q.MID_PHRASE_WORDS)} OR norm <> cur) AS cand,
             CASE WHEN cur <> '' AND lower(cur) <> lower({S.pystrip('document_name')}) THEN cur ELSE '' END AS best FROM e),
g AS (SELECT *, {S.first_sentences('best', 2, 'collapse')} AS best_two FROM f),
h AS (SELECT cand, summary, CASE WHEN NOT cand THEN summary WHEN best_two <> '' AND NOT {S.mid_phrase_start('best_two', Q.MID_PHRASE_WORDS)} THEN best_two
             WHEN norm <> '' AND NOT {S.mid_phrase_start('norm', Q.MID_PHRASE_WORDS)} THEN norm ELSE summary END AS fixed FROM g)
SELECT count(*) FILTER (WHERE cand) AS candidates, count(*) FILTER (WHERE cand AND coalesce(fixed, '') <> coalesce(summary, '')) AS updated FROM h""")
def q_repair_counts(spark, sf):
    return repair_counts(repair_summaries(A.items_docs(spark, sf)))


CUTOFF = "2023-01-31 00:00:00"


def _items(source: str) -> str:
    """A source's records as merge input; ``seq`` is page, then place in the page."""
    return f"""SELECT page_id * 1000 + pos AS seq, section, name, link, summary, date, date_raw FROM ({_record_sql(source)}) r"""


def _identity(name: str = "name", date: str = "coalesce(nullif(date_raw, ''), date)") -> str:
    token, label = S.normalize_text(date), S.normalize_text(name)
    return f"CASE WHEN {token} <> '' THEN 'label::' || {label} || '::date::' || {token} ELSE 'label::' || {label} END"


@query("feed_run", f"""WITH pub AS (SELECT * FROM ({_items('pqc_publications')}) WHERE {S.parse_date('date', 'listing')} >= TIMESTAMP '{CUTOFF}'),
items AS (SELECT *, {_identity()} AS identity FROM (SELECT * FROM pub UNION ALL SELECT * FROM ({_items('pqc_news')}))),
old AS (SELECT DISTINCT section, identity FROM items WHERE seq % 1000 < 10)
SELECT section, identity, min(seq) AS seq FROM items i WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.section = i.section AND o.identity = i.identity)
GROUP BY section, identity""")
def q_feed_run(spark, sf):
    """Listing pages -> item rows -> recent ones -> merged -> new against a crawl that read half of each page."""
    rows = []
    for source, topic, section, date in (("pqc_publications", "pqc", "publications", "release_date"), ("pqc_news", "pqc", "news", "publish_date")):
        found = X.listing_records(P.listing_pages(spark, sf, source), source)
        found = found.withColumn("seq", F.col("page_id") * 1000 + F.col("pos")).drop("page_id")
        rows.append(filter_recent_source(found, CUTOFF, topic, section, date_col=date))
    items = materialize(union_sources(*rows))
    groups = ("topic", "section")
    current = merge_items(items.drop("pos"), group_cols=groups)
    before = merge_items(items.where("pos < 10").drop("pos"), group_cols=groups)
    return new_items(current, before).select("section", "identity", "seq")


_SQL_SHORT = f"""SELECT doc_id, text, {S.clean_text('name')} AS abstract, doc_id % 2 = 0 AS has_page FROM
(SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS name FROM documents) d"""


def _two(x: str) -> str:
    return S.first_sentences(S.third_person(x, Q, "summary"))


_MID = lambda x: S.mid_phrase_start(x, Q.MID_PHRASE_WORDS)
_BAD = lambda x: S.is_uninformative(x, "summary", Q)
_PAGE_SUMMARY = "'The report on topic ' || doc_id || ' describes a method for secure exchange. It gives results. More follows. ' || text"


@query("summary_cascade_pages", f"""WITH i AS ({_SQL_SHORT}), j AS (SELECT *, {S.strip_contact_info('abstract', Q)} AS cl, {_PAGE_SUMMARY} AS ps FROM i),
k AS (SELECT *, {_two(S.first_sentences('cl'))} AS own, {S.split_sentences('cl')}[1] AS first1, {_two('ps')} AS page FROM j)
SELECT doc_id AS seq, CASE WHEN abstract <> '' THEN
         CASE WHEN cl = '' OR {_BAD('cl')} THEN '' WHEN own <> '' AND NOT {_MID('own')} THEN own
              WHEN first1 IS NOT NULL AND NOT {_BAD('first1')} AND NOT {_MID('first1')} THEN first1 ELSE '' END
       WHEN has_page AND page <> '' AND NOT {_BAD('page')} AND NOT {_MID('page')} THEN page ELSE '' END AS generated_summary FROM k""")
def q_summary_cascade_pages(spark, sf):
    n = F.col("doc_id")
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    items = d.select(n.alias("seq"), F.lit("pqc").alias("topic"), F.lit("").alias("document_name"),
                     F.when(n % 3 == 0, F.col("text")).otherwise("").alias("summary"),
                     F.concat(F.lit("https://a.example.org/"), n).alias("link"), F.lit("Publication").alias("resource_type"))
    said = F.concat(F.lit("The report on topic "), n, F.lit(" describes a method for secure exchange. It gives results. More follows. "), F.col("text"))
    url = F.concat(F.lit("https://A.example.org/"), n, F.lit("/"))
    pages = d.where(n % 2 == 0).select(n.alias("page_id"), url.alias("url"), said.alias("summary"))
    # a later page of the same link, which must not be taken
    later = pages.select((F.col("page_id") + 10**9).alias("page_id"), "url", F.lit("Something else entirely is said here.").alias("summary"))
    out = summary_cascade(items, pages_summary=pages.unionByName(later), as_of=A.AS_OF)
    return out.select("seq", "generated_summary")


# Diffs against a stored snapshot, bucketed by the diff keys: the stored side is read in place.

def _against_stored(spark, sf):
    """The current crawl, merged, and the previous one as stored."""
    items = materialize(A.items_pages(spark, sf).withColumn("identity", item_identity()).select(
        "seq", "topic", "section", "identity", *_PAGE_FIELDS))
    path = scratch_path(spark, f"tidefeed-keyed-{uuid.uuid4().hex}")
    write_keyed_snapshot(items.where(A.in_prev_crawl()), path, as_of="2024-01-30 00:00:00")
    current = merge_items(items.where(A.in_curr_crawl()), group_cols=("topic", "section"), fields=_PAGE_FIELDS)
    return current, open_keyed_snapshot(spark, path)


@query("new_items_stored", REGISTRY["new_items"][1])
def q_new_items_stored(spark, sf):
    current, stored = _against_stored(spark, sf)
    return new_items(current, stored, merged=True)


@query("has_changed_stored", REGISTRY["has_changed"][1])
def q_has_changed_stored(spark, sf):
    current, stored = _against_stored(spark, sf)
    return has_changed(current, stored, group_cols=("topic", "section"))


@query("changed_items_stored", REGISTRY["changed_items"][1])
def q_changed_items_stored(spark, sf):
    current, stored = _against_stored(spark, sf)
    return compare_snapshots(current, stored, compare=["link"], merged=True)


@query("snapshot_counts", REGISTRY["write_snapshot"][1])
def q_snapshot_counts(spark, sf):
    items = materialize(A.items_pages(spark, sf).select("seq", "topic", "section", "title", "link", "summary"))
    path = scratch_path(spark, f"tidefeed-keyed-{uuid.uuid4().hex}")
    write_keyed_snapshot(items, path, as_of=A.AS_OF)
    return stored_counts(spark, path)


@query("cache_expiry", f"""WITH c AS ({_CACHE_SQL}), k AS (SELECT topic, md5({S.pystrip('summary')}) AS key, max(ts) AS ts FROM c
       WHERE coalesce(summary, '') <> '' GROUP BY 1, 2)
SELECT topic, key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM k WHERE ts >= {AS_OF_SQL} - INTERVAL 48 HOUR""")
def q_cache_expiry(spark, sf):
    store = cache_store(spark, scratch_path(spark, f"tidefeed-cache-{uuid.uuid4().hex}"), buckets=8)
    cache = materialize(A.cache_docs(spark, sf).select("topic", "key", "kind", "ts", "summary"))
    put_cache(store, cache)
    put_cache(store, cache)  # changes nothing
    expire_cache(store, "2024-01-29 00:00:00")
    return store.read().select("topic", "key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
