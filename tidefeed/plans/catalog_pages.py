"""Registered queries over rendered pages, links and phrases, with their DuckDB oracles.

The pages come from ``html_pages`` (rendered from ``documents``), so the oracles
select the same fields from ``documents`` and need no HTML parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as A
from . import html_pages as P
from . import sqlgen as S
from ..functions import dates as D
from ..functions import html as H
from ..functions import links as L
from ..functions import quality as Q
from ..functions.html import meta_content, page_language, tag_text
from ..operators import extract as X
from ..operators.enrich import enrich_due_dates, enrich_news_dates, enrich_summary
from ..operators.filters import tag_source
from ..session import materialize
from ..sources.tables import read_pages, read_table
from .catalog import AS_OF_SQL, SQL_ITEMS_DOCS, _sql_due, _sql_typed_score, query  # noqa: F401

# ---------------------------------------------------------------------------
# The adapters of html_pages in SQL
# ---------------------------------------------------------------------------

_DAY = "(DATE '2022-07-01' + CAST((doc_id * 37) % 700 AS INTEGER))"
_FIELDS = f"""SELECT d.doc_id, d.doc_id // {P.PER_PAGE} AS page_id, d.text, x.document_name AS name, x.release_date AS date,
       strftime({_DAY}, '%Y-%m-%d') AS iso, strftime({_DAY}, '%B %d, %Y') AS long_date, strftime({_DAY} + 9, '%Y-%m-%d') AS later,
       CASE d.doc_id % 3 WHEN 0 THEN '/pubs/' || d.doc_id WHEN 1 THEN 'https://www.nist.gov/publications/a/' || d.doc_id
            ELSE 'pubs/' || d.doc_id END AS href,
       'SP ' || CAST(d.doc_id % 7 AS VARCHAR) AS series, d.text AS line,
       CASE WHEN d.doc_id % 2 = 0 THEN 'Abstract: ' ELSE '' END || d.text AS marked_line,
       CASE WHEN d.doc_id % 2 = 0 THEN 'Final' ELSE 'Draft' END AS status
FROM documents d JOIN ({SQL_ITEMS_DOCS}) x ON x.seq = d.doc_id"""


def _listed(source: str, columns: str) -> str:
    """SQL over the blocks of a source that have a title; ``pos`` counts all blocks of a page."""
    return f"""SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY doc_id) - 1 AS INTEGER) AS pos
FROM ({_FIELDS}) f) b WHERE doc_id % {P.UNTITLED} <> 0 AND {S.clean_text('name')} <> ''"""


@query("listing_items", _listed("pqc_publications", f"""page_id, '{P.SITE}/pqc_publications?page=' || page_id AS page_url, pos,
       {S.clean_text('name')} AS title, href AS link, series, {S.clean_text('date')} AS date, {S.clean_text('line')} AS summary, '' AS status"""))
def q_listing_items(spark, sf):
    return X.listing_items(P.listing_pages(spark, sf, "pqc_publications"), "pqc_publications")


def _record_sql(source: str) -> str:
    """Rows of ``listing_records`` for one source, from the document fields."""
    section, constants, site, show, raw = X.LISTING_ROWS[source]
    qis_news = source == "qis_news"
    date = "(iso || 'T09:30:00Z')" if qis_news else S.clean_text("date")
    parsed = S.parse_date(date, "news" if qis_news else "listing")
    strict = parsed if qis_news else f"try_strptime({date}, '%B %d, %Y')"
    shown = {"listed": date, "style": f"coalesce({S.fmt_display(parsed)}, {date})", "only style": f"coalesce({S.fmt_display(parsed)}, '')",
             "none": "''"}[show]
    raws = {"parsed": f"coalesce({S.fmt_raw(parsed)}, '')", "or listed": f"coalesce({S.fmt_raw(strict)}, {date})", "none": "''"}[raw]
    plain = {"pqc_presentations": "''", "qis_presentations": "''", "ai_presentations": "''", "qis_news": "''",
             "pqc_publications": S.clean_text("line"), "qis_publications": S.clean_text("line")}
    link = f"CASE WHEN starts_with(href, 'http') THEN href ELSE '{site}' || CASE WHEN starts_with(href, '/') THEN '' ELSE '/' END || href END"
    series = f"'{constants['series']}'" if "series" in constants else "series" if section in ("publications", "presentations") else "''"
    status = f"'{constants['status']}'" if "status" in constants else "status" if source == "ai_presentations" else "''"
    return _listed(source, f"""'{source}' AS source, page_id, pos, '{source.split('_')[0]}' AS topic, '{section}' AS section,
       {S.clean_text('name')} AS name, {link} AS link, {plain.get(source, S.clean_text('marked_line'))} AS summary, {series} AS series, {status} AS status,
       '{constants.get('resource_type', '')}' AS resource_type, {shown} AS date, {raws} AS date_raw""")


def _records(spark, sf, sources):
    """Rows of several sources with their section's names written alike."""
    out = None
    for source in sources:
        rows = X.listing_records(P.listing_pages(spark, sf, source), source)
        names = {"document_name": "name", "title": "name", "release_date": "date", "publish_date": "date",
                 "release_date_raw": "date_raw", "publish_date_raw": "date_raw"}
        rows = rows.select(F.lit(source).alias("source"), *(F.col(c).alias(names.get(c, c)) for c in rows.columns))
        out = rows if out is None else out.unionByName(rows)
    return out


for _section in ("publications", "presentations", "news", "projects"):
    _sources = [s for s, row in X.LISTING_ROWS.items() if row[0] == _section]
    query(f"listing_{_section}", " UNION ALL ".join(_record_sql(s) for s in _sources))(
        lambda spark, sf, sources=tuple(_sources): _records(spark, sf, sources))


# ---------------------------------------------------------------------------
# Articles
# ---------------------------------------------------------------------------

_PUBLISHED = "CASE doc_id % 4 WHEN 0 THEN iso || 'T10:00:00Z' WHEN 1 THEN long_date WHEN 2 THEN long_date ELSE '' END"
_MODIFIED = "CASE WHEN doc_id % 5 = 3 THEN '' ELSE later END"
_URL = f"'{P.SITE}/doc/' || doc_id"


@query("article_dates", f"SELECT doc_id AS page_id, {_URL} AS url, {_PUBLISHED} AS published, {_MODIFIED} AS modified FROM ({_FIELDS}) f")
def q_article_dates(spark, sf):
    return X.article_dates(P.article_pages(spark, sf))


@query("next_page_links", f"""SELECT doc_id AS page_id, {_URL} AS url,
       CASE WHEN doc_id % 4 = 2 THEN 'https://other.example.org/' ELSE '{P.SITE}/doc/' END || (doc_id + 1) AS next_url
FROM documents WHERE doc_id % 4 = 2 OR (doc_id % 4 < 2 AND doc_id + 1 NOT IN (SELECT doc_id FROM documents))""")
def q_next_page_links(spark, sf):
    pages = P.article_pages(spark, sf)
    return X.next_page_links(pages, known=pages.select("url"))


_MODIFIED_TEXT = "CASE doc_id % 5 WHEN 1 THEN 'ReleasedLast edited on' WHEN 2 THEN 'then' WHEN 3 THEN 'Released' ELSE '' END"
_BODY = f"""CASE WHEN doc_id % 4 = 3 THEN {S.clean_text("('Doc ' || doc_id || chr(10) || name || chr(10) || chr(10) || " + _MODIFIED_TEXT + " || chr(10) || line || chr(10) || text || chr(10) || 'no rel')")}
       ELSE {S.clean_text('text')} END"""


@query("page_body", f"SELECT doc_id AS page_id, length({_BODY}) AS body_chars, {_BODY} AS body FROM ({_FIELDS}) f")
def q_page_body(spark, sf):
    return X.page_body(P.article_pages(spark, sf)).select("page_id", F.length("body").cast("long").alias("body_chars"), "body")


@query("page_heading", f"""SELECT doc_id AS page_id, {S.clean_text('name')} AS title,
       CASE WHEN doc_id % 5 IN (1, 2, 3) THEN CASE WHEN doc_id % 5 = 2 THEN later WHEN doc_id % 5 = 1 THEN iso ELSE later END ELSE '' END AS page_date
FROM ({_FIELDS}) f""")
def q_page_heading(spark, sf):
    return X.page_heading(P.article_pages(spark, sf)).select("page_id", "title", "page_date")


def _likely(x: str) -> str:
    low = f"lower({S.pystrip(x)})"
    return (f"(length({S.pystrip(x)}) >= 50 AND NOT {S.contains_any(low, H.ABSTRACT_BOILERPLATE)} AND {S.word_count(x)} >= 10 "
            f"AND {S.contains_any(low, H.RESEARCH_INDICATORS)})")


@query("page_abstract", f"""SELECT doc_id AS page_id, {_URL} AS url, CASE WHEN doc_id % 2 = 1 AND {_likely('a')} THEN a ELSE '' END AS abstract
FROM (SELECT doc_id, {S.clean_text('line')} AS a FROM ({_FIELDS}) f) g""")
def q_page_abstract(spark, sf):
    return X.page_abstract(P.article_pages(spark, sf))


_PREFIX = "'(?i)^[" + S.WS_INNER + "]*summary[" + S.WS_INNER + "]*[:-]?[" + S.WS_INNER + "]*'"
_LEAST = {"meta": (20, 20, 0), "block": (30, 30, 0), "para": (40, 30, 0), "div": (100, 50, 15)}


def _least(at: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[at]}" for k, v in _LEAST.items()) + " END"


@query("page_summary", f"""WITH f AS ({_FIELDS}),
c AS (SELECT doc_id, 0 AS ord, 'meta' AS kind, name AS txt FROM f WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 1, 'block', line FROM f WHERE doc_id % 2 = 1
      UNION ALL SELECT doc_id, 1 + i, 'para', string_split(text, chr(10))[i] FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM f) p
      UNION ALL SELECT doc_id, 1000000000, 'div', text || CASE WHEN doc_id % 4 = 0 THEN 'buy now' ELSE '' END FROM f WHERE doc_id % 4 <> 2),
t AS (SELECT doc_id, ord, kind, trim(regexp_replace({S.clean_text('txt')}, {_PREFIX}, '')) AS txt FROM c),
s AS (SELECT *, {S.strip_contact_info('txt', Q)} AS st FROM t WHERE length(txt) > {_least(0)} AND ({_least(2)} = 0 OR {S.word_count('txt')} > {_least(2)})
      AND NOT (kind = 'para' AND regexp_matches(lower(txt), 'copyright|terms of use|privacy policy'))),
g AS (SELECT doc_id, ord, {S.first_sentences('st')} AS two FROM s WHERE st <> '' AND length(st) > {_least(1)} AND NOT {S.is_uninformative('st', 'summary', Q)})
SELECT f.doc_id AS page_id, {_URL.replace('doc_id', 'f.doc_id')} AS url, coalesce(m.summary, '') AS summary
FROM f LEFT JOIN (SELECT doc_id, arg_min(two, ord) AS summary FROM g WHERE two <> '' GROUP BY doc_id) m ON m.doc_id = f.doc_id""")
def q_page_summary(spark, sf):
    return X.page_summary(P.article_pages(spark, sf))


_PAGE_TEXT = ("('Doc ' || doc_id || ' menu ' || name || ' ' || CASE WHEN doc_id % 4 = 2 THEN long_date ELSE '' END || ' ' || "
              "CASE doc_id % 5 WHEN 1 THEN 'Released Last edited on' WHEN 2 THEN 'then' WHEN 3 THEN 'Released' ELSE '' END || ' ' || "
              "CASE WHEN doc_id % 2 = 1 THEN line ELSE '' END || ' ' || text || CASE doc_id % 4 WHEN 0 THEN ' buy now next' WHEN 1 THEN ' more' "
              "WHEN 2 THEN ' links next' ELSE ' no rel' END || ' foot')")


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"strpos({x}, {S.q(w)}) > 0" for w in words) + ")"


@query("is_error_page", f"""SELECT doc_id AS page_id, (({_any('low', H.ERROR_CRITICAL)} OR {' + '.join(f"(strpos(low, {S.q(w)}) > 0)::INT" for w in H.ERROR_SOFT)} >= 3)
         AND NOT {_any('low', H.JS_DISABLED)}) OR length(body) < 100
       OR (NOT regexp_matches(body, '(?i){'|'.join(H.JS_DISABLED)}') AND regexp_matches(body, '(?is)error.*occurred|{'|'.join(H.BODY_ERRORS)}')) AS error_page
FROM (SELECT doc_id, lower({_PAGE_TEXT}) AS low, {_BODY} AS body FROM ({_FIELDS}) f) g""")
def q_is_error_page(spark, sf):
    pages = P.article_pages(spark, sf)
    both = X.page_body(pages, keep=["html"]).select("page_id", "body", H.page_text("html").alias("text"))
    return both.select("page_id", H.is_error_page(F.col("text"), F.col("body")).alias("error_page"))


def _style(ts: str, style) -> str:
    return f"coalesce({style(ts)}, '')"


_PUB_TS = f"CASE WHEN doc_id % 4 = 3 THEN TIMESTAMP '2025-05-01' ELSE {S.parse_date(_PUBLISHED, 'news')} END"
_MOD_TS = S.parse_date(_MODIFIED, "news")


@query("enrich_news_dates", f"""SELECT doc_id AS seq, {_style(_PUB_TS, S.fmt_display)} AS publish_date, {_style(_PUB_TS, S.fmt_raw)} AS publish_date_raw,
       {_style(_MOD_TS, S.fmt_display)} AS last_edited_date, {_style(_MOD_TS, S.fmt_raw)} AS last_edited_date_raw FROM ({_FIELDS}) f""")
def q_enrich_news_dates(spark, sf):
    out = enrich_news_dates(P.linked_items(spark, sf), X.article_dates(P.article_pages(spark, sf)))
    return out.select("seq", "publish_date", "publish_date_raw", "last_edited_date", "last_edited_date_raw")


@query("enrich_summary", f"""SELECT doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN 'own summary' WHEN doc_id % 3 = 0 THEN {S.clean_text('name')} ELSE '' END AS summary
FROM ({_FIELDS}) f""")
def q_enrich_summary(spark, sf):
    items = P.linked_items(spark, sf).withColumn("summary", F.when(F.col("seq") % 5 == 0, "own summary").otherwise(""))
    return enrich_summary(items, P.article_pages(spark, sf)).select("seq", "summary")


@query("page_metadata", f"""SELECT page_id, {S.tag_text('html', 'title')} AS title, {S.tag_text('html', 'h1')} AS h1,
       coalesce(nullif(regexp_extract(html, '(?is)<html[^>]*\\slang\\s*=\\s*["'']([^"'']+)["'']', 1), ''), 'en') AS lang,
       '' AS meta_description, '' AS og_description FROM pages
UNION ALL SELECT -1 - doc_id, 'Doc ' || doc_id, {S.clean_text('name')}, 'en', CASE WHEN doc_id % 3 = 0 THEN {S.clean_text('name')} ELSE '' END, ''
FROM ({_FIELDS}) f""")
def q_page_metadata(spark, sf):
    p = read_pages(spark, sf).unionByName(P.article_pages(spark, sf).withColumn("page_id", -1 - F.col("page_id")))
    return p.select("page_id", tag_text("html", "title").alias("title"), tag_text("html", "h1").alias("h1"),
                    page_language("html").alias("lang"), meta_content("html", "name", "description").alias("meta_description"),
                    meta_content("html", "property", "og:description").alias("og_description"))


# ---------------------------------------------------------------------------
# Links and phrases: every rule is reached by some document
# ---------------------------------------------------------------------------

LINKS = ("https://www.nist.gov/publications/a/{id}", "https://www.nist.gov/news-events/news/{id}", "https://csrc.nist.gov/pubs/{id}",
         "https://csrc.nist.gov/presentations/{id}/x", "https://www.nist.gov/", "https://CSRC.nist.gov", "https://other.example.org/a/b/{id}",
         "http://other.example.org/{id}/", "/pubs/{id}", "", "https://www.nist.gov/publications/search?k={id}", "https://x.example.org/search",
         "https://x.example.org/searching/{id}", "[](https://www.nist.gov/publications/{id})<https://www.nist.gov/publications/{id}>")
TYPES = ("publication", "news", "presentation", "ai_news", "pqc_publication")

PHRASES = ("Comments Due: March {day}, 2026 for all.", "Please provide comments by April {day}, 2026.",
           "The comment period will close as announced on May {day}, 2026.", "It will close, as we said, on June {day}, 2026.",
           "Comments Due: Smarch {day}, 2026.", "See https://a.example.org/x?y={id} and www.b.example.org/{id} for more.",
           "Contact us at person{id}@mail.example.org for questions. Call now.", "Nothing of the kind.",
           "Visit http://c.example.org/{id}. For more information contact the author.")


def _template(markups, fields, key):
    chosen = F.lit(None).cast("string")
    for turn, markup in enumerate(markups):
        chosen = F.when(key % len(markups) == turn, P._fill(markup, fields)).otherwise(chosen)
    return chosen


def _template_sql(markups, fields, key: str) -> str:
    cases = []
    for turn, markup in enumerate(markups):
        text = S.q(markup)
        for name, sql in fields.items():
            text = text.replace("{" + name + "}", f"' || {sql} || '")
        cases.append(f"WHEN {turn} THEN {text}")
    return f"CASE {key} % {len(markups)} {' '.join(cases)} END"


_LINK_SQL = _template_sql(LINKS, {"id": "doc_id"}, "doc_id")
_PHRASE_SQL = _template_sql(PHRASES, {"id": "doc_id", "day": "(doc_id % 28 + 1)"}, "doc_id")
_PHRASED = f"SELECT doc_id, {_PHRASE_SQL} || ' ' || text AS text FROM documents"
_TYPE_SQL = "(['" + "', '".join(TYPES) + f"'])[(doc_id // 14) % {len(TYPES)} + 1]"


# made links of documents, and the links of the given pages (numbered below zero)
_LINKED = f"""SELECT doc_id, {_LINK_SQL} AS link, {_TYPE_SQL} AS type FROM documents
UNION ALL SELECT -1 - page_id, url, ({list(TYPES)})[page_id % {len(TYPES)} + 1] FROM pages"""


def _links(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id"])
    p = read_table(spark, sf, "pages", ["page_id", "url"])

    def type_of(n):
        return F.element_at(F.array(*map(F.lit, TYPES)), (n % len(TYPES) + 1).cast("int")).alias("type")

    made = d.select("doc_id", _template(LINKS, {"id": F.col("doc_id").cast("string")}, F.col("doc_id")).alias("link"), type_of(F.floor(F.col("doc_id") / 14)))
    return made.unionByName(p.select((-1 - F.col("page_id")).alias("doc_id"), F.col("url").alias("link"), type_of(F.col("page_id"))))


def _phrased(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    fields = {"id": F.col("doc_id").cast("string"), "day": (F.col("doc_id") % 28 + 1).cast("string")}
    return d.select("doc_id", F.concat(_template(PHRASES, fields, F.col("doc_id")), F.lit(" "), F.col("text")).alias("text"))


@query("link_score", f"SELECT doc_id, {S.link_score('link')} AS score FROM ({_LINKED}) d")
def q_link_score(spark, sf):
    return _links(spark, sf).select("doc_id", L.link_score("link").alias("score"))


@query("link_score_typed", f"""SELECT doc_id, {_sql_typed_score('link', 'type')} AS score
FROM (SELECT doc_id, {S.sanitize_link('raw')} AS link, type FROM (SELECT doc_id, link AS raw, type FROM ({_LINKED}) l) r) d""")
def q_link_score_typed(spark, sf):
    return _links(spark, sf).select("doc_id", L.link_score_typed(F.col("link"), F.col("type")).alias("score"))


@query("is_search_index_url", f"""SELECT doc_id, regexp_matches(link, '(?i)(/publications/search|/search([^A-Za-z0-9_]|$))') AS search_index
FROM ({_LINKED}) d""")
def q_is_search_index_url(spark, sf):
    return _links(spark, sf).select("doc_id", L.is_search_index_url("link").alias("search_index"))


@query("extract_due_date", f"""SELECT doc_id, coalesce({S.fmt_display(_sql_due('text'))}, '') AS comment_due_date,
       coalesce({S.fmt_raw(_sql_due('text'))}, '') AS comment_due_date_raw FROM ({_PHRASED}) d""")
def q_extract_due_date(spark, sf):
    d = _phrased(spark, sf).withColumn("_d", D.extract_due_date("text"))
    return d.select("doc_id", "_d.comment_due_date", "_d.comment_due_date_raw")


_STRIPPED_URLS = S.collapse("regexp_replace(regexp_replace(text, " + S.q('(?i)https?://[^' + S.WS_INNER + ']+') + ", '', 'g'), "
                            + S.q('(?i)www' + chr(92) + '.[^' + S.WS_INNER + ']+') + ", '', 'g')")


# the broad patterns as the SQL has them (white space written out)
_BROAD = tuple(p.replace("[^\\s]", "[^" + S.WS_INNER + "]") for p in Q.URL_BROAD_RES)
_BROAD_FOUND = "list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, {S.q(p)})" for p in _BROAD) + ")))"
_BROAD_CUT = "text"
for _p in _BROAD:
    _BROAD_CUT = f"regexp_replace({_BROAD_CUT}, {S.q(_p)}, '', 'g')"


@query("extract_urls", f"""SELECT doc_id, len(regexp_extract_all(text, {S.q(S.URL_NARROW)})) AS n_urls, {_STRIPPED_URLS} AS stripped,
       array_to_string({_BROAD_FOUND}, ' ') AS broad, {S.collapse(_BROAD_CUT)} AS stripped_broad FROM ({_PHRASED}) d""")
def q_extract_urls(spark, sf):
    d = _phrased(spark, sf)
    return d.select("doc_id", F.size(Q.extract_urls("text")).cast("long").alias("n_urls"), Q.strip_urls("text").alias("stripped"),
                    F.array_join(F.sort_array(Q.extract_urls("text", "broad")), " ").alias("broad"), Q.strip_urls("text", "broad").alias("stripped_broad"))


@query("strip_contact_info", f"SELECT doc_id, {S.strip_contact_info('text', Q)} AS stripped FROM ({_PHRASED}) d")
def q_strip_contact_info(spark, sf):
    return _phrased(spark, sf).select("doc_id", Q.strip_contact_info("text").alias("stripped"))


SENTENCES = ("This publication describes method {id} for secure key exchange between devices. It gives results and limits. More follows.",
             "The authors present a framework for testing cryptographic modules in {id} laboratories. It scales well.",
             "and so it goes on in part {id} of the report about random numbers and their use in protocols.",
             "We propose a scheme for signing firmware number {id}. Our tests show that it is fast.", "Summary {id}", "")
_SENTENCE_SQL = _template_sql(SENTENCES, {"id": "doc_id"}, "doc_id")


@query("clean_summary", f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR {S.is_uninformative('text', 'summary', Q)} THEN ''
       WHEN {S.is_uninformative('two', 'summary', Q)} OR {S.mid_phrase_start('two', Q.MID_PHRASE_WORDS)} THEN ''
       ELSE two END AS summary
FROM (SELECT doc_id, text, {S.first_sentences(S.third_person('text', Q, 'summary'))} AS two FROM (SELECT doc_id, text FROM documents
      UNION ALL SELECT -1 - doc_id, {_SENTENCE_SQL} FROM documents) u) d""")
def q_clean_summary(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    made = _template(SENTENCES, {"id": F.col("doc_id").cast("string")}, F.col("doc_id"))
    return d.unionByName(d.select((-1 - F.col("doc_id")).alias("doc_id"), made.alias("text"))).select("doc_id", Q.clean_summary("text").alias("summary"))


_DATES = ("CASE doc_id % 3 WHEN 0 THEN 'May 01, 2025' WHEN 1 THEN ' ' ELSE '' END", "CASE doc_id % 2 WHEN 0 THEN '2025-05-01' ELSE '' END",
          "CASE doc_id % 5 WHEN 0 THEN 'May 01, 2025' WHEN 1 THEN 'June 02, 2025' ELSE '' END", "CASE doc_id % 7 WHEN 0 THEN '2025-05-01' ELSE '' END")


# made dates of documents, and the dates of the given orders (numbered below zero; edited on the day for every third customer)
_ORDER_DATES = ("strftime(o_orderdate, '%B %d, %Y')", "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate + to_days(CAST(o_custkey % 3 AS INTEGER)), '%B %d, %Y')",
                "strftime(o_orderdate + to_days(CAST(o_custkey % 3 AS INTEGER)), '%Y-%m-%d')")


@query("news_date_flags", f"""SELECT doc_id, (trim(le) <> '' OR trim(le_raw) <> '') AND NOT ((trim(le_raw) <> '' AND trim(le_raw) = trim(pub_raw))
       OR (trim(le) <> '' AND trim(le) = trim(pub))) AS show_last_edited, trim(pub) <> '' AS show_published
FROM (SELECT doc_id, {_DATES[0]} AS pub, {_DATES[1]} AS pub_raw, {_DATES[2]} AS le, {_DATES[3]} AS le_raw FROM documents
      UNION ALL SELECT -1 - o_orderkey, {', '.join(_ORDER_DATES)} FROM orders) d""")
def q_news_date_flags(spark, sf):
    names = ("publish_date", "publish_date_raw", "last_edited_date", "last_edited_date_raw")
    made = read_table(spark, sf, "documents", ["doc_id"]).select("doc_id", *(F.expr(e).alias(c) for e, c in zip(_DATES, names)))
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    edited = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 3).cast("int"))
    given = o.select((-1 - F.col("o_orderkey")).alias("doc_id"), *(F.date_format(d, f).alias(c) for d, f, c in zip(
        (F.col("o_orderdate"), F.col("o_orderdate"), edited, edited), ("MMMM dd, yyyy", "yyyy-MM-dd") * 2, names)))
    return D.news_date_flags(made.unionByName(given)).select("doc_id", "show_last_edited", "show_published")


@query("enrich_due_dates", f"""SELECT doc_id AS seq, coalesce({S.fmt_display('due')}, '') AS comment_due_date, coalesce({S.fmt_raw('due')}, '') AS comment_due_date_raw
FROM (SELECT doc_id, {_sql_due('text')} AS due FROM ({_PHRASED}) p) d""")
def q_enrich_due_dates(spark, sf):
    link = F.concat(F.lit(f"{P.SITE}/draft/"), F.col("doc_id").cast("string"))
    pages = _phrased(spark, sf).select(F.col("doc_id").alias("page_id"), link.alias("url"),
                                       F.concat(F.lit("<html><body><p>"), P.escape(F.col("text")), F.lit("</p></body></html>")).alias("html"))
    items = read_table(spark, sf, "documents", ["doc_id"]).select(
        F.col("doc_id").alias("seq"), link.alias("link"), F.lit("").alias("comment_due_date"), F.lit("").alias("comment_due_date_raw"))
    return enrich_due_dates(tag_source(items, "qis", "Drafts"), pages).select("seq", "comment_due_date", "comment_due_date_raw")
