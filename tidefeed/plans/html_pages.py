"""Adapters: listing, article and paging pages rendered from ``documents`` as native strings.

The extraction queries read these pages, so their oracles need no HTML parser:
they select the same fields from ``documents``.  Every document is one block of a
listing page (twenty documents a page) and one article page; the markup varies by
page or document so that each selector of a cascade is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .adapters import items_docs

PER_PAGE = 20
SITE = "https://feed.example.gov"

# Markup of one block: placeholders {id} {title} {href} {series} {date} {iso} {summary} {status}.
# A block without a title keeps everything but its title link.
_ROW = ('<tr id="result-{id}"><td>{title}</td><td id="pub-series-{id}">{series}</td>'
        '<td id="pub-release-date-{id}">{date}</td><td><p id="content-area-{id}">{summary}</p></td></tr>')
_CARD = ('<div class="search-list-item"><h4 class="search-results-title">{title}</h4>'
         '<div class="sub-title"><strong>{series}</strong></div><strong id="date-container-{id}">{date}</strong>'
         '<p class="summary">{summary}</p><em class="status">{status}</em></div>')
_ARTICLE = ('<article><h3>{title}</h3><span class="series">{series}</span><time datetime="{iso}">{date}</time>'
            '<div class="summary">{summary}</div><i class="doc-status">{status}</i></article>')
_ITEM = ('<div class="publication-item">{title}<span class="doc-series">{series}</span><span class="date">{date}</span>'
         '<div class="description">{summary}</div></div>')
_SEARCH = ('<div class="search-list-item">{title}<strong id="date-container-{id}">{date}</strong>'
           '<p>{summary}</p></div>')
_RESULT = '<div class="search-result"><h3>{title}</h3><span class="date">{date}</span><p class="summary">{summary}</p></div>'
_NEWS_ARTICLE = '<article><h4>{title}</h4><time>{date}</time><div class="description">{summary}</div></article>'
_NEWS_ITEM = '<div class="news-item">{title}<b class="post-date">{date}</b><p>{summary}</p></div>'
_QIS_NEWS = '<article><h3>{name}</h3>{title}<time datetime="{iso}">{date}</time></article>'
_PROJECT = '<div class="search-list-item"><h3>{title}</h3><p class="summary">{summary}</p></div>'
_PROJECT_ITEM = '<div class="project-item">{title}<p>{summary}</p></div>'

_LINK = '<a href="{href}">{name}</a>'
#: Per source: title link, and the block markups its pages take in turn.
MARKUP = {
    "pqc_publications": (_LINK, (_ROW, _CARD, _ARTICLE, _ITEM)),
    "qis_publications": (_LINK, (_CARD, _ARTICLE, _ITEM)),
    "ai_publications": (_LINK, (_ROW.replace("<td>{title}</td>", "<td><h3>{title}</h3></td>"), _CARD, _ARTICLE, _ITEM)),
    "pqc_presentations": ('<a id="title-link-{id}" href="{href}">{name}</a>', (_SEARCH,)),
    "qis_presentations": ('<a id="title-link-{id}" href="{href}">{name}</a>', (_SEARCH,)),
    "ai_presentations": (_LINK, (_CARD, _ARTICLE)),
    "pqc_news": (_LINK, (_RESULT, _NEWS_ARTICLE, _NEWS_ITEM)),
    "ai_news": ('<a data-title="1" href="{href}">{name}</a>', (_RESULT, _NEWS_ARTICLE, _NEWS_ITEM)),
    "qis_news": ('<a href="{href}">more</a>', (_QIS_NEWS,)),
    "ai_projects": (_LINK, (_PROJECT, _PROJECT_ITEM)),
}
#: Documents whose number this divides have no title; links by remainder of three.
UNTITLED = 11


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _fill(markup: str, fields: dict[str, Column]) -> Column:
    """Markup with its placeholders replaced by columns."""
    parts, at = [], 0
    while (start := markup.find("{", at)) >= 0:
        end = markup.index("}", start)
        parts += [F.lit(markup[at:start]), fields[markup[start + 1:end]]]
        at = end + 1
    return F.concat(*parts, F.lit(markup[at:]))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block fields of every document: dates in the sources' styles, links absolute and relative."""
    n = F.col("seq")
    return items_docs(spark, sf_dir).select(
        n.alias("doc_id"), "document_name", F.col("summary").alias("text"), F.col("release_date").alias("date"),
        F.date_format(F.date_add(F.lit("2022-07-01").cast("date"), ((n * 37) % 700).cast("int")), "yyyy-MM-dd").alias("iso"),
        F.when(n % 3 == 0, F.concat(F.lit("/pubs/"), n)).when(n % 3 == 1, F.concat(F.lit("https://www.nist.gov/publications/a/"), n))
        .otherwise(F.concat(F.lit("pubs/"), n)).alias("href"),
        F.concat(F.lit("SP "), (n % 7).cast("string")).alias("series"),
        F.concat(F.when(n % 2 == 0, F.lit("Abstract: ")).otherwise(F.lit("")),
                 F.col("summary")).alias("abstract"),
        F.when(n % 2 == 0, F.lit("Final")).otherwise(F.lit("Draft")).alias("status"))


def listing_pages(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """``page_id, url, html`` of a source's listing: the blocks of twenty documents a page."""
    link, markups = MARKUP[source]
    d = _fields(spark, sf_dir).withColumn("page_id", F.floor(F.col("doc_id") / PER_PAGE))
    fields = {"id": F.col("doc_id").cast("string"), "name": F.when(F.col("doc_id") % UNTITLED == 0, F.lit("")).otherwise(escape(F.col("document_name"))), "href": F.col("href"),
              "series": F.col("series"), "date": escape(F.col("date")), "iso": F.concat("iso", F.lit("T09:30:00Z")),
              "summary": escape(F.col("abstract")), "status": F.col("status")}
    titled = F.when(F.col("doc_id") % UNTITLED == 0, F.lit("")).otherwise(_fill(link, fields))
    block = F.lit("")
    for turn, markup in enumerate(markups):
        filled = _fill(markup, fields | {"title": titled})
        block = F.when(F.col("page_id") % len(markups) == turn, filled).otherwise(block)
    pages = d.select("page_id", "doc_id", block.alias("block")).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "block"))).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")
    rows = F.concat(F.lit("<html><body><nav><b>menu</b></nav><table>"), body, F.lit("</table></body></html>"))
    return pages.select("page_id", F.concat(F.lit(f"{SITE}/{source}?page="), F.col("page_id").cast("string")).alias("url"),
                        rows.alias("html"))


#: Article markup by document number: place of the published date, of the modified date, and of the text.
PUBLISHED_MARKUP = ('<meta property="article:published_time" content="{iso}T10:00:00Z">',
                    '<meta name="publish_date" content="{long}">', '<span itemprop="datePublished">{long}</span>',
                    '<meta name="date" content=" "><meta name="other" content="{iso}">')
MODIFIED_MARKUP = ('<meta property="og:updated_time" content="{later}">',
                   '<time datetime="{iso}">Released</time><time datetime="{later}">Last edited on</time>',
                   '<i itemprop="dateModified" datetime="{later}">then</i>', '<time datetime="{later}">Released</time>',
                   '<meta name="last_modified" content="{later}">')
REGIONS = ('<div class="content">{text}<div class="ad">buy now</div></div>', '<div class="field-body">{text}</div>',
           '<main><div class="sidebar">links</div>{text}</main>', '<div class="plain">{text}</div>')
NEXT_MARKUP = ('<a rel="next" href="/doc/{next}">next</a>', '<ul><li class="next"><a href="{next}">more</a></li></ul>',
               '<a class="pagination-next" href="https://other.example.org/{next}">next</a>', '<a href="/doc/{next}">no rel</a>')


def _turn(markups: tuple[str, ...], fields: dict[str, Column]) -> Column:
    chosen = F.lit("")
    for turn, markup in enumerate(markups):
        chosen = F.when(F.col("doc_id") % len(markups) == turn, _fill(markup, fields)).otherwise(chosen)
    return chosen


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html`` of one article per document.

    The head has the title and, for every third document, a description (the first
    line); the body a heading, dates, an abstract block for odd documents, the lines
    as paragraphs in a region that varies, and a next link.
    """
    n = F.col("doc_id")
    d = _fields(spark, sf_dir)
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), escape(x), F.lit("</p>"))), "\n")
    fields = {"iso": F.col("iso"), "long": F.date_format(F.col("iso").cast("date"), "MMMM dd, yyyy"),
              "later": F.date_format(F.date_add(F.col("iso").cast("date"), 9), "yyyy-MM-dd"), "text": lines,
              "next": (n + 1).cast("string")}
    described = F.when(n % 3 == 0, F.concat(F.lit('<meta name="description" content="'), F.replace(escape(F.col("document_name")), F.lit('"'), F.lit("&quot;")),
                                            F.lit('">'))).otherwise(F.lit(""))
    abstract = F.when(n % 2 == 1, F.concat(F.lit('<section class="abstract">'), escape(F.col("abstract")), F.lit("</section>"))).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><head><title>Doc "), n.cast("string"), F.lit("</title>"), described, F.lit("</head><body><nav>menu</nav>\n<h1>"),
        escape(F.col("document_name")), F.lit("</h1>\n"), _turn(PUBLISHED_MARKUP, fields), F.lit("\n"), _turn(MODIFIED_MARKUP, fields),
        F.lit("\n"), abstract, F.lit("\n"), _turn(REGIONS, fields), F.lit("\n<div class=\"pager\">"), _turn(NEXT_MARKUP, fields),
        F.lit("</div><footer>foot</footer></body></html>"))
    return d.select(n.alias("page_id"), F.concat(F.lit(f"{SITE}/doc/"), n.cast("string")).alias("url"), html.alias("html"))


def linked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items that link to the articles; every fourth has its own publish date."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    own = F.when(F.col("doc_id") % 4 == 3, F.lit("2025-05-01")).otherwise(F.lit(""))
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit(f"{SITE}/doc/"), F.col("doc_id").cast("string")).alias("link"),
                    F.lit("").alias("publish_date"), own.alias("publish_date_raw"), F.lit("").alias("last_edited_date"),
                    F.lit("").alias("last_edited_date_raw"))
