"""Page extraction: selector rules, read by one ``mapInArrow`` pass over ``pages``.

What to take from a page is data: a :class:`Rule` names a selector, where the
value stands, and what a usable value must have.  Three generic readers (first
value, all values, last resort) apply the rules; each operator is a rule table
plus native gates on the texts that come back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.dates import format_date, parse_date
from ..functions.html import is_likely_abstract
from ..functions.links import absolutize_link, is_search_index_url
from ..functions.quality import first_sentences, is_uninformative, strip_contact_info, word_count
from ..functions.text import ZERO_WIDTH, blank, clean_text, let
from ..session import ship_package
from .common import bind
from .page_tree import NO_TEXT, Node, parse, select


@dataclass(frozen=True)
class Rule:
    """Values of the elements a selector finds.

    ``sources`` are tried in order: ``text`` (strings joined), ``words`` (strings
    joined by spaces), or an attribute name.  ``every`` takes all elements instead
    of the first; ``labels`` keeps elements whose text has one of the words;
    ``kind`` tags the value for the gate that judges it.
    """

    selector: str
    sources: tuple[str, ...] = ("text",)
    every: bool = False
    labels: tuple[str, ...] = ()
    kind: str = ""


def _rules(*selectors: str, **options) -> tuple[Rule, ...]:
    return tuple(Rule(s, **options) for s in selectors)


# ---------------------------------------------------------------------------
# Selectors, in the order they are tried
# ---------------------------------------------------------------------------

BODY = (".content", ".body", ".article-body", ".field-body", ".main-content", ".content-area", "article", "main")
BODY_DROP = ".navigation, .sidebar, .ad, .footer, .related"
PAGE_DROP = "nav, header, footer, aside, .navigation, .sidebar, .ad, .related"
BODY_ENOUGH = 100

TITLE = ("h1.title", "h1", "h1.document-title", ".title", ".document-title", "title")
PAGE_DATE = _rules(".publication-date", ".date", ".published", ".field-date", "time", "[datetime]",
                   sources=("datetime", "text"))
ABSTRACT = _rules(".field-name-field-document-abstract", ".field-document-abstract", ".document-abstract",
                  ".field-name-field-abstract", ".field-abstract", ".abstract", ".summary", ".description")

_META = ("content", "datetime", "words")
PUBLISHED = _rules('meta[property="article:published_time"]', 'meta[property="article:published"]',
                   'meta[name="publish_date"]', 'meta[name="date"]', '[itemprop="datePublished"]', sources=_META)
MODIFIED = _rules('meta[property="article:modified_time"]', 'meta[property="og:updated_time"]',
                  'meta[name="last-updated"]', 'meta[name="last_modified"]', '[itemprop="dateModified"]',
                  sources=_META) + (
    Rule("time[datetime]", ("datetime",), every=True, labels=("updated", "edited", "modified", "last")),)
NEXT = _rules('a[rel="next"]', "a.pagination-next", "li.next a", ".pager-next a", sources=("href",))

SUMMARY_META = _rules('meta[name="description"]', 'meta[name="dcterms.description"]',
                      'meta[property="og:description"]', 'meta[property="dcterms.description"]',
                      sources=("content",), kind="meta")
SUMMARY_BLOCKS = _rules('[class*="abstract"]', '[id*="abstract"]', '[class*="summary"]', '[id*="summary"]',
                        "div.abstract", "div.summary", "section.abstract", "section.summary", every=True, kind="block")
SUMMARY_REGION = ("main", '[role="main"]', "article")
SUMMARY_PARAGRAPHS = _rules("p", every=True, kind="para")
LEGAL_WORDS = ("copyright", "terms of use", "privacy policy")
# kind -> (least characters before and after contact details are stripped, least words)
SUMMARY_LEAST = {"meta": (20, 20, 0), "block": (30, 30, 0), "para": (40, 30, 0), "div": (100, 50, 15)}

_TITLE = ("h4.search-results-title a", "h3 a", "a[data-title]", "a")
_SERIES = (".sub-title strong", ".series", "[class*='series']")
_DATE = ("strong[id^='date-container-']", "time", ".date", "[class*='date']")
_RESULTS = (".search-list-item", "article", ".publication-item", "[data-publication]")
_NEWS = {"items": (".search-result", "article", ".news-item", "[data-news]"),
         "title": ("h3 a", "h4 a", "a[data-title]", "a"), "date": (".date", "time", "[class*='date']"),
         "summary": (".summary", ".description", "p")}
_SEARCH_PRESENTATIONS = {"items": (".search-list-item",), "title": ("a[id^='title-link-']",),
                         "date": ("strong[id^='date-container-']",)}

#: Per source: block selectors, per field the selectors tried in a block, and a heading dropped from summaries.
LISTING_PROFILES = {
    "pqc_publications": {"items": ("tr[id^='result-']", *_RESULTS), "title": ("td a", *_TITLE),
                         "series": ("td[id*='pub-series']", *_SERIES), "date": ("td[id*='pub-release-date']", *_DATE),
                         "summary": ("p[id^='content-area-']", ".summary", ".description", "p"), "drop": "abstract:"},
    "qis_publications": {"items": _RESULTS, "title": _TITLE, "series": _SERIES, "date": _DATE,
                         "summary": ("p[id^='content-area-']", ".summary", ".description", "p"), "drop": "abstract:"},
    "ai_publications": {"items": ("tr[id^='result-']", *_RESULTS), "title": _TITLE,
                        "series": ("td[id*='pub-series']", *_SERIES), "date": ("td[id*='pub-release-date']", *_DATE),
                        "summary": (".summary", ".description", "p")},
    "pqc_presentations": _SEARCH_PRESENTATIONS,
    "qis_presentations": _SEARCH_PRESENTATIONS,
    "ai_presentations": {"items": (".search-list-item", "article", ".presentation-item", "[data-presentation]"),
                         "title": _TITLE, "series": _SERIES, "date": _DATE, "status": (".status", "[class*='status']")},
    "pqc_news": _NEWS,
    "ai_news": _NEWS,
    "qis_news": {"items": ("article",), "title": ("h3",), "link": ("a[href]",), "date": ("time@datetime",)},
    "ai_projects": {"items": (".search-list-item", "article", ".project-item"), "title": ("h3 a", "a"),
                    "summary": (".summary", "p")},
}
LISTING_FIELDS = ("title", "link", "series", "date", "summary", "status")

_CSRC, _NIST = "https://csrc.nist.gov", "https://www.nist.gov"
#: Per source: section, constants of its rows, site of relative links, and how dates are shown.
#: ``show``: the parsed date in one style, or as ``listed``; ``raw``: ``parsed``, or the listed text if it does not parse.
LISTING_ROWS = {
    "pqc_publications": ("publications", {"resource_type": "Post-Quantum Cryptography Publication"}, _CSRC, "listed", "parsed"),
    "qis_publications": ("publications", {"resource_type": "Publication"}, _CSRC, "listed", "or listed"),
    "ai_publications": ("publications", {"resource_type": "Artificial Intelligence Publication"}, _CSRC, "style", "parsed"),
    "pqc_presentations": ("presentations", {"resource_type": "Post-Quantum Cryptography Presentation",
                                            "series": "Presentation", "status": "Available"}, _CSRC, "listed", "none"),
    "qis_presentations": ("presentations", {"resource_type": "Quantum Information Science Presentation",
                                            "series": "Presentation", "status": "Available"}, _CSRC, "listed", "none"),
    "ai_presentations": ("presentations", {"resource_type": "Artificial Intelligence Presentation"}, _CSRC, "style", "none"),
    "pqc_news": ("news", {"resource_type": "Post-Quantum Cryptography News"}, _NIST, "listed", "or listed"),
    "ai_news": ("news", {"resource_type": "Artificial Intelligence News"}, _NIST, "style", "parsed"),
    "qis_news": ("news", {}, _NIST, "only style", "or listed"),
    "ai_projects": ("projects", {"resource_type": "Artificial Intelligence Project"}, _CSRC, "none", "none"),
}


# ---------------------------------------------------------------------------
# Generic readers
# ---------------------------------------------------------------------------

def _squash(text: str) -> str:
    """Collapse white space and drop zero-width characters."""
    text = " ".join(text.split())
    if not text.isascii():
        for unseen in ZERO_WIDTH:
            text = text.replace(unseen, "")
    return text


def _value(node: Node, sources: Sequence[str], skip: frozenset[int] = frozenset()) -> str:
    for source in sources:
        value = ("".join(node.strings(skip)) if source == "text" else
                 " ".join(" ".join(node.strings(skip)).split()) if source == "words" else node.get(source))
        if value.strip():
            return value
    return ""


def _values(root: Node, rules: Sequence[Rule]) -> Iterator[tuple[Rule, str]]:
    """Non-empty values, rule by rule."""
    for rule in rules:
        for node in select(root, rule.selector):
            if not rule.labels or any(w in _squash(" ".join(node.strings())).lower() for w in rule.labels):
                value = _value(node, rule.sources)
                if value:
                    yield rule, value
            if not rule.every:
                break


def _first_value(root: Node, rules: Sequence[Rule]) -> str:
    return next((value.strip() for _, value in _values(root, rules)), "")


def _first_node(root: Node, selectors: Sequence[str]) -> Node | None:
    return next((node for s in selectors for node in select(root, s)), None)


# ---------------------------------------------------------------------------
# Parts of a page
# ---------------------------------------------------------------------------

def _body(root: Node, url: str) -> str:
    """Text of the first long enough region; else of the last region; else of the whole page."""
    skip: set[int] = set()
    text = ""
    for selector in BODY:
        region = next(select(root, selector), None)
        if region is not None:
            skip.update(map(id, select(region, BODY_DROP)))
            text = _squash("".join(region.strings(frozenset(skip))))
            if len(text) > BODY_ENOUGH:
                return text
    return text or _squash("".join(root.strings(frozenset(skip.union(map(id, select(root, PAGE_DROP)))))))


def _summary_candidates(root: Node, url: str) -> list[dict]:
    region = _first_node(root, SUMMARY_REGION) or root
    found = [*_values(root, SUMMARY_META), *_values(root, SUMMARY_BLOCKS), *_values(region, SUMMARY_PARAGRAPHS)]
    return [{"kind": rule.kind, "text": value} for rule, value in found]


def _div_spans(root: Node, url: str) -> dict:
    """Text of the page once, and where the text of each ``div`` lies in it."""
    pieces: list[str] = []
    spans: list[dict] = []
    at = 0
    stack: list = [(child, None) for child in reversed(root.children)]
    while stack:
        child, opened = stack.pop()
        if opened is not None:
            spans[opened]["length"] = at - spans[opened]["start"]
        elif isinstance(child, str):
            pieces.append(child)
            at += len(child)
        elif child.tag not in NO_TEXT:
            if child.tag == "div":
                spans.append({"start": at, "length": 0})
                stack.append((child, len(spans) - 1))
            stack.extend((c, None) for c in reversed(child.children))
    least = SUMMARY_LEAST["div"][0]
    return {"text": "".join(pieces), "spans": [s for s in spans if s["length"] > least]}




def _field(block: Node, selectors: Sequence[str]) -> tuple[str, Node | None]:
    """Value and element of the first selector that finds one (``selector@attribute`` reads the attribute)."""
    for selector in selectors:
        selector, _, attribute = selector.partition("@")
        node = next(select(block, selector), None)
        if node is not None:
            return _squash(_value(node, (attribute or "text",))), node
    return "", None


def _listing(root: Node, url: str, profile: str) -> list[dict]:
    """Rows of the first kind of block the page has; a block needs a title and, if its source names one, a link."""
    spec = LISTING_PROFILES[profile]
    blocks = next((b for s in spec["items"] if (b := list(select(root, s)))), [])
    out = []
    for pos, block in enumerate(blocks):
        fields = {name: _field(block, spec.get(name, ())) for name in LISTING_FIELDS}
        row = {"pos": pos} | {name: value for name, (value, _) in fields.items()}
        target = fields["link" if "link" in spec else "title"][1]
        row["link"] = target.get("href") if target is not None else ""
        if row["title"] and (row["link"] or "link" not in spec):
            if "drop" in spec:
                row["summary"] = re.sub(rf"(?i)^{spec['drop']}\s*", "", row["summary"])
            out.append(row)
    return out


#: Part name -> (type, reader of a parsed page).
PARTS = {
    "title": ("string", lambda root, url: _field(root, TITLE)[0]),
    "page_date": ("string", lambda root, url: _squash(_first_value(root, PAGE_DATE))),
    "body": ("string", _body),
    "abstract_candidates": ("array<string>", lambda root, url: [_squash(v) for _, v in _values(root, ABSTRACT)]),
    "summary_candidates": ("array<struct<kind:string,text:string>>", _summary_candidates),
    "divs": ("struct<text:string,spans:array<struct<start:int,length:int>>>", _div_spans),
    "published": ("string", lambda root, url: _first_value(root, PUBLISHED)),
    "modified": ("string", lambda root, url: _first_value(root, MODIFIED)),
    "next_url": ("string", lambda root, url: next((urljoin(url or "", v) for _, v in _values(root, NEXT)), "")),
    **{f"items_{p}": ("array<struct<pos:int,title:string,link:string,series:string,date:string,summary:string,status:string>>",
                      lambda root, url, p=p: _listing(root, url, p)) for p in LISTING_PROFILES},
}


#: Pages that a task holds parsed values of at once.
PAGES_AT_ONCE = 16


def extract_pages(pages: DataFrame, parts: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``page_id, url, error`` and the wanted parts; each page is parsed once.  ``keep`` names columns to carry along.

    ``error`` is the parser's complaint about a page ('' for most); its parts come
    from what was read before it.
    """
    kept = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep]
    schema = StructType.fromDDL(", ".join(["page_id long", "url string", *(f"{p} {PARTS[p][0]}" for p in parts), "error string", *kept]))
    wanted = [(p, PARTS[p][1], to_arrow_type(schema[p].dataType)) for p in parts]
    ship_package(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(start, PAGES_AT_ONCE)
                rows: list[list] = [[] for _ in wanted]
                errors: list[str] = []
                for html, url in zip(some.column("html").to_pylist(), some.column("url").to_pylist()):
                    root, error = parse(html)
                    errors.append(error)
                    for values, (_, read, _) in zip(rows, wanted):
                        values.append(read(root, url))
                made = [pa.array(values, kind) for values, (_, _, kind) in zip(rows, wanted)]
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), *made, pa.array(errors, pa.string()), *(some.column(c) for c in keep)],
                    names=schema.names)

    read_columns = [F.col("page_id").cast("long").alias("page_id"), *dict.fromkeys(["url", "html", *keep])]
    return pages.select(*read_columns).mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------

def page_body(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, url, body): body text by selector cascade, whole page text as fallback; and the kept columns."""
    return extract_pages(pages, ["body"], keep).drop("error")


def page_heading(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, page_date): title and publication date by selector cascade."""
    return extract_pages(pages, ["title", "page_date"]).drop("error")


def page_abstract(pages: DataFrame) -> DataFrame:
    """(page_id, url, abstract): first cascade candidate that reads like an abstract, else ''."""
    ext = extract_pages(pages, ["abstract_candidates"])
    ok = F.filter(F.transform("abstract_candidates", lambda t: clean_text(t)), lambda t: is_likely_abstract(t))
    return ext.select("page_id", "url", F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit("")).alias("abstract"))


_SUMMARY_PREFIX = "(?i)^[\\s\\u00a0]*summary[\\s\\u00a0]*[:\\-]?[\\s\\u00a0]*"


def _by_kind(kind: Column, at: int) -> Column:
    chosen = F.lit(0)
    for name, least in SUMMARY_LEAST.items():
        chosen = F.when(kind == name, least[at]).otherwise(chosen)
    return chosen


def _gate(kind: Column, raw: Column) -> Column:
    """The summary a candidate gives, '' when its kind's gates refuse it (each text is cleaned and stripped once)."""
    def judged(text: Column) -> Column:
        legal = (kind == "para") & F.lower(text).rlike("|".join(LEGAL_WORDS))
        usable = (F.length(text) > _by_kind(kind, 0)) & ~legal & (
            (_by_kind(kind, 2) == 0) | (word_count(text) > _by_kind(kind, 2)))
        kept = let(strip_contact_info(text), lambda st: F.when(
            (F.length(st) > _by_kind(kind, 1)) & ~is_uninformative(st, "summary"), first_sentences(st, 2)))
        return F.when(usable, kept)

    cleaned = F.trim(F.regexp_replace(clean_text(raw), _SUMMARY_PREFIX, ""))
    return F.coalesce(let(cleaned, judged), F.lit(""))


def _first_usable(before: Column, candidates: Column, gate) -> Column:
    """``before`` if it is a summary, else the first candidate that passes ``gate``; later ones are not judged."""
    return F.aggregate(candidates, before, lambda found, c: F.when(found != "", found).otherwise(gate(c)))


def page_summary(pages: DataFrame) -> DataFrame:
    """(page_id, url, summary): first candidate passing its gates, cut to two sentences.

    Search-index URLs give ''.  Candidates: meta and Open Graph descriptions,
    abstract/summary blocks, paragraphs of the main content; only where all of these
    fail, the page is read again for its divs, which come as spans of one text (nested
    divs cost no copies).  A candidate is judged only after all before it failed.
    """
    ext = extract_pages(pages, ["summary_candidates"], ["html"])
    early = _first_usable(F.lit(""), F.col("summary_candidates"), lambda c: _gate(c["kind"], c["text"]))
    known = F.when(is_search_index_url(F.col("url")), F.lit("")).otherwise(early)
    judged = bind(ext.select("page_id", "url", "html", "summary_candidates"), "summary", known)
    # pages without a summary so far keep their html; the others are passed through without being parsed
    open_page = (F.col("summary") == "") & ~is_search_index_url(F.col("url"))
    rest = extract_pages(judged.select("page_id", "url", F.when(open_page, F.col("html")).alias("html"), "summary"), ["divs"], ["summary"])
    divs = _first_usable(F.col("summary"), F.col("divs.spans"), lambda s: _gate(
        F.lit("div"), F.substring(F.col("divs.text"), s["start"] + 1, s["length"])))
    return rest.select("page_id", "url", F.when(is_search_index_url(F.col("url")), F.lit("")).otherwise(divs).alias("summary"))


def article_dates(pages: DataFrame) -> DataFrame:
    """(page_id, url, published, modified) from meta/itemprop cascades and labelled ``<time>``."""
    return extract_pages(pages, ["published", "modified"]).drop("error")


def next_page_links(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(page_id, url, next_url) resolved against the page URL; ``known`` URLs are left out."""
    ext = extract_pages(pages, ["next_url"]).drop("error").where(F.col("next_url") != "")
    if known is not None:
        ext = ext.join(known.select(F.col("url").alias("next_url")), "next_url", "left_anti")
    return ext


def listing_items(pages: DataFrame, profile: str = "pqc_publications") -> DataFrame:
    """One row per listed item (title required), in page order: page_id, pos, fields as listed."""
    ext = extract_pages(pages, [f"items_{profile}"])
    return ext.select("page_id", F.col("url").alias("page_url"), F.explode(f"items_{profile}").alias("it")).select(
        "page_id", "page_url", "it.*")


def listing_records(pages: DataFrame, source: str) -> DataFrame:
    """Item rows of a source's listing pages: constants, absolute links, shown and raw dates.

    Publications and presentations carry ``document_name, release_date(_raw)``, news
    ``title, publish_date(_raw)``, projects ``title``.
    """
    section, constants, site, show, raw = LISTING_ROWS[source]
    items = listing_items(pages, source)
    name = "title" if section in ("news", "projects") else "document_name"
    date = "publish_date" if section == "news" else "release_date"
    parsed = parse_date("date", "news" if source == "qis_news" else "listing")
    strict = parse_date("date", "news") if source == "qis_news" else F.try_to_date("date", "MMMM d, yyyy").cast("timestamp_ntz")
    shown = {"listed": F.col("date"), "style": F.coalesce(format_date(parsed, "display"), F.col("date")),
             "only style": F.coalesce(format_date(parsed, "display"), F.lit("")), "none": F.lit("")}[show]
    raws = {"parsed": F.coalesce(format_date(parsed, "raw"), F.lit("")), "none": F.lit(""),
            "or listed": F.coalesce(format_date(strict, "raw"), F.col("date"))}[raw]
    fields = {c: F.lit(constants[c]) if c in constants else blank(c) for c in ("series", "status")}
    return items.select(
        "page_id", "pos", F.lit(source.split("_")[0]).alias("topic"), F.lit(section).alias("section"),
        F.col("title").alias(name), absolutize_link("link", site).alias("link"), "summary",
        *(c.alias(n) for n, c in fields.items()), F.lit(constants.get("resource_type", "")).alias("resource_type"),
        shown.alias(date), raws.alias(f"{date}_raw"))
