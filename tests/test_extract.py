"""Hand-made HTML pages for the extraction cascades."""

from tidefeed.operators import extract as X
from tidefeed.operators.page_tree import parse, select

LISTING = """<html><body>
<div class="search-list-item"><h3><a href="/pubs/a">First Report</a></h3><span class="series">SP 800</span>
<strong id="date-container-1">March 19, 2026</strong><p>Abstract: A study of things.</p></div>
<div class="search-list-item"><p>No title link here at all</p></div>
<div class="search-list-item"><h3><a href="/pubs/b">Second Report</a></h3></div>
</body></html>"""

ARTICLE_META = """<html><head><meta property="article:published_time" content="2025-01-02T10:00:00Z">
<meta property="article:modified_time" content="2025-02-03T09:00:00Z"></head><body><p>x</p></body></html>"""

ARTICLE_TIME = """<html><body><time datetime="2025-03-01">Published March 1</time>
<time datetime="2025-04-05">Updated April 5</time></body></html>"""

BODY = """<html><body><nav>menu menu</nav><article><div class="ad">buy now</div>
<p>""" + "Research text about a method and its results. " * 5 + """</p></article><footer>foot</footer></body></html>"""

SUMMARY = """<html><head><meta name="description" content="Summary: The new method measures qubit states precisely across many devices. It scales well. Third."></head>
<body><p>short</p></body></html>"""


def _pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://x.gov/p/{i}", h) for i, h in enumerate(htmls)],
                                 "page_id long, url string, html string")


def test_listing_items(spark):
    rows = X.listing_items(_pages(spark, LISTING), "pqc_publications").orderBy("pos").collect()
    assert [r["title"] for r in rows] == ["First Report", "Second Report"]
    assert rows[0]["series"] == "SP 800" and rows[0]["date"] == "March 19, 2026"
    assert rows[0]["summary"] == "A study of things."


def test_article_dates(spark):
    rows = {r["page_id"]: r for r in X.article_dates(_pages(spark, ARTICLE_META, ARTICLE_TIME)).collect()}
    assert (rows[0]["published"], rows[0]["modified"]) == ("2025-01-02T10:00:00Z", "2025-02-03T09:00:00Z")
    assert (rows[1]["published"], rows[1]["modified"]) == ("", "2025-04-05")


def test_page_body_drops_ads(spark):
    body = X.page_body(_pages(spark, BODY)).first()["body"]
    assert "buy now" not in body and "menu" not in body and body.startswith("Research text")


def test_page_summary_meta_first(spark):
    row = X.page_summary(_pages(spark, SUMMARY)).first()
    assert row["summary"] == "The new method measures qubit states precisely across many devices. It scales well."


def test_selectors():
    root, error = parse('<div class="a b"><ul><li class="next"><a href="/n">n</a></li></ul>'
                        '<p id="content-area-3">p</p></div>')
    assert error == ""
    assert next(select(root, "li.next a")).get("href") == "/n"
    assert next(select(root, 'p[id^="content-area-"]')).strings() == ["p"]
    assert next(select(root, "[class*='b']")).tag == "div"
    assert [n.tag for n in select(root, "div ul a, p[id$='3'], .a.b")] == ["div", "a", "p"]
    assert list(select(root, "p a")) == [] and list(select(root, ".a.c")) == []
    assert X.PARTS["next_url"][1](root, "https://x.gov/list/") == "https://x.gov/n"


def test_deep_and_broken_markup(spark):
    deep = "<div>" * 5000 + "deep text" + "<font>" * 5000
    pages = _pages(spark, deep, "<p>" * 5000 + "x", "<![bad", "</div></p>plain", None)
    rows = {r["page_id"]: r for r in X.extract_pages(pages, ["body", "divs", "summary_candidates"]).collect()}
    assert rows[0]["body"] == "deep text" and rows[1]["body"] == "x" and rows[3]["body"] == "plain" and rows[4]["body"] == ""
    assert sum(s["length"] for s in rows[0]["divs"]["spans"]) == 0


def test_nested_divs_come_as_spans_of_one_text(spark):
    text = "word " * 40
    page = f"<div>{text}<div>{text}<div>{text}</div></div></div>"
    row = X.extract_pages(_pages(spark, page), ["divs"]).first()["divs"]
    assert row["text"] == text * 3 and [(s["start"], s["length"]) for s in row["spans"]] == [(0, 600), (200, 400), (400, 200)]


NEWS = """<div class="search-result"><h3><a href="/news/1">Alpha <b>Beta</b></a></h3><span class="date">March 05, 2026</span>
<div class="description">What happened.</div></div><div class="search-result"><h4><a href="https://o.org/2">Gamma</a></h4>
<time>soon</time><p>Later.</p></div><div class="search-result"><p>no link</p></div>"""


def test_news_rows_of_each_source(spark):
    rows = {(s, r["pos"]): r for s in ("pqc_news", "ai_news") for r in X.listing_records(_pages(spark, NEWS), s).collect()}
    assert set(rows) == {(s, p) for s in ("pqc_news", "ai_news") for p in (0, 1)}
    first, second = rows["ai_news", 0], rows["pqc_news", 1]
    assert (first["title"], first["link"], first["summary"]) == ("Alpha Beta", "https://www.nist.gov/news/1", "What happened.")
    assert (first["publish_date"], first["publish_date_raw"]) == ("March 05, 2026", "2026-03-05")
    assert (second["link"], second["publish_date"], second["publish_date_raw"]) == ("https://o.org/2", "soon", "soon")
    assert rows["ai_news", 1]["publish_date_raw"] == "" and first["resource_type"] == "Artificial Intelligence News"


def test_presentations_carry_constants(spark):
    page = """<div class="search-list-item"><a id="title-link-1" href="/p/1">Talk</a><strong id="date-container-1">May 2025</strong></div>
<div class="search-list-item"><a href="/p/2">Not a title link</a></div>"""
    [row] = X.listing_records(_pages(spark, page), "qis_presentations").collect()
    assert (row["document_name"], row["series"], row["status"], row["release_date"]) == ("Talk", "Presentation", "Available", "May 2025")
    assert row["link"] == "https://csrc.nist.gov/p/1" and row["resource_type"] == "Quantum Information Science Presentation"


def test_qis_news_takes_the_time_attribute_and_needs_a_link(spark):
    page = '<article><h3>One</h3><a href="/a">x</a><time datetime="2025-04-05T10:00:00Z">April</time></article><article><h3>Two</h3></article>'
    [row] = X.listing_records(_pages(spark, page), "qis_news").collect()
    assert (row["title"], row["link"], row["publish_date"], row["publish_date_raw"]) == (
        "One", "https://www.nist.gov/a", "April 05, 2025", "2025-04-05")


def test_summary_cascade_uses_linked_page(spark):
    from tidefeed.operators.summaries import summary_cascade
    pages = _pages(spark, SUMMARY, BODY)
    items = spark.createDataFrame(
        [(1, "qis", "Doc A", "", "https://x.gov/p/0", "Publication"),
         (2, "qis", "Doc B", "", "https://x.gov/p/0", "Presentation"),
         (3, "qis", "Doc C", "", "", "Publication")],
        "seq long, topic string, document_name string, summary string, link string, resource_type string")
    out = {r["seq"]: r["generated_summary"]
           for r in summary_cascade(items, pages_summary=X.page_summary(pages), as_of="2024-01-31 00:00:00").collect()}
    assert out[1] == "The new method measures qubit states precisely across many devices. It scales well."
    assert out[2] == "" and out[3] == ""


def test_next_page_links_skip_known(spark):
    p0 = '<html><body><a rel="next" href="/p/1">next</a></body></html>'
    p1 = '<html><body><ul class="pager"><li class="next"><a href="page-3">more</a></li></ul></body></html>'
    pages = _pages(spark, p0, p1)
    got = {r["page_id"]: r["next_url"] for r in X.next_page_links(pages, known=pages.select("url")).collect()}
    assert got == {1: "https://x.gov/p/page-3"}     # page 0's next (/p/1) is already known


def test_runs_from_another_folder(tmp_path):
    """Workers that cannot import the package are sent it."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from tidefeed.session import get_spark
from tidefeed.operators.extract import page_body
spark = get_spark("elsewhere", master="local[1]", shuffle_partitions=1)
pages = spark.createDataFrame([(1, "u", "<p>hello")], "page_id long, url string, html string")
print("BODY", page_body(pages).first()["body"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "BODY hello" in done.stdout, done.stderr[-2000:]
