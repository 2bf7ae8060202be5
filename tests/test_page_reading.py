"""Pages are read in small slices, by an index of their elements."""

from pyspark.sql import functions as F

from tidefeed.operators import extract as X
from tidefeed.operators.page_tree import _fits, _alternatives, parse, select

PAGE = ('<main><div class="a b"><p>one<p id="x">two</div><div class="b"><span data-k="1">three</span><br>'
        '<section><div class="a">four</div></section></main></i><div class="a"><p class="b">open')


def test_selection_equals_a_walk_over_all_elements():
    root, _ = parse(PAGE)
    for start in (root, *root.descendants()):
        for selector in ("p", ".a", ".b.a", "div p", "main .a, [data-k], p", "[id^='x']", ".missing", "section .a"):
            walked = [n for n in start.descendants() if any(_fits(n, chain) for chain in _alternatives(selector))]
            assert list(select(start, selector)) == walked, selector
    main = next(select(root, "main"))
    assert [n.tag for n in main.descendants()] == ["div", "p", "p", "div", "span", "br", "section", "div"]


def test_only_elements_that_may_fit_are_looked_at(monkeypatch):
    looked = []
    monkeypatch.setattr("tidefeed.operators.page_tree._is", lambda node, step: looked.append(node) or True)
    root, _ = parse("<p>x</p>" * 1000 + '<h1 class="title">t</h1>')
    assert [n.tag for n in select(root, "h1.title")] == ["h1"] and len(looked) == 1


def test_parsed_values_are_handed_on_slice_by_slice(spark, monkeypatch):
    """A batch of many pages never becomes one list of parsed values."""
    pages = spark.createDataFrame([(k, f"u{k}", f"<h1>t{k}​</h1><p>x</p>") for k in range(100)], "page_id long, url string, html string").coalesce(1)
    taken = {}

    class Pages:
        sparkSession, schema = spark, pages.schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            taken["batches"] = [b.num_rows for b in run(iter(pages.toArrow().combine_chunks().to_batches()))]

    X.extract_pages(Pages(), ["title"])
    assert sum(taken["batches"]) == 100 and max(taken["batches"]) <= X.PAGES_AT_ONCE
    got = X.page_heading(pages.withColumn("page_id", F.col("page_id").cast("int"))).orderBy("page_id").collect()
    assert [(r.page_id, r.url, r.title) for r in got] == [(k, f"u{k}", f"t{k}") for k in range(100)]
