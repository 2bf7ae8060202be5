"""Wrapper inference and extraction on hand-made and given pages."""

import html
import json
import random
import re
import time

from tidefeed.llm import html_wrapper as W
from tidefeed.llm.html_tokens import tokens

SF = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T &lt; t</title><style>p{}</style></head><body class="site has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href='x>y'>More</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content"><!-- <p>old</p> -->
<article><h2>Head&shy;line</h2><p>One &amp; two
  <b>three</b><br>four<p>Five &#233; &nbsp;six<ul><li>first<li>second <a href="#">link</a></ul>
<form><label>mail</label><input></form><script>document.write("<p>no</p>")</script>
<div class="ad-slot">Buy!</div><blockquote>Said < so</blockquote><section id="comments"><p>nice post</p></section></article>
</div><aside><p>Related</p></aside><footer>&copy; us</footer></body></html>"""
TEXT = "Head\xadline\n\nOne & two three four\n\nFive é six\n\nfirst\n\nsecond link\n\nSaid < so"


def extracted(spark, rows):
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, salt int")
    out = W.extract_text(pages, W.infer_wrappers(pages)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    return sorted((str(r["page_id"]), r["text"]) for r in out)


def test_main_text_of_a_page(spark):
    rows = [(1, "http://a.b/", PAGE), (2, "http://a.b/2", PAGE.replace("<aside>", "<div class=share>x</div><aside>")), (3, "http://c.d/", PAGE)]
    assert extracted(spark, rows) == [("1", TEXT), ("2", TEXT), ("3", TEXT)]


def test_pages_without_a_container(spark):
    page = "<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div><p>Text one.</p><p>Text two.</p></div><ul><li><a href=x>only links here</a></li></ul>"
    assert extracted(spark, [(1, "http://a/", page), (2, "http://a/", page)]) == [("1", "Text one.\n\nText two.")] * 1 + [("2", "Text one.\n\nText two.")]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (None, "http://a/", "<p>x"), (3, "http://a/", "plain text"), (3, "http://a/", "plain text"),
            (4, "http://a/", "<article><p>unclosed <b>tags <p>and < signs <"), (5, "http://a/", "<" * 20_000 + "<font>" * 20_000 + "deep"),
            (6, "http://a/", "<div>" * 3000 + "nested"), (7, "http://a/", "<p a='" + "x" * 50_000), (8, "http://a/", "<!-- open")]
    out = dict(extracted(spark, rows))
    assert out["1"] == out["2"] == out["8"] == "" and out["3"] == "plain text" and out["4"] == "unclosed tags\n\nand < signs <"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.extract_text(empty, W.infer_wrappers(empty)).count() == 0


def test_given_pages_equal_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in W.extract_text(pages, W.infer_wrappers(pages)).collect()}
    assert len(got) == pages.count()
    for row in pages.collect():
        body = re.sub(r"</?b>|<br>", "", re.search(r"<article>(.*)</article>", row["html"], re.S)[1])
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[row["page_id"]] == "\n\n".join(b for b in blocks if b)


def stream(text):
    return [t if not t.startswith("~") else t for t in text.split()]


def test_fold_and_align():
    row = stream("li ~li /li")
    one = W.fold(stream("ul") + row * 3 + stream("/ul p ~p /p"))
    two = W.fold(stream("ul") + row + stream("/ul") + stream("p ~p /p") * 4)
    three = W.fold(stream("ul") + row * 2 + stream("/ul h ~h /h p ~p /p"))
    wrapper = W.infer([one, two, three])
    assert W.as_expression(wrapper) == "<ul>(<li>#</li>)+</ul>(<h>#</h>)?(<p>#</p>)+"
    assert W.infer([three, one, two, one, wrapper]) == wrapper
    assert W.slots(wrapper) == ["li", "h", "p"]


def test_nested_repeats_fold():
    assert W.as_expression(W.fold(stream("a b b c a b b b c a b c"))) in ("(<a>(<b>)+<c>)+<a><b><c>", "(<a>(<b>)+<c>)+")


def accepts(wrapper, tags):
    pattern = "".join((re.escape(n) + " ") if isinstance(n, str) else f"(?:{accepts(n[1], None)}){n[0]}" for n in wrapper)
    return pattern if tags is None else re.fullmatch(pattern, "".join(t + " " for t in tags)) is not None


def test_wrappers_accept_every_page_they_were_made_from():
    rng = random.Random(4)
    parts = [["h", "~h"], ["p", "~p", "/p"], ["li", "~li", "/li"], ["div", "~d"], ["x"]]
    for _ in range(60):
        pages = []
        for _ in range(6):
            page = ["body"]
            for part in parts:
                page += part * rng.choice([0, 1, 1, 2, 5])
            pages.append(page + ["/body"])
        wrapper = W.infer(W.fold(p) for p in pages)
        assert set(W.slots(wrapper)) == {t[1:] for p in pages for t in p if t.startswith("~")}
        assert all(accepts(wrapper, p) for p in pages), (pages, W.as_expression(wrapper))


def test_long_patterns_are_aligned_whole(monkeypatch):
    monkeypatch.setattr(W, "CELLS", 4)
    pages = [[f"t{n}", f"~s{n}", "x", "y", "z"] * (1 + n % 2) + ["end", f"~e{n % 3}"] for n in range(9)]
    wrapper = W.infer(map(W.fold, pages))
    assert set(W.slots(wrapper)) == {f"s{n}" for n in range(9)} | {"e0", "e1", "e2"}
    assert all(W.Expression(wrapper).match(p) for p in pages)
    long = [W.fold([t for n in range(0, 3000 * step, step) for t in (f"c{n}", f"~{n}", f"/c{n}")]) for step in (1, 2)]
    monkeypatch.undo()
    start = time.time()
    both = W.Expression(W.align(*long))
    assert all(both.match(p) for p in long) and time.time() - start < 10


def test_streams_are_matched_part_by_part():
    rng = random.Random(9)
    parts = [["h", "~h", "/h"], ["h", "=h#1", "/h"], ["p", "~p", "/p"], ["p", "=p#1", "/p"], ["p", "=p#2", "/p"], ["li", "~li", "/li"], ["x"]]
    for _ in range(150):
        pages = []
        for _ in range(rng.choice([2, 6, 12])):
            order = parts if rng.random() < 0.7 else rng.sample(parts, len(parts))
            pages.append(["body", *(t for part in order for t in part * rng.choice([0, 1, 1, 2, 5])), "/body"])
        levels = [W.infer(map(W.fold, pages[:3])), W.infer(map(W.fold, pages[3:]))] if len(pages) > 3 else map(W.fold, pages)
        expression = W.Expression(wrapper := W.infer(levels))
        known = {"=" + c for c in W.constants_of(wrapper)}
        for page in pages:
            named = ["~" + t[1:].split("#")[0] if t[0] == "=" and t not in known else t for t in page]
            found = expression.match(named)
            assert found is not None, (pages, wrapper)
            assert all((part := expression.parts[at]) == t or t[0] == "=" and part == "~" + t[1:].split("#")[0] for t, at in zip(named, found))
        assert expression.match(["body", "no", "/body"]) is None
    assert W.Expression([]).match([]) == [] and W.Expression([]).match(["p"]) is None and W.Expression(["p"]).match([]) is None


def test_unequal_constants_of_one_place_become_a_field():
    wrapper = W.infer([["p", "=k#1", "/p"], ["p", "=k#2", "/p"], ["p", "~k", "/p", "q"]])
    assert W.as_expression(wrapper) == "<p>#</p>(<q>)?"


def test_long_and_nested_pages_take_linear_time():
    start = time.time()
    page = "<div><p>a<b>b</b></p></div>" * 20_000
    assert W.main_text(page, None).count("ab") == 20_000 and sum(1 for _ in tokens(page)) > 100_000
    assert W.main_text("<div class='a b'>x" * 4000, None).count("x") == 4000
    assert W.main_text("<svg>" * 20_000 + "x", None) == "x"
    assert time.time() - start < 20


def test_elements_that_are_no_raw_text_end_with_their_parent():
    for name in ("object data=x", "canvas", "svg", "math", "select", "template"):
        assert W.main_text(f"<article><p>One</p><{name}><p>Two</p></article><p>Three</p>", None) == "One\n\nTwo"
    page = "<article><p>One <svg><g><svg/></g><text>no</text></svg>more <math><mi>x</mi></math> is</p><select><option>no</select>{}</article>"
    for raw in ("<script>if (a</b) {}</script>", "<style>p{}</style>", "<textarea>no</textarea>", "<template><p>no</p></template>"):
        assert W.main_text(page.replace("{}", raw, 1), None) == "One more x is"


def test_attributes_are_read_name_by_name(spark):
    opened = ['<article style="overflow:hidden" aria-hidden="false">', '<article class="post category-social">', '<main data-id="search-42" title=\'class="nav"\'>',
              '<div class="content overflow-hidden w-[3px]">', '<article class="w-[3px] related">', '<div class=entry data-role=banner>']
    pages = [(n, f"http://h{n}/", f"<body>{tag}<p>Visible text.</p><div hidden><p>no</p></div><div class='x hidden'>no</div></body>")
             for n, tag in enumerate(opened)]
    assert extracted(spark, pages) == [(str(n), "Visible text.") for n in range(len(opened))]
    gone = ["<article hidden>", '<div class="content sidebar">', '<div class="post-footer">', "<div id=comments><article>"]
    assert all(text == "" for _, text in extracted(spark, [(n, f"http://h{n}/", f"{tag}no") for n, tag in enumerate(gone)]))


def bare(n):
    """Elements without names that tell anything: only the other pages of the host say what is template."""
    return (f"<body><div>The site of things</div><div><h2>Summary</h2><p>Text {n}.</p><p>More of {n}.</p><p>Always this.</p></div>"
            f"<div>All rights kept, write to us</div></body>")


BARE = "Summary\n\nText {0}.\n\nMore of {0}.\n\nAlways this."
FRAME = "The site of things\n\n{}\n\nAll rights kept, write to us"


def test_the_wrapper_tells_template_from_main_text(spark):
    pages = [(n, "http://a/", bare(n)) for n in range(8)] + [(10, "http://b/", bare(1)), (11, "http://b/", bare(2))]
    pages += [(n, "http://c/", bare(1)) for n in range(20, 24)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    wrappers = W.infer_wrappers(frame)
    got = {r["page_id"]: r["text"] for r in W.extract_text(frame, wrappers).collect()}
    assert all(got[n] == BARE.format(n) for n in range(8))
    # two pages, or copies of one page, tell nothing
    assert all(got[n] == FRAME.format(BARE.format(m)) for n, m in ((10, 1), (11, 2), (20, 1)))
    shown = {r["host"]: r["wrapper"] for r in wrappers.collect()}
    assert shown["a"] == "<body><div>=</div><div><h2>=</h2>(<p>#</p>)+<p>=</p></div><div>=</div></body>"
    # rows come through the wrapper: without it, or with an empty one, each page is read by its own expression
    for other in (wrappers.where("false"), wrappers.selectExpr("host", "wrapper", "'[]' nodes")):
        none = {r["page_id"]: r["text"] for r in W.extract_text(frame, other).collect()}
        assert all(none[n] == FRAME.format(BARE.format(n)) for n in range(8))
    menu = wrappers.selectExpr("host", "wrapper", "replace(nodes, '\"~', '\"^') nodes")
    assert {r["text"] for r in W.extract_text(frame, menu).where("page_id < 8").collect()} == {FRAME.format("Summary\n\nAlways this.")}


def test_constants_of_an_article_stay(spark):
    pages = [(n, "http://a/", f"<div>Site</div><article><h2>Summary</h2><p>Text {n}.</p></article>") for n in range(5)]
    pages += [(n, "http://d/", f"<article>Not found.</article><footer>{n}</footer>") for n in range(30, 38)]
    got = dict(extracted(spark, pages))
    assert all(got[str(n)] == f"Summary\n\nText {n}." for n in range(5)) and got["30"] == "Not found."


def test_a_page_of_another_shape_is_read_by_its_own_expression(spark):
    known = spark.createDataFrame([(n, "http://a/", bare(n)) for n in range(5)], "page_id long, url string, html string")
    new = spark.createDataFrame([(1, "http://a/", "<p>Only this.</p><h4>New</h4>"), (2, "http://a/", bare(77))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in W.extract_text(new, W.infer_wrappers(known)).collect()}
    assert got == {1: "Only this.\n\nNew", 2: BARE.format(77)}


def test_a_page_does_not_depend_on_the_hosts_other_shapes(spark):
    def page(n):
        return (f"<body><div class=box{n % 2}>Beside {n}</div><div class='entry topic-{chr(97 + n)}x'><p>Text {n}.</p>"
                f"<ul><li><a href=x>Reference {n}</a></li></ul></div></body>")

    mixed = (f"<div class=content>{'Long text of the page. ' * 9}</div><article class=card>A card beside it.</article>",
             f"<article>{'An article of the host. ' * 30}</article>")
    pages = [(n, "http://large/", page(n)) for n in range(24)] + [(30, "http://small/", page(0))]
    pages += [(40 + n, "http://mixed/", mixed[n % 2] + f"<footer>{n}</footer>") for n in range(2)]
    got = dict(extracted(spark, pages))
    assert all(got[str(n)] == f"Text {n}.\n\nReference {n}" for n in range(24)) and got["30"] == "Text 0.\n\nReference 0"
    assert got["40"] == ("Long text of the page. " * 9).strip() and got["41"] == ("An article of the host. " * 30).strip()


def test_groups_of_a_hot_hosts_streams_are_bounded(spark, monkeypatch):
    rows = [("hot", json.dumps(["body", *(["p", "~p"] if n % 2 else []), f"x{n}", f"~s{n}", "/body"])) for n in range(300)] + [("b", '["p", "~p"]'), ("c", "[]")]
    streams = spark.createDataFrame(rows, "host string, value string")
    monkeypatch.setattr(W, "GROUP", 10)
    sizes, read = spark.sparkContext.accumulator(0), W._aligned

    def counted(rows):
        assert len(rows) <= 30
        sizes.add(1)
        return read(rows)

    monkeypatch.setattr(W, "_aligned", counted)
    got = {r["host"]: json.loads(r["value"]) for r in W._wrapper_of_each_host(streams).collect()}
    assert set(got) == {"hot", "b", "c"} and set(W.slots(got["hot"])) == {"p"} | {f"s{n}" for n in range(300)}
    assert sizes.value > 30 and got["b"] == ["p", "~p"] and got["c"] == []
    pages = spark.createDataFrame([(n, "http://h/", f"<article><p>{n}</p><div class=c{chr(97 + n)}>x{n}</div></article>") for n in range(26)],
                                  "page_id long, url string, html string")
    monkeypatch.setattr(W, "_aligned", read)
    made = W.infer_wrappers(pages)
    assert made.count() == 1 and made.first()["wrapper"].count("#") == 27
