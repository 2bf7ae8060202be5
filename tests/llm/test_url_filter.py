"""URL filter against a direct reading of the rules."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidefeed.llm import url_filter as U
from tidefeed.llm.queries import URL_RULES


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, U.DEFAULT_VERDICT))
    return host, path, best[1], best[2]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return {r["page_id"]: tuple(r)[1:] for r in U.judge_urls(pages, U.rules_table(spark, rules)).collect()}


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://com?x=1", "http://net#f",
        "https://www.Example.com/en/a?b", "https://example.com/en/", "https://example.com/en", "http://xexample.com/en/1",
        "http://b.www.example.com/en/", "http://a.net/es/x", "http://a.net/fr/", "http://a..com/", "x://y://com/", "http://é.com/É",
        "http://u@h.com:80/p", "http://a.com\n/z", "http://" + "a." * 5000 + "com/" + "p/" * 5000]


def test_production_rules(spark):
    assert judged(spark, URLS, URL_RULES) == {n: brute(u, URL_RULES) for n, u in enumerate(URLS)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.builds(lambda h, p: f"http://{h}/{p}", st.text("ab.", max_size=6), st.text("ab/?", max_size=6)), min_size=1, max_size=40),
       st.lists(st.tuples(st.text("ab.", min_size=1, max_size=3), st.text("/ab", max_size=3), st.sampled_from(["allow", "block"])), max_size=6,
                unique_by=lambda r: r[:2]))
def test_any_rules(spark, urls, rules):
    assert judged(spark, urls, rules) == {n: brute(u, rules) for n, u in enumerate(urls)}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://a.net/es/"), (None, None)], "page_id long, url string")
    rules = U.rules_table(spark, [*URL_RULES, ("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("net", None, "allow")])
    rows = sorted((str(r[0]), *r[1:]) for r in U.judge_urls(pages, rules).collect())
    assert [(r[0], r[1], r[4]) for r in rows] == [("1", "a.com", "block")] * 2 + [("None", "", "allow"), ("None", "a.net", "block")]
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert U.judge_urls(pages, rules.limit(0)).where("rule is null").count() == 4


def test_large_rule_tables_are_joined_without_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert judged(spark, URLS, URL_RULES) == {n: brute(u, URL_RULES) for n, u in enumerate(URLS)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
