"""Hand-derived unit tables for the column functions (expected values follow the stated rules)."""

import datetime as dt

from pyspark.sql import functions as F

from tidefeed.functions import dates as D
from tidefeed.functions import identity as I
from tidefeed.functions import links as L
from tidefeed.functions import quality as Q
from tidefeed.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def col_values(spark, expr, values, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["r"] for r in df.orderBy("i").select(expr.alias("r")).collect()]


def test_clean_text(spark):
    assert one(spark, T.clean_text("v"), "a​   b") == "a b"
    assert one(spark, T.clean_text("v"), None) == ""
    assert one(spark, T.normalize_text("v"), "  Hello   World ") == "hello world"


def test_links(spark):
    assert one(spark, L.normalize_link("v"), "HTTPS://WWW.X.gov/A/b/?q=1#f") == "https://www.x.gov/A/b"
    assert one(spark, L.normalize_link("v"), "/rel/path/") == "/rel/path"
    assert one(spark, L.normalize_link("v", default_scheme="https", sanitize=True), "/rel/") == "https:///rel"
    assert one(spark, L.sanitize_link("v"), "[](http://x/a)<http://x/a>") == "http://x/a"
    assert one(spark, L.sanitize_link("v"), "[](http://x/a)<http://x/b>") == "[](http://x/a)<http://x/b>"
    assert col_values(spark, L.link_score("v"), ["", "https://www.nist.gov/", "https://www.nist.gov/publications/x",
                                                  "https://csrc.nist.gov/pubs/sp/800"]) == [0, -50, 45, 45]


def test_identity(spark):
    df = spark.createDataFrame([("Test Publication", "March 1, 2025", None)],
                               "document_name string, release_date string, link string")
    for c in ("title", "document_number", "release_date_raw", "edited_date_raw", "last_edited_date_raw",
              "publish_date_raw", "edited_date", "last_edited_date", "publish_date"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert df.select(I.item_identity().alias("r")).first()["r"] == "label::test publication::date::march 1, 2025"
    only_link = df.withColumn("document_name", F.lit("")).withColumn("release_date", F.lit("")) \
                  .withColumn("link", F.lit("https://X.gov/a/"))
    assert only_link.select(I.item_identity().alias("r")).first()["r"] == "link::https://x.gov/a"
    nothing = only_link.withColumn("link", F.lit(None).cast("string"))
    assert nothing.select(I.item_identity().alias("r")).first()["r"] == "empty-item"
    assert I.add_identity(df).first()["identity"] == "label::test publication::date::march 1, 2025"


def test_parse_date_profiles(spark):
    got = col_values(spark, D.parse_date("v", "listing"),
                     ["March 19th, 2026", "19 March 2026", "30/12/2025", "03/04/2025", "TBD", "March 2026"])
    assert got == [dt.datetime(2026, 3, 19), dt.datetime(2026, 3, 19), dt.datetime(2025, 12, 30),
                   dt.datetime(2025, 3, 4), None, dt.datetime(2026, 3, 1)]
    got = col_values(spark, D.parse_date("v", "dashboard"), ["9/18/25", "2025-08-29T11:34-04:00", "2025", "9/18/75"])
    assert got == [dt.datetime(2025, 9, 18), dt.datetime(2025, 8, 29, 11, 34), None, dt.datetime(1975, 9, 18)]
    assert one(spark, D.format_date(D.parse_date("v", "listing"), "display"), "March 6, 2026") == "March 06, 2026"


def test_extract_due_date(spark):
    got = col_values(spark, D.extract_due_date("v"),
                     ["Comments Due: April 5, 2026", "please provide comments by May 1, 2026.", "nothing"])
    assert [tuple(r) for r in got] == [("April 05, 2026", "2026-04-05"), ("May 01, 2026", "2026-05-01"), ("", "")]


def test_sentences(spark):
    assert one(spark, Q.first_sentences("v"), "One two.  Three four! Five") == "One two. Three four!"
    assert one(spark, F.size(Q.split_sentences("v")), "no terminator") == 0
    assert one(spark, Q.mid_phrase_start("v"), '"Is developing a method.') is True
    assert one(spark, Q.mid_phrase_start("v"), "Island nations.") is False
    assert one(spark, Q.truncate_sentence("v", 20), "First one. Second sentence here.") == "First one."


def test_bad_summary(spark):
    rows = col_values(spark, Q.bad_summary("v"), [
        "", "Only twenty four chars..", "Visit us. Access denied for this resource today.",
        "A complete thought that never ends", "This is a method on single-cell lith."])
    assert [r["reason_kind"] for r in rows] == ["empty", "too short", "boilerplate", "incomplete", "cut off"]
    assert rows[1]["reason"] == "too short (24 chars)"
    assert rows[4]["reason"] == "cut off at abbreviation 'lith.'"


def test_audit_summary(spark):
    rows = col_values(spark, Q.audit_summary("v"), [
        "The method improves detection rates substantially.",
        "The method improves detection rates substantially. Results hold across datasets.",
        ""])
    assert (rows[0]["status"], rows[0]["score"]) == ("PASS", 0.75)
    assert (rows[1]["status"], rows[1]["score"]) == ("PASS", 1.0)
    assert (rows[2]["status"], rows[2]["score"], rows[2]["audited"]) == ("FAIL", 0.0, False)


def test_gibberish_and_gates(spark):
    assert one(spark, Q.has_gibberish("v", "audit"), "a a a b c") is True
    assert one(spark, Q.has_gibberish("v", "audit"), "a a b c") is False
    assert one(spark, Q.has_gibberish("v", "lenient"), "ends with a full stop.") is True
    assert one(spark, Q.is_uninformative("v", "summary"), "Mail me at a.b@example.com today") is True
    assert one(spark, Q.complete_sentences("v"), "The first sentence here. The second one too.") is True
    assert one(spark, Q.valid_summary("v"), "The method improves recall. It works across many datasets.") is True
    assert one(spark, Q.valid_summary("v"), "the method improves recall. It works across many datasets.") is False


def test_third_person(spark):
    assert one(spark, Q.third_person("v", "summary"), "Summary: We present our NIST tool.") == "The study presents their tool."
