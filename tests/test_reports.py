"""Reports, drafts, repair and helpers on small hand-made tables."""

from pyspark.sql import functions as F

from tidefeed.operators.common import bind
from tidefeed.operators.dedupe import dedupe_sidebar
from tidefeed.operators.ordering import comment_drafts
from tidefeed.operators.reports import audit, audit_report, cache_cleanup, repair_summaries, section_counts
from tidefeed.plans.adapters import conform

AS_OF = "2024-01-31 00:00:00"


def test_comment_drafts(spark):
    rows = [(1, "Drafts", "A", "", "2024-03-01", "January 5, 2024", None),
            (2, "Final", "B", "", "2024-03-01", "", "https://csrc.x.gov/pubs/sp/800/ipd"),
            (3, "Drafts", "C", "", "2024-01-30", "", None),        # deadline passed
            (4, "drafts open for comment", "D", "", "", "", None),  # no deadline
            (5, "Drafts", "E", "", "2024-02-10", "", None)]
    df = conform(spark.createDataFrame(rows, "seq long, category string, document_name string, comment_due_date string, "
                                             "comment_due_date_raw string, release_date string, link string"))
    out = comment_drafts(df, AS_OF).collect()
    assert [r["seq"] for r in out] == [5, 1, 2]
    assert out[1]["published"] == "January 5, 2024" and out[0]["published"] == "—"
    assert out[0]["due"] == "Not listed"


def test_repair_summaries(spark):
    rows = [(1, "T", ""), (2, "T", "Is a thing. Second. Third."), (3, "T", "Fine one. Fine two."),
            (4, "T", "One. Two. Three.")]
    df = spark.createDataFrame(rows, "seq long, document_name string, summary string")
    out = {r["seq"]: r for r in repair_summaries(df).collect()}
    assert out[1]["repair_candidate"] and out[1]["summary"] == ""
    assert out[2]["repair_candidate"] and out[2]["summary"] == "Is a thing. Second. Third."
    assert not out[3]["repair_candidate"]
    assert out[4]["summary"] == "One. Two." and out[4]["repaired"]


def test_dedupe_sidebar_prefers_better_link(spark):
    item = "struct<title:string,document_name:string,link:string>"
    rows = [(1, "publication", ("Doc", "", "https://www.nist.gov")),
            (2, "publication", ("Doc", "", "https://www.nist.gov/publications/x/y")),
            (3, "publication", ("Doc", "", "https://www.nist.gov/publications/x/z")),
            (4, "news", ("Doc", "", ""))]
    df = spark.createDataFrame(rows, f"seq long, type string, item {item}")
    out = sorted((r["type"], r["seq"]) for r in dedupe_sidebar(df).collect())
    assert out == [("news", 4), ("publication", 2)]


def test_audit_report_and_cleanup(spark):
    texts = [(1, "The method improves detection rates substantially. Results hold across datasets."),
             (2, "Too short"), (3, "")]
    df = spark.createDataFrame(texts, "doc_id long, summary string")
    rep = {r["issue_type"]: r for r in audit_report(audit(df)).collect()}
    assert set(rep) == {"❌ TRUNCATION", "❌ INCOMPLETE"}
    r = next(iter(rep.values()))
    assert (r["total"], r["passed"], r["failed"], r["pass_pct"]) == (2, 1, 1, 50)
    kept, report = cache_cleanup(df.withColumn("topic", F.lit("qis")))
    assert kept.count() == 1
    assert sorted((x["action"], x["reason"], x["n"]) for x in report.collect()) == \
        [("keep", "", 1), ("remove", "empty", 1), ("remove", "too short", 1)]


def test_section_counts_zero_fill(spark):
    df = spark.createDataFrame([("qis", "news"), ("qis", "news"), ("ai", "projects")], "topic string, section string")
    got = sorted(map(tuple, section_counts(df).collect()))
    assert ("ai", "news", 0) in got and ("ai", "projects", 1) in got and ("qis", "news", 2) in got
    assert len(got) == 7


def test_bind(spark):
    assert bind(spark.range(10), "x", F.col("id") * 2).agg(F.sum("x")).first()[0] == 90


def test_audit_report_without_issues_keeps_its_totals(spark):
    good = "The authors describe a method for testing modules. It works well in practice."
    audited = audit(spark.createDataFrame([(1, good), (2, good)], "id long, summary string")).withColumn(
        "status", F.lit("PASS")).withColumn("issues", F.array().cast("array<string>"))
    [row] = audit_report(audited).collect()
    assert (row["total"], row["passed"], row["failed"], row["issue_type"], row["issue_count"]) == (2, 2, 0, None, 0)
