"""The cascade judges whole texts only where a gate needs them."""

from pyspark.sql import functions as F

from tidefeed.functions.quality import first_sentences, third_person
from tidefeed.operators.enrich import cache_lookup
from tidefeed.operators.summaries import _two


def test_two_sentences_are_rewritten_before_the_rest_is(spark):
    texts = ["We present x. Our test! It uses us. NIST we show.", "Summary: we show NIST", "no end", "", None, "...us. we", "This paper presents: I. NIST. us",
             "National NIST Institute of Standards and Technology. we develop it? Our. x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in d.select(_two(F.col("t")).alias("a"), first_sentences(third_person(F.col("t"), "summary"), 2).alias("b")).collect():
        assert row.a == row.b


def test_cache_entries_are_judged_for_items_that_ask_for_them(spark):
    items = spark.createDataFrame([(1, "a", "qis"), (2, "b", "qis"), (3, "c", "qis"), (4, "d", "qis"), (5, "e", "qis")], "seq long, cache_key string, topic string")
    good = "A method for exact tests of quantum systems is given here in full."
    rows = [("a", good, "2024-01-30"), ("b", "error occurred", "2024-01-30"), ("c", good, "2024-01-01"), ("d", "", "2024-01-30"), ("z", good, "2024-01-30")]
    cache = spark.createDataFrame(rows, "key string, summary string, day string").select(
        "key", F.lit("qis").alias("topic"), F.col("day").cast("timestamp_ntz").alias("ts"), "summary")
    out = cache_lookup(items, cache, as_of="2024-01-31 00:00:00")
    assert out.columns == ["cache_key", "topic", "seq", "cached_summary"]
    assert {r.seq: r.cached_summary for r in out.collect()} == {1: good, 2: None, 3: None, 4: "", 5: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # gates above the join
