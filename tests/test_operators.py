"""Operator properties and hand tables: diff, notifications, paging, dedupe."""

import datetime as dt

from pyspark.sql import functions as F

from tidefeed.operators import diff as DF
from tidefeed.operators import notifications as N
from tidefeed.operators.dedupe import first_per_key
from tidefeed.operators.ordering import stop_after_stale_pages
from tidefeed.plans import adapters as A

SF = "/root/testdata/sf0.001"
AS_OF = "2024-01-31 00:00:00"


def _items(spark):
    return A.items_pages(spark, SF)


def test_new_items_properties(spark):
    items = _items(spark)
    assert DF.new_items(items, items, fields=["title", "link", "summary"]).count() == 0
    cur = items.where(A.in_curr_crawl())
    prev = items.where(A.in_prev_crawl())
    new = DF.new_items(cur, prev, fields=["title", "link", "summary"])
    merged_cur = DF.merge_items(DF._with_identity(cur, "identity"), group_cols=("topic", "section"),
                                fields=["title", "link", "summary"])
    kept = merged_cur.join(DF.merge_items(DF._with_identity(prev, "identity"), group_cols=("topic", "section"),
                                          fields=["title", "link", "summary"]).select("topic", "section", "identity"),
                           ["topic", "section", "identity"], "left_semi")
    assert new.count() + kept.count() == merged_cur.count()
    assert DF.has_changed(cur, prev).first()["changed"] is True
    assert DF.has_changed(items, items).first()["changed"] is False


def _notes(spark, dates):
    rows = [(i, "news", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), (f"t{i}", "", "", d))
            for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "seq long, type string, timestamp timestamp_ntz, scrape_date timestamp_ntz, "
                                       "item struct<title:string,link:string,release_date:string,publish_date_raw:string>")


def test_bucket_by_week_ages(spark):
    ages = ["2024-01-23T01:00:00", "2024-01-23T00:00:00", "2024-01-16T01:00:00", "2024-01-16T00:00:00",
            "2024-01-31T01:00:00"]     # 7d23h, 8d, 14d23h, 15d, -1h
    out = N.bucket_by_week(_notes(spark, ages), AS_OF).orderBy("seq").collect()
    assert [r["bucket"] for r in out] == ["week_1", "week_2", "week_2", "archived", "archived"]


def test_active_notifications_window(spark):
    dates = ["2024-01-29T00:01:00", "2024-01-29T00:00:00", "2024-02-05T00:00:00", "2024-01-30T00:00:00+02:00"]
    out = N.active_notifications(_notes(spark, dates), AS_OF).orderBy("seq").collect()
    assert [r["seq"] for r in out] == [0, 2]


def test_last_scrape_info(spark):
    out = N.last_scrape_info(A.notifications_events(spark, SF)).first()
    assert out["scrape_count"] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert out["new_items_this_session"] >= 1


def test_stop_after_stale_pages(spark):
    counts = [2, 0, 0, 1, 0, 0, 0, 5]
    df = spark.createDataFrame([("l", i + 1, 3, c) for i, c in enumerate(counts)] + [("m", 1, 2, 1), ("m", 2, 0, 0)],
                               "listing string, page int, n_items int, n_added int")
    kept = stop_after_stale_pages(df).collect()
    assert sorted(r["page"] for r in kept if r["listing"] == "l") == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r["page"] for r in kept if r["listing"] == "m") == [1]


def test_first_per_key_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq long, k string")
    once = first_per_key(df, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (3, "b")]
    assert sorted(map(tuple, first_per_key(once, ["k"], ["seq"]).collect())) == [(1, "a"), (3, "b")]


def test_upsert_keeps_store_timestamps(spark):
    ev = A.notifications_events(spark, SF)
    store = N.dedupe_notifications(ev.where(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz")))
    out = N.upsert_notifications(store, ev.where(F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp_ntz")),
                                 as_of=AS_OF)
    stamped = out.where(F.col("timestamp") == F.lit(AS_OF).cast("timestamp_ntz")).count()
    assert out.count() == store.count() + stamped
    assert N.dedupe_notifications(out).count() == out.count()


def test_ages_ignore_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        dates = ["2024-03-09T12:00:00", "2024-03-01T12:00:00"]
        out = N.bucket_by_week(_notes(spark, dates), "2024-03-11 12:00:00").orderBy("seq").collect()
        assert [r["age_days"] for r in out] == [2, 10]
        act = N.active_notifications(_notes(spark, ["2024-03-09T12:00:01"]), "2024-03-11 12:00:00").count()
        assert act == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sorted_order(spark):
    """The sort itself: newest first, undated last, ties in list order; previews follow it."""
    from pyspark.sql import functions as F

    from tidefeed.operators.ordering import head_preview, sort_newest
    rows = [(1, "2024-01-02"), (2, ""), (3, "January 05, 2024"), (4, "2024-01-02"), (5, "never")]
    df = spark.createDataFrame(rows, "seq long, release_date string").repartition(3)
    assert [r["seq"] for r in sort_newest(df, ["release_date"]).collect()] == [3, 1, 4, 2, 5]
    assert [r["seq"] for r in head_preview(df, 2, [F.desc("seq")]).collect()] == [5, 4]


def test_changed_items(spark):
    from tidefeed.operators.diff import compare_snapshots
    schema = "seq long, topic string, section string, identity string, link string"
    old = spark.createDataFrame([(1, "t", "s", "a", "x"), (2, "t", "s", "b", "x"), (3, "t", "s", "c", None)], schema)
    new = spark.createDataFrame([(1, "t", "s", "a", "y"), (2, "t", "s", "b", "x"), (3, "t", "s", "d", None)], schema)
    got = {r["identity"]: r["status"] for r in compare_snapshots(new, old, compare=["link"], fields=["link"]).collect()}
    assert got == {"a": "changed", "b": "kept", "c": "removed", "d": "added"}
    assert {r["identity"]: r["status"] for r in compare_snapshots(new, old).collect()}["a"] == "kept"


def test_positions_and_running_sums_over_ranges(spark):
    """Ties, nulls and one value that most rows share; the places are those of one sort."""
    from pyspark.sql import functions as F
    from tidefeed.operators.positions import with_positions, with_running_sum
    rows = [(None if k % 11 == 0 else 5 if k % 3 else k % 17, k, k % 4) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, k long, w long").repartition(7)
    order = [F.desc_nulls_last("a"), F.col("k")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = sorted(tuple(r) for r in with_positions(df, order).select("position", "a", "k", "w").collect())
    assert got == [(n, *r) for n, r in enumerate(want)]
    sums = {r.k: r.before for r in with_running_sum(df, order, "w", "before").collect()}
    total = 0
    for a, k, w in want:
        assert sums[k] == total
        total += w
    assert with_positions(df.limit(0), order).count() == 0
