"""What a commit or a batch costs: rows of one bucket are dealt over tasks, untouched rows are not folded again, nor keys that come once."""

import glob
import tempfile

from pyspark.sql import functions as F

from tidefeed.sources import cache_io
from tidefeed.sources.bucket_store import BucketStore
from tidefeed.streaming import streams


def test_a_large_bucket_is_written_by_several_tasks(spark):
    path = tempfile.mkdtemp(prefix="tf-store-") + "/t"
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        store = BucketStore(spark, path, ["k"], 2)
        rows = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        store.commit(rows, [0, 1])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert all(len(glob.glob(f"{path}/data/*/bucket={b}/*.parquet")) > 2 for b in (0, 1))
    assert store.read().agg(F.count("k"), F.sum("k")).first() == (20_000, 19_999 * 10_000)


def test_only_identities_of_the_batch_are_folded(spark, monkeypatch):
    item = "struct<title:string,link:string,publish_date_raw:string>"
    path = tempfile.mkdtemp(prefix="tf-upsert-") + "/t"
    folded = []
    whole = streams.dedupe_notifications
    monkeypatch.setattr(streams, "dedupe_notifications", lambda rows: folded.append(rows.count()) or whole(rows))

    def batch(numbers):
        rows = [(n, "news", ("", f"a {n % 10}", "")) for n in numbers]
        return spark.createDataFrame([(s, t, (f"item {s % 10}", i[1], i[2])) for s, t, i in rows], f"seq long, type string, item {item}").select(
            "seq", "type", F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("scrape_date"), "item")

    streams.upsert_batch(batch(range(10)), 0, path, buckets=1, stream="s")
    streams.upsert_batch(batch([10, 11, 21]), 1, path, buckets=1, stream="s")
    assert folded == [10, 5]  # three new rows and the two stored ones of their identities
    assert sorted(r.seq for r in streams.latest_table(spark, path).collect()) == list(range(10))


def test_only_cache_keys_that_come_again_are_folded(spark, monkeypatch):
    store = cache_io.cache_store(spark, tempfile.mkdtemp(prefix="tf-cache-") + "/t", buckets=2)
    folded = []
    whole = cache_io.first_per_key
    monkeypatch.setattr(cache_io, "first_per_key", lambda rows, *a: folded.append(rows.count()) or whole(rows, *a))

    def entries(numbers, day):
        return spark.createDataFrame([(n % 100,) for n in numbers], "n int").select(
            F.lit("qis").alias("topic"), F.col("n").cast("string").alias("key"), F.lit("item").alias("kind"),
            F.lit(day).cast("timestamp_ntz").alias("ts"), F.lit("A text.").alias("summary"))

    assert cache_io.put_cache(store, entries(range(102), "2024-01-01"))
    assert cache_io.put_cache(store, entries(range(50), "2024-01-02"))
    assert folded == [4, 0]  # of two keys with two entries
    assert sorted(str(r.ts)[:10] for r in store.read().collect()) == ["2024-01-01"] * 50 + ["2024-01-02"] * 50
