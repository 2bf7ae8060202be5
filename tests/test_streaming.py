"""Streaming forms against their batch answers on split input files."""

import tempfile
import uuid

from pyspark.sql import functions as F

from tidefeed.operators.notifications import with_nid
from tidefeed.plans import adapters as A
from tidefeed.streaming.streams import stream_new_items

SF = "/root/testdata/sf0.001"


def _feed(spark):
    src = tempfile.mkdtemp(prefix="tf-feed-")
    ev = A.notifications_events(spark, SF)
    (ev.withColumn("_day", F.to_date("timestamp")).repartition("_day").sortWithinPartitions("seq")
       .write.mode("overwrite").partitionBy("_day").json(src))
    return ev, spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 3).json(src)


def _run(spark, sdf):
    name = f"t_{uuid.uuid4().hex[:8]}"
    q = (sdf.writeStream.format("memory").queryName(name)
            .option("checkpointLocation", tempfile.mkdtemp(prefix="tf-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def test_stream_new_items_equals_batch(spark):
    ev, sdf = _feed(spark)
    got = _run(spark, stream_new_items(sdf))
    expected = with_nid(ev).select("nid").distinct()
    assert got.count() == expected.count()
    assert got.select("nid").exceptAll(expected).count() == 0


def test_stream_new_items_with_horizon(spark):
    ev, sdf = _feed(spark)
    got = _run(spark, stream_new_items(sdf, horizon="48 hours"))
    expected = with_nid(ev).select("nid").distinct()
    assert sorted(r["nid"] for r in got.select("nid").collect()) == sorted(r["nid"] for r in expected.collect())


def _table(spark, path):
    from tidefeed.streaming.streams import latest_table
    rows = latest_table(spark, path).select("nid", "seq", "type", "timestamp", "scrape_date", F.to_json("item").alias("item"))
    return sorted(map(tuple, rows.collect()), key=str)


def test_upserts_do_not_depend_on_batches_and_may_be_replayed(spark):
    from tidefeed.streaming.streams import upsert_batch
    ev = A.notifications_events(spark, SF).where("seq < 400")
    base = tempfile.mkdtemp(prefix="tf-upsert-")
    whole, split = f"{base}/whole", f"{base}/split"
    upsert_batch(ev, 0, whole, buckets=4)
    for n, part in enumerate([ev.where("seq % 3 = 1"), ev.where("seq % 3 = 0"), ev.where("seq % 3 = 0"), ev.where("seq % 3 = 2")]):
        upsert_batch(part, n, split, buckets=4)
    assert _table(spark, whole) == _table(spark, split)
    upsert_batch(ev.where("seq % 3 = 2"), 3, split, buckets=4)
    assert _table(spark, whole) == _table(spark, split)


def _stored(spark, path):
    from tidefeed.streaming.streams import latest_table
    return sorted((r.nid, r.seq, r.batch_id) for r in latest_table(spark, path).collect())


def test_first_seen_never_forgets_and_may_be_replayed(spark):
    from tidefeed.sources import bucket_store
    from tidefeed.streaming.streams import first_seen_batch
    ev = A.notifications_events(spark, SF).where("seq < 300").withColumn("item", F.col("item").withField("publish_date_raw", F.lit("")))
    path = f"{tempfile.mkdtemp(prefix='tf-seen-')}/t"
    expected, seen = [], set()
    parts = 2 * bucket_store.MAX_PARTS
    for n in range(parts):  # more appends than a bucket keeps apart
        part = ev.where(f"seq % {parts} = {n}")
        for r in with_nid(part).groupBy("nid").agg(F.min("seq").alias("seq")).collect():
            if r.nid not in seen:
                seen.add(r.nid)
                expected.append((r.nid, r.seq, n))
        first_seen_batch(part, n, path, buckets=2, stream="s")
        if n in (3, 7):
            first_seen_batch(part, n, path, buckets=2, stream="s")
            first_seen_batch(part, n, path, buckets=2)
    assert _stored(spark, path) == sorted(expected)
    store = bucket_store.BucketStore(spark, path, ["nid"], 2)
    assert all(len(v) <= bucket_store.MAX_PARTS for v in store.manifest().parts.values())


def test_a_crash_during_an_upsert_loses_nothing(spark, monkeypatch):
    """The job dies after its files are written and before they are published; readers keep the version before."""
    import pytest
    from tidefeed.sources.bucket_store import BucketStore
    from tidefeed.streaming.streams import upsert_batch
    ev = A.notifications_events(spark, SF).where("seq < 400")
    base = tempfile.mkdtemp(prefix="tf-crash-")
    whole, path = f"{base}/whole", f"{base}/t"
    upsert_batch(ev, 0, whole, buckets=4)
    upsert_batch(ev.where("seq % 2 = 0"), 0, path, buckets=4, stream="s")
    before = _table(spark, path)
    publish = BucketStore._publish

    def dies(self, manifest):
        raise RuntimeError("killed")

    monkeypatch.setattr(BucketStore, "_publish", dies)
    with pytest.raises(RuntimeError, match="killed"):
        upsert_batch(ev.where("seq % 2 = 1"), 1, path, buckets=4, stream="s")
    assert _table(spark, path) == before
    monkeypatch.setattr(BucketStore, "_publish", publish)
    upsert_batch(ev.where("seq % 2 = 1"), 1, path, buckets=4, stream="s")
    assert _table(spark, path) == _table(spark, whole)
    store = BucketStore(spark, path, ["nid"], 4)
    version = store.manifest().version
    upsert_batch(ev.where("seq % 2 = 1"), 1, path, buckets=4, stream="s")  # replayed: already part of the table
    assert store.manifest().version == version


def test_a_killed_process_leaves_the_stored_version(spark):
    """A real process is ended between writing files and publishing them."""
    import subprocess
    import sys
    from tidefeed.sources.bucket_store import BucketStore
    path = f"{tempfile.mkdtemp(prefix='tf-kill-')}/t"
    store = BucketStore(spark, path, ["k"], 2)
    store.commit(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), [0, 1])
    code = f"""
import os
from tidefeed.session import get_spark
from tidefeed.sources.bucket_store import BucketStore
spark = get_spark(master="local[1]", shuffle_partitions=1)
BucketStore._publish = lambda self, manifest: os._exit(9)
BucketStore(spark, {path!r}, ["k"], 2).commit(spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "k string, n int"), [0, 1])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], timeout=300, capture_output=True)
    assert done.returncode == 9
    assert sorted(map(tuple, store.read().select("k", "n").collect())) == [("a", 1), ("b", 1)]
    store.commit(spark.createDataFrame([("a", 3)], "k string, n int"), store.touched(spark.createDataFrame([("a",)], "k string")))
    assert sorted(map(tuple, store.read().select("k", "n").collect())) == [("a", 3), ("b", 1)]
