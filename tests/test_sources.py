"""Stores and import readers on small hand-written files."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tidefeed.sources.cache_io import extraction_table, read_summary_cache, upsert_cache
from tidefeed.sources.notifications_io import read_notifications
from tidefeed.sources.snapshots import is_first_snapshot, latest_snapshot, read_snapshot_json, read_snapshots, \
    write_snapshot


def _write(path, obj):
    with open(path, "w") as f:
        json.dump(obj, f)


def test_read_snapshot_json(spark):
    d = tempfile.mkdtemp(prefix="tf-snap-")
    _write(os.path.join(d, "qis.json"), {"data": {"publications": [{"document_name": "A", "link": "x"},
                                                                   {"document_name": "B"}],
                                                  "news": [{"title": "N"}]},
                                         "timestamp": "2025-01-01T00:00:00", "counts": {}})
    rows = read_snapshot_json(spark, d, "qis").orderBy("section", "seq").collect()
    assert [(r["section"], r["seq"], r["document_name"] or r["title"]) for r in rows] == \
           [("news", 0, "N"), ("publications", 0, "A"), ("publications", 1, "B")]
    assert read_snapshot_json(spark, os.path.join(d, "missing"), "qis").count() == 0


def test_snapshot_store_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tf-store-")
    items = spark.createDataFrame([(1, "qis", "news", "T1", "https://a/1"), (2, "qis", "news", "T1", "https://a/1/"),
                                   (3, "qis", "news", "T2", "")],
                                  "seq long, topic string, section string, title string, link string")
    counts = write_snapshot(items, os.path.join(d, "s"), as_of="2024-01-30 00:00:00").collect()
    assert [(r["section"], r["n"]) for r in counts] == [("news", 2)]
    write_snapshot(items.where("seq = 3"), os.path.join(d, "s"), as_of="2024-01-31 00:00:00")
    snaps = read_snapshots(spark, os.path.join(d, "s"))
    assert latest_snapshot(snaps, "qis").count() == 1
    assert is_first_snapshot(snaps, "ai").first()["is_first"] is True


def test_summary_cache_import(spark):
    d = tempfile.mkdtemp(prefix="tf-cache-")
    km = json.dumps({"domain": "crypto", "problem": "p", "method": "m", "results": "r", "significance": "s",
                     "keywords": "lattice, hash"})
    _write(os.path.join(d, "qis.json"), {"abc": {"timestamp": "2025-01-01T00:00:00", "summary": "One. Two."},
                                         "km_def": {"timestamp": "2025-01-02T00:00:00", "summary": km}})
    cache = read_summary_cache(spark, d, "qis")
    assert sorted(r["kind"] for r in cache.collect()) == ["item", "km"]
    kws = sorted(r["keywords"] for r in extraction_table(cache, "km").collect())
    assert kws == ["hash", "lattice"]
    newer = cache.where("kind = 'item'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")) \
                 .withColumn("summary", F.lit("Three."))
    merged = upsert_cache(cache, newer.unionByName(newer.withColumn("key", F.lit("zzz")).withColumn("summary", F.lit(""))))
    got = {r["key"]: r["summary"] for r in merged.collect()}
    assert got["abc"] == "Three." and "zzz" not in got


def test_read_notifications_list_layout(spark):
    d = tempfile.mkdtemp(prefix="tf-notes-")
    item = {"title": "T", "publish_date_raw": "2024-01-02"}
    _write(os.path.join(d, "a.json"), [
        {"type": "news", "timestamp": "2024-01-02T10:00:00", "scrape_date": "2024-01-02T10:00:00", "item": item},
        {"type": "News", "timestamp": "2024-01-03T10:00:00", "scrape_date": "2024-01-03T10:00:00", "item": item},
        {"type": "news", "timestamp": "not a date", "scrape_date": "x", "item": {"title": "U"}}])
    _write(os.path.join(d, "b.json"), {"not": "a list"})
    rows = read_notifications(spark, d, layout="list").collect()
    assert len(rows) == 2
    t = [r for r in rows if r["item"]["title"] == "T"][0]
    assert str(t["timestamp"]) == "2024-01-03 10:00:00"


def test_snapshot_json_corrupt_files(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="tf-flat-")
    _write(os.path.join(d, "good.json"), {"data": [{"document_name": "A"}, {"document_name": "B"}],
                                          "timestamp": "t", "count": 2})
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{not json")
    flat = read_snapshot_json(spark, d, "pqc", flat_section="publications")
    assert sorted(r["document_name"] for r in flat.collect()) == ["A", "B"]
    topic_dir = tempfile.mkdtemp(prefix="tf-topic-")
    with open(os.path.join(topic_dir, "bad.json"), "w") as f:
        f.write("{not json")
    with pytest.raises(Exception):
        read_snapshot_json(spark, topic_dir, "pqc").collect()


def test_second_write_of_a_snapshot_replaces_it(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="tf-twice-"), "s")
    items = spark.createDataFrame([(1, "qis", "news", "T1", "https://a/1")], "seq long, topic string, section string, title string, link string")
    for _ in range(2):
        counts = write_snapshot(items, d, as_of="2024-01-30 00:00:00").collect()
    assert [r["n"] for r in counts] == [1]
    write_snapshot(items, d, as_of="2024-01-31 00:00:00")
    assert read_snapshots(spark, d).count() == 2


def test_notification_lines_without_seq_and_twice(spark):
    d = tempfile.mkdtemp(prefix="tf-lines-")
    rows = [{"type": "news", "timestamp": "2024-01-02T10:00:00", "scrape_date": "x", "item": {"title": t, "summary": s}}
            for t, s in (("T", "first"), ("T", "second"), ("U", ""))]
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write("\n".join(map(json.dumps, [dict(rows[0], seq=7), rows[1], rows[2]])))
    for _ in range(2):
        got = {r["item"]["title"]: (r["seq"], r["item"]["summary"]) for r in read_notifications(spark, d).collect()}
        assert got["T"] == (7, "first") and got["U"][0] > 7
    assert read_notifications(spark, d, layout="list").count() == 0


def _shuffles_of(frame, table):
    """Exchanges between the scans of ``table`` and the join above them, and how many such scans there are."""
    above, found, scans = [], [], 0
    for line in frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines():
        name = line.lstrip(" :+-*()0123456789")
        at = len(line) - len(name)
        above = [(d, n) for d, n in above if d < at] + [(at, name)]
        if "Scan" in name and table in name:
            names = [n for _, n in above]
            join = max((i for i, n in enumerate(names) if "Join" in n), default=-1)
            found += [n for n in names[join + 1:] if n.startswith("Exchange")]
            scans += 1
    return found, scans


KEYED = "seq long, topic string, section string, identity string, title string, link string"


def test_keyed_snapshot_is_not_shuffled_by_diffs(spark):
    from tidefeed.operators.diff import compare_snapshots, has_changed, new_items
    from tidefeed.sources.snapshots import keyed_snapshots, open_keyed_snapshot, stored_counts, write_keyed_snapshot
    path = tempfile.mkdtemp(prefix="tf-keyed-")
    old = spark.createDataFrame([(i, "qis", "news" if i % 2 else "publications", f"k{i % 40}", f"T{i}", "") for i in range(60)], KEYED)
    cur = spark.createDataFrame([(i, "qis", "news" if i % 2 else "publications", f"k{i}", f"T{i}", "x") for i in range(30, 50)], KEYED)
    counts = write_keyed_snapshot(old, path, as_of="2024-01-30 00:00:00").orderBy("section").collect()
    assert [tuple(r) for r in counts] == [("qis", "news", 20), ("qis", "publications", 20)]
    assert stored_counts(spark, path).count() == 2 and keyed_snapshots(spark, path) == ["2024-01-30T00-00-00"]
    stored = open_keyed_snapshot(spark, path)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # plan as for large tables
    fresh = new_items(cur, stored, merged=True)
    assert sorted(r.identity for r in fresh.collect()) == [f"k{i}" for i in range(40, 50)]
    for diff in (fresh, compare_snapshots(cur, stored, merged=True), compare_snapshots(cur, stored, compare=["link"], merged=True),
                 has_changed(cur, stored, group_cols=("topic", "section"))):
        assert _shuffles_of(diff, "tidefeed_snapshot_") == ([], 1), diff._jdf.queryExecution().executedPlan().toString()
    assert has_changed(cur, stored, group_cols=("topic", "section")).first()["changed"] is True
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    # another session opens it by its description alone
    other = spark.newSession()
    for t in other.catalog.listTables():
        other.sql(f"DROP TABLE IF EXISTS {t.name}")
    again = open_keyed_snapshot(other, path)
    assert again.count() == 40
    assert open_keyed_snapshot(spark, path, "2024-02-01 00:00:00") is None
    assert open_keyed_snapshot(spark, path + "/none") is None and stored_counts(spark, path + "/none").count() == 0


def test_a_snapshot_without_its_description_does_not_count(spark, monkeypatch):
    import pytest
    from tidefeed.sources import snapshots
    path = tempfile.mkdtemp(prefix="tf-half-")
    items = spark.createDataFrame([(1, "qis", "news", "a", "T", "")], KEYED)
    snapshots.write_keyed_snapshot(items, path, as_of="2024-01-30 00:00:00", buckets=2)
    write = snapshots.write_text

    def dies(*a):
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshots, "write_text", dies)
    with pytest.raises(RuntimeError, match="killed"):
        snapshots.write_keyed_snapshot(items, path, as_of="2024-01-31 00:00:00", buckets=2)
    assert snapshots.keyed_snapshots(spark, path) == ["2024-01-30T00-00-00"]
    monkeypatch.setattr(snapshots, "write_text", write)
    snapshots.write_keyed_snapshot(items, path, as_of="2024-01-31 00:00:00", buckets=2)
    assert len(snapshots.keyed_snapshots(spark, path)) == 2 and snapshots.open_keyed_snapshot(spark, path).count() == 1


def test_cache_store_rewrites_changed_buckets_only(spark):
    from tidefeed.sources.cache_io import cache_store, clean_cache, expire_cache, put_cache
    store = cache_store(spark, tempfile.mkdtemp(prefix="tf-store-") + "/c", buckets=4)

    def entries(*rows):
        return spark.createDataFrame([(t, k, "item", ts, s) for t, k, ts, s in rows], "topic string, key string, kind string, ts string, summary string").withColumn(
            "ts", F.col("ts").cast("timestamp_ntz"))

    def now():
        return {r.key: r.summary for r in store.read().collect()}

    good = "The study measures how lattice keys are exchanged between two parties."
    first = entries(*[("qis", f"k{i}", f"2024-01-{10 + i} 00:00:00", good) for i in range(12)], ("qis", "k0", "2024-01-09 00:00:00", "older"), ("qis", "e", None, ""))
    assert put_cache(store, first) and now() == {f"k{i}": good for i in range(12)}
    version = store.manifest().version
    assert not put_cache(store, first) and store.manifest().version == version
    assert put_cache(store, entries(("qis", "k3", "2024-02-01 00:00:00", "Two.")))
    changed = [b for b, v in store.manifest().parts.items() if v == [version + 1]]
    assert len(changed) == 1 and now()["k3"] == "Two."
    oldest = dict(store.manifest().oldest)
    assert expire_cache(store, "2024-01-12 00:00:00") == sum(ts < "2024-01-12" for ts in oldest.values()) > 0
    assert set(now()) == {f"k{i}" for i in range(2, 12)}
    assert expire_cache(store, "2024-01-12 00:00:00") == 0
    assert put_cache(store, entries(("ai", "bad", "2024-02-01 00:00:00", "x")))
    assert clean_cache(store) >= 1 and "bad" not in now() and clean_cache(store) == 0


def test_lines_keep_their_order_over_hundreds_of_splits(spark):
    """Numbers of rows without one follow files and lines, past 128 partitions too."""
    d = tempfile.mkdtemp(prefix="tf-splits-")
    for name, part in (("b", range(700, 900)), ("a", range(700))):
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            for k in part:
                f.write(json.dumps({"type": "news", "timestamp": "2024-01-02T10:00:00", "scrape_date": "x", "item": {"title": f"t{k:05d}"}}) + "\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "400")
        spark.conf.set(keys[1], "0")
        assert spark.read.text(d).rdd.getNumPartitions() > 129
        got = [(r.seq, r.item["title"]) for r in read_notifications(spark, d).orderBy("seq").collect()]
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert got == [(k, f"t{k:05d}") for k in range(900)]


def test_cache_writes_equal_upserts_of_the_whole_cache(spark):
    """Null and repeated keys, entries of one time, entries that change nothing."""
    import random
    from tidefeed.sources.cache_io import CACHE_COLUMNS, cache_store, put_cache
    made = random.Random(11)
    store = cache_store(spark, tempfile.mkdtemp(prefix="tf-store-") + "/c", buckets=4)
    held = _cache(spark, [])
    for size in (60, 40, 3, 80):
        rows = [(made.choice(["ai", "qis", None]), made.choice([None, *"abcdefghijkl"]), made.choice(["item", "km", None]), made.choice(
            [None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"]), made.choice(["", None, "One.", "Two.", "x" * 50 + "a", "x" * 50 + "b"])) for _ in range(size)]
        new = _cache(spark, rows)
        held = _cache(spark, [tuple(r) for r in upsert_cache(held, new).selectExpr("topic", "key", "kind", "cast(ts as string)", "summary").collect()])
        put_cache(store, new)
        version = store.manifest().version
        assert sorted(map(str, store.read().select(*CACHE_COLUMNS).collect())) == sorted(map(str, held.collect()))
        assert not put_cache(store, new) and store.manifest().version == version


def _cache(spark, rows):
    return spark.createDataFrame(rows, "topic string, key string, kind string, ts string, summary string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
