"""Snapshot store: a partitioned parquet table ``(topic, section, snapshot_ts, item...)``.

``write_snapshot`` appends one snapshot (merged by identity unless told not
to) and ``latest_snapshot`` reads the newest one of a topic; the partition
filter prunes every older snapshot directory.  ``read_snapshot_json`` imports
the JSON envelopes ``{data: {section: [items]}, timestamp, counts}`` (or flat
``{data: [items], timestamp, count}``) one row per item with its list position.

``write_keyed_snapshot`` writes a snapshot as a bucketed table: rows dealt by their diff
keys into as many files as a shuffle has partitions.  A diff against it joins each file
with the partition of the current side that has its keys, so the stored side, the large
one, is never shuffled or read twice.  Counts per section are stored beside it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.merge import merge_items
from ..session import file_names, read_text, write_text
from .json_stream import ANY, PLACES, all_entries, json_entries, sound_entries

# Canonical item fields (all strings; '' or NULL means missing).
ITEM_FIELDS = (
    "document_name", "title", "document_number", "series", "status", "resource_type", "link",
    "summary", "abstract", "description", "category",
    "release_date", "release_date_raw", "edited_date", "edited_date_raw", "publish_date",
    "publish_date_raw", "last_edited_date", "last_edited_date_raw", "comment_due_date",
    "comment_due_date_raw",
)

SECTIONS = ("publications", "presentations", "news", "projects")
ITEM_SCHEMA = StructType([StructField(f, StringType()) for f in ITEM_FIELDS])


def write_snapshot(items: DataFrame, path: str, *, as_of: str, dedupe: bool = True,
                   group_cols=("topic", "section")) -> DataFrame:
    """Write a snapshot; returns its per-section counts (an aggregate, not stored).

    Only the partitions of this ``as_of`` are replaced, so a job that is run again
    leaves one copy and every other snapshot stays.
    """
    out = items
    if dedupe:
        fields = [c for c in items.columns if c not in (*group_cols, "seq", "identity")]
        out = merge_items(items, group_cols=group_cols, fields=fields)
    stamp = as_of.replace(" ", "T").replace(":", "-")
    out = out.withColumn("snapshot_ts", F.lit(stamp))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*group_cols, "snapshot_ts").parquet(path))
    written = out.sparkSession.read.parquet(path).where(F.col("snapshot_ts") == stamp)
    return written.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))


#: Keys by which snapshots are compared.
DIFF_KEYS = ("topic", "section", "identity")
_ABOUT = "_about.json"


def _stamp(as_of: str) -> str:
    return as_of.replace(" ", "T").replace(":", "-")


def _table_name(location: str) -> str:
    return "tidefeed_snapshot_" + hashlib.md5(location.encode()).hexdigest()


def write_keyed_snapshot(items: DataFrame, path: str, *, as_of: str, dedupe: bool = True, buckets: int | None = None,
                         keys: Sequence[str] = DIFF_KEYS) -> DataFrame:
    """Write one snapshot below ``path`` bucketed by ``keys``; returns its stored counts by topic and section.

    ``buckets`` is the session's number of shuffle partitions unless given; a diff under
    the same number needs no shuffle of merged rows either.  A snapshot counts from the
    moment its description is written, which comes last, so a crash leaves none.
    """
    spark = items.sparkSession
    out = items
    if dedupe:
        fields = [c for c in items.columns if c not in (*keys, "seq")]
        out = merge_items(items, group_cols=[k for k in keys if k != "identity"], fields=fields)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    location = f"{path.rstrip('/')}/{_stamp(as_of)}"
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(location)}")
    (out.repartition(buckets, *keys).write.mode("overwrite").option("path", location)
        .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(_table_name(location)))
    counts = spark.table(_table_name(location)).groupBy("topic", "section").agg(F.count(F.lit(1)).alias("n"))
    about = {"keys": list(keys), "buckets": buckets, "schema": out.schema.jsonValue(),
             "counts": [list(r) for r in counts.collect()]}  # one row per section
    write_text(spark, f"{location}/{_ABOUT}", json.dumps(about))
    return stored_counts(spark, path, as_of)


def keyed_snapshots(spark: SparkSession, path: str) -> list[str]:
    """Stamps of the complete snapshots below ``path``, oldest first."""
    return sorted(s for s in file_names(spark, path) if _ABOUT in file_names(spark, f"{path.rstrip('/')}/{s}"))


def _about(spark: SparkSession, path: str, as_of: str | None) -> tuple[str, dict] | None:
    complete = keyed_snapshots(spark, path)
    stamp = _stamp(as_of) if as_of else (complete or [None])[-1]
    if stamp not in complete:
        return None
    location = f"{path.rstrip('/')}/{stamp}"
    return location, json.loads(read_text(spark, f"{location}/{_ABOUT}"))


def open_keyed_snapshot(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame | None:
    """A stored snapshot (the newest one unless named) as a bucketed table; None where there is none."""
    found = _about(spark, path, as_of)
    if found is None:
        return None
    location, about = found
    name = _table_name(location)
    if not spark.catalog.tableExists(name):  # another session wrote it
        schema = StructType.fromJson(about["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{k}`" for k in about["keys"])
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                  f"INTO {about['buckets']} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def stored_counts(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """Rows per topic and section of a stored snapshot, as written with it."""
    found = _about(spark, path, as_of)
    return spark.createDataFrame([tuple(r) for r in found[1]["counts"]] if found else [], "topic string, section string, n long")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_snapshot(snapshots: DataFrame, topic: str) -> DataFrame:
    """Rows of the newest snapshot of ``topic`` (empty when there is none: first run)."""
    of_topic = snapshots.where(F.col("topic") == topic)
    newest = of_topic.select(F.max("snapshot_ts")).scalar()
    return of_topic.where(F.col("snapshot_ts") == newest)


def is_first_snapshot(snapshots: DataFrame, topic: str) -> DataFrame:
    """One row ``(is_first)``: no earlier snapshot exists for the topic."""
    return snapshots.where(F.col("topic") == topic).agg((F.count(F.lit(1)) == 0).alias("is_first"))


def read_snapshot_json(spark: SparkSession, path: str, topic: str, *, flat_section: str | None = None, folders: bool = False) -> DataFrame:
    """Items of JSON snapshot envelopes with ``seq`` = list position (order is meaning).

    A missing path gives an empty frame.  Corrupt files: the flat reader
    (``flat_section`` set) skips them, the topic reader raises.  Items are read one by
    one (``json_stream``), and a large envelope by many tasks.  With ``folders`` an
    envelope is a folder of files that follow one another by name.
    """
    out_schema = StructType([StructField("topic", StringType()), StructField("section", StringType()),
                             StructField("seq", LongType()), *ITEM_SCHEMA.fields])
    try:
        entries = json_entries(spark, path, ("data", PLACES) if flat_section else ("data", ANY, PLACES), folders=folders)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e).lower():
            return spark.createDataFrame([], out_schema)
        raise
    found = sound_entries(entries) if flat_section else all_entries(entries)
    section = F.lit(flat_section) if flat_section else F.element_at("keys", -1)
    items = found.select(section.alias("section"), F.col("place").alias("seq"), F.from_json("entry", ITEM_SCHEMA).alias("it"))
    return items.select(F.lit(topic).alias("topic"), "section", "seq", "it.*")
