"""Notification table IO: JSON list files in, deduplicated table out (and back)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.notifications import ITEM_STRING_FIELDS, dedupe_notifications
from ..operators.positions import with_running_sum
from .json_stream import PLACES, json_entries, sound_entries

NOTE_SCHEMA = StructType([
    StructField("type", StringType()), StructField("timestamp", StringType()),
    StructField("scrape_date", StringType()),
    StructField("item", StructType([StructField(f, StringType()) for f in ITEM_STRING_FIELDS])),
])


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``seq``: the given numbers, then numbers in the order of files and lines for rows without one.

    ``_file``, ``_start`` and ``_at`` say where a row was read: a file's part, and a number
    that rises by one from row to row of a part.  Parts are counted, one row each, and a
    row's number is the largest given one, the rows of all earlier parts and its place.
    """
    late = rows.where(F.col("seq").isNull())
    parts = late.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    parts = with_running_sum(parts, [F.col("_file"), F.col("_start")], "_rows", "_earlier").drop("_rows")
    given = rows.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).scalar()
    both = rows.join(parts, ["_file", "_start"], "left")
    place = given + F.col("_earlier") + F.col("_at") - F.col("_first")
    return both.withColumn("seq", F.coalesce("seq", place)).drop("_file", "_start", "_at", "_first", "_earlier")


def read_notifications(spark: SparkSession, path: str, *, layout: str = "lines") -> DataFrame:
    """Load notifications, self-heal duplicates, type the timestamps (bad ones -> NULL).

    ``layout='lines'``: one JSON object per line (the scalable store format).
    Lines without a ``seq`` come after those with one, in the order of their files
    and lines, however many splits and tasks read them.  ``layout='list'``: files holding
    one JSON list each (import format), read entry by entry; a payload that is not a list,
    and a file that is no JSON, gives no rows.
    """
    if layout == "lines":
        rows = spark.read.schema(StructType([*NOTE_SCHEMA.fields, StructField("seq", LongType())])).json(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                           F.monotonically_increasing_id().alias("_at"))
    else:
        found = sound_entries(json_entries(spark, path, (PLACES,)))
        rows = found.select(F.lit(None).cast("long").alias("seq"), F.col("file").alias("_file"), F.lit(0).cast("long").alias("_start"),
                            F.col("place").alias("_at"), F.from_json("entry", NOTE_SCHEMA).alias("n"))
        rows = rows.select("seq", "_file", "_start", "_at", "n.*")
    rows = (rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))
                .withColumn("scrape_date", F.col("scrape_date").try_cast("timestamp_ntz")))
    return dedupe_notifications(numbered(rows).select("seq", "type", "timestamp", "scrape_date", "item"))


def write_notifications(df: DataFrame, path: str, *, dedupe: bool = True) -> None:
    """Write the (deduplicated) table as JSON lines, one object per notification."""
    out = dedupe_notifications(df) if dedupe else df
    out.select("seq", "type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
               F.date_format("scrape_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scrape_date"),
               "item").write.mode("overwrite").json(path)
