"""Keys of one table marked in another by a bitmap of fixed size, so that long rows are not shuffled to be told apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap (8 MB, broadcast, whatever the number of rows).
BITS = 1 << 26


def _slot(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def split_by_keys(rows: DataFrame, named: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be one of ``named``, with all rows of that key, and the others."""
    marks = named.select(_slot(keys).alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    placed = rows.withColumn("_slot", _slot(keys))
    found = placed.join(F.broadcast(marks), F.bitmap_bucket_number("_slot") == F.col("_n"), "left")
    place = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return found.where(is_set).select(*rows.columns), found.where(~is_set).select(*rows.columns)


def not_among(rows: DataFrame, others: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` (nulls are equal) no row of ``others`` has.

    An outer join, as Spark moves an anti-join below the steps that keep long rows out of it.
    """
    there = others.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct().withColumn("_there", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return rows.join(there, same, "left").where(F.col("_there").isNull()).select(*rows.columns)
