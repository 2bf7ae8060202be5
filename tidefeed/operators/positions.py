"""Places of rows in a total order, without one task that sees all rows.

Rows are dealt into ranges of the order and sorted inside each; a row's place is the
number of rows in earlier ranges plus its place in its own.  Only one count per range
meets anywhere, and there are as many ranges as the session's shuffles have partitions.
Range borders come from a sample, so the dealt rows are written once and read back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PART, _AT, _BEFORE = "_range", "_at_in_range", "_before_range"


def _before(rows: DataFrame, weight: Column) -> DataFrame:
    """Sum of ``weight`` in all earlier ranges, one row per range."""
    totals = rows.groupBy(_PART).agg(F.sum(weight).alias("_total"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(_PART, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(_BEFORE))


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` sorted, with each row's place (from 0) in the order; equal rows keep any order among them."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(_AT))
    kept = materialize(dealt)
    placed = kept.join(_before(kept, F.lit(1)), _PART)
    return placed.select(*df.columns, (F.col(_BEFORE) + F.col(_AT)).alias(name))


def with_running_sum(df: DataFrame, order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows that come earlier in the order."""
    kept = materialize(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias(_PART)))
    inside = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn(_AT, F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(_before(kept, F.col(weight)), _PART)
    return placed.select(*df.columns, (F.col(_BEFORE) + F.col(_AT)).alias(name))
