"""Snapshot comparison: new items, change test, append, union of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import item_identity
from .merge import merge_items


def _with_identity(df: DataFrame, key: str) -> DataFrame:
    return df if key in df.columns else df.withColumn(key, item_identity())


def new_items(current: DataFrame, previous: DataFrame, *, key: str = "identity",
              group_cols: Sequence[str] = ("topic", "section"), merged: bool = False,
              **merge_opts) -> DataFrame:
    """Rows of ``current`` whose identity is absent from ``previous`` (per topic and section).

    The current side is merged first (one row per identity); of the previous side only
    the distinct identities matter, so nothing else of it is read or shuffled.
    """
    keys = [*group_cols, key]
    known = _with_identity(previous, key).select(*keys).distinct()
    cur = _with_identity(current, key)
    if not merged:
        cur = merge_items(cur, key=key, group_cols=group_cols, **merge_opts)
    return cur.join(known, on=keys, how="left_anti")


def compare_snapshots(current: DataFrame, previous: DataFrame, *, key: str = "identity",
                      group_cols: Sequence[str] = ("topic", "section"), compare: Sequence[str] = (),
                      merged: bool = False, **merge_opts) -> DataFrame:
    """Full outer join of the two identity sets with a ``status`` column.

    ``added``, ``removed`` and ``kept``; with fields to ``compare``, an identity on both
    sides whose merged fields differ is ``changed``.  Fields are merged and shuffled
    only when they are compared.
    """
    keys = [*group_cols, key]

    def side(df: DataFrame, name: str) -> DataFrame:
        df = _with_identity(df, key)
        if not compare:
            return df.select(*keys).distinct().withColumn(name, F.struct(F.lit(True).alias("there")))
        if not merged:
            df = merge_items(df, key=key, group_cols=group_cols, **merge_opts)
        return df.select(*keys, F.struct(F.lit(True).alias("there"), *compare).alias(name))

    joined = side(current, "_cur").join(side(previous, "_prev"), on=keys, how="full_outer")
    status = (F.when(F.col("_prev").isNull(), F.lit("added"))
               .when(F.col("_cur").isNull(), F.lit("removed"))
               .when(~F.col("_cur").eqNullSafe(F.col("_prev")), F.lit("changed"))
               .otherwise(F.lit("kept")))
    return joined.select(*keys, status.alias("status"))


def has_changed(current: DataFrame, previous: DataFrame, *, key: str = "identity",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """One row ``(changed)``: the identity sets differ."""
    diff = compare_snapshots(current, previous, key=key, group_cols=group_cols)
    return diff.agg(F.coalesce(F.max(F.col("status") != "kept"), F.lit(False)).alias("changed"))


def append_new(existing: DataFrame, new: DataFrame, *, key: str = "document_name",
               seq: str = "seq") -> DataFrame:
    """Append rows whose ``key`` is not in ``existing``; the new batch is deduped on ``key`` too.

    Rows of ``existing`` are kept as they are, duplicates included.
    """
    from .dedupe import first_per_key
    fresh = first_per_key(new, [F.coalesce(F.col(key), F.lit(""))], [seq])
    fresh = fresh.join(existing.select(F.coalesce(F.col(key), F.lit("")).alias("_k")).distinct(),
                       F.coalesce(fresh[key], F.lit("")) == F.col("_k"), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Concatenate per-source frames, missing columns as NULL."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
