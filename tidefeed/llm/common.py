"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: A word everywhere in this subpackage: a maximal run without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Bytes of one Arrow batch between Spark and a Python worker, and Spark's own default.
BATCH_BYTES, _DEFAULT_BYTES = "8388608b", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of long texts hold 8 MB instead of Spark's 64 (a value the user set stays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, _DEFAULT_BYTES) == _DEFAULT_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read by Spark (the path may be in any store Spark reads)."""
    small_batches(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and go on from the copy.

    Cuts lineage at files every executor can read, so work done so far survives
    the loss of executors.
    """
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, f"llm-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sliced(texts: pd.Series, size: int) -> Iterator[pd.Series]:
    """A batch in parts, so that a task holds the results of a part and not of a whole batch."""
    for at in range(0, max(len(texts), 1), size):
        yield texts.iloc[at:at + size]


def id_crc(column: str) -> Column:
    """crc32 of the id written as text (null ids: crc32 of the empty string)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
