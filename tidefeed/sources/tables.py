"""Readers for the given parquet tables (column-pruned, filters pushed to the scan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``spark.read.parquet`` of one table; ``columns`` prunes the scan's ReadSchema.

    How a table is split is left to the session (``spark.sql.files.*``).
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page source ``(page_id, url, html)``; pages arrive as a table, not over HTTP."""
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
