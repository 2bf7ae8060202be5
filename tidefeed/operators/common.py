"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add column ``name`` computed exactly once per row.

    Catalyst may inline a projected expression into every later reference
    (and into pushed-down filters), re-running it per reference.  Routing it
    through a one-element ``explode`` makes it the output of a Generate node,
    which later projections can only reference, never inline.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))
