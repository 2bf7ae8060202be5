"""Fitting a tree model on labelled documents, shared by the two quality operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import doc_stats as S
from .common import id_crc
from .gbt import FlatTrees, Params, train

#: Labels are learnt only where crc32(doc_id) mod 3 is not this remainder.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose label is never learnt from."""
    return id_crc(doc_id) % F.lit(FOLDS) == F.lit(HELD_OUT)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` labelled documents outside the held-out fold.

    The sample is the ``max_rows`` labelled ids with the smallest hash, so it is the
    same for any partitioning.  An id with several labels counts once, with the
    smallest; rows with a null id or label are left out.  Only the sampled ids (at
    most ``max_rows``, hence the broadcast) and their statistics reach the driver.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col(target).alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    ids = usable.groupBy("id").agg(F.min("label").cast("int").alias("label")).orderBy(
        F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(ids), "id")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(S.stats_matrix(batch["text"]), columns=list(S.COLUMNS))
            yield out.assign(id=batch["id"].to_numpy(), label=batch["label"].to_numpy())

    schema = ", ".join(f"{c} double" for c in S.COLUMNS) + ", id long, label int"
    sample = texts.mapInPandas(rows, schema).dropDuplicates(["id"]).toPandas().sort_values("id")
    return sample[list(S.COLUMNS)].to_numpy(float), sample["label"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, target: str, features: Sequence[str], max_rows: int,
        monotone: dict[str, int] | None = None, params: Params = Params()) -> FlatTrees:
    """Train on the labelled sample; ``features`` and ``monotone`` name columns of the statistics."""
    x, y = labelled_sample(docs, labels, target, max_rows)
    columns = [S.COLUMNS.index(f) for f in features]
    ways = {list(features).index(f): way for f, way in (monotone or {}).items()}
    return train(x[:, columns], y, params, ways)
