"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are trained once on a bounded labelled sample and flattened into node
arrays; every document is then scored whole by vectorised traversal, in the same
scan that reads it (no shuffle, memory bounded by one Arrow batch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import doc_stats as S
from .gbt import FlatTrees
from .quality_model import fit, held_out

FEATURES = S.SHARES
#: Bound of the labelled sample the trees are fitted on.
MAX_LABELLED_ROWS = 20_000
THRESHOLD = 0.5


def fit_classifier(docs: DataFrame, labels: DataFrame, target: str = "quality",
                   max_rows: int = MAX_LABELLED_ROWS) -> FlatTrees:
    """Train on labelled documents outside the held-out fold (see ``labelled_sample``)."""
    return fit(docs, labels, target, FEATURES, max_rows)


def score_column(model: FlatTrees, text: Column) -> Column:
    """Score of each text in [0, 1]; a null or empty text gets the score of an empty text."""
    columns = [S.COLUMNS.index(f) for f in FEATURES]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.probability(S.stats_matrix(texts)[:, columns]), dtype=np.float64)

    return score(text)


def classify(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, repeated rows included.

    A null id counts as not held out unless crc32 of the empty text says so; an
    empty table gives an empty result; other columns are ignored.
    """
    scored = docs.select(F.col("doc_id"), score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, that the classifier accepts."""
    return docs.where(score_column(model, F.col("text")) >= THRESHOLD)
