"""Quality rules: base rules, then boosted trees with monotonic constraints.

The trees score document statistics; symbol, repetition and capital shares may
only lower a score, so a text never gains by adding junk.  Trees are flattened
into numpy node arrays and scored in the scan that reads the texts (no shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import doc_stats as S
from .gbt import FlatTrees, Params
from .quality_model import fit

#: The base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "echo_share", "digit_share", "bang_share", "stop_share")
#: Statistics that may only lower the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
            "echo_share": -1, "bang_share": -1}
#: Bound of the labelled sample the trees are fitted on.
MAX_LABELLED_ROWS = 20_000
THRESHOLD = 0.5

_SCHEMA = ", ".join(f"{c} long" for c in S.COUNTS) + ", rule_score double"


def fit_rules(docs: DataFrame, labels: DataFrame, target: str = "quality",
              max_rows: int = MAX_LABELLED_ROWS) -> FlatTrees:
    """Train the constrained trees on labelled documents outside the held-out fold."""
    return fit(docs, labels, target, FEATURES, max_rows, MONOTONE, Params(trees=50, depth=3))


def rules_column(model: FlatTrees, text: Column) -> Column:
    """Struct of the base counts and the trees' score; null and empty texts have zero counts."""
    columns = [S.COLUMNS.index(f) for f in FEATURES]

    @F.pandas_udf(_SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            x = S.stats_matrix(texts)
            out = pd.DataFrame(x[:, :len(S.COUNTS)].astype("int64"), columns=list(S.COUNTS))
            yield out.assign(rule_score=model.probability(x[:, columns]))

    return judge(text)


def _verdict(stats: Column) -> tuple[Column, Column]:
    failed = (stats["n_words"] < MIN_WORDS) | (
        100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])
    return failed, ~failed & (stats["rule_score"] >= THRESHOLD)


def judge(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``kept`` and ``rule_score``.

    Null and empty texts have no words, so they fail the base rules; repeated rows
    are judged one by one; an empty table gives an empty result; other columns are ignored.
    """
    stats = docs.select("doc_id", rules_column(model, F.col("text")).alias("s"))
    failed, kept = _verdict(F.col("s"))
    return stats.select("doc_id", *(F.col("s")[c].alias(c) for c in S.COUNTS),
                        failed.alias("base_failed"), kept.alias("kept"), F.col("s")["rule_score"].alias("rule_score"))


def keep_passing(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, that pass the base rules and the trees."""
    _, kept = _verdict(rules_column(model, F.col("text")))
    return docs.where(kept)
