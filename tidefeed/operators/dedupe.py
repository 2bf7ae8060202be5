"""First-row-per-key deduplication, expressed as aggregates (no window, no hot task).

"Keep the first row per key" is ``min(struct(order..., row))`` per key: Spark
computes it as a partial aggregate on each map task and merges one struct per
task per key, so even a key holding a third of all rows costs one small merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import display_key, sidebar_key
from ..functions.links import link_score_typed


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str],
                  *, key_names: Sequence[str] | None = None) -> DataFrame:
    """Keep, per key, the row that sorts first by ``order`` (ascending)."""
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    names = list(key_names) if key_names else [f"_k{i}" for i in range(len(key_cols))]
    payload = [c for c in df.columns]
    order_cols = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*order_cols, F.struct(*[F.col(c) for c in payload]).alias("_row")))
    grouped = df.groupBy(*[k.alias(n) for k, n in zip(key_cols, names)]).agg(best.alias("_best"))
    return grouped.select("_best._row.*")


def _keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], seq: str) -> DataFrame:
    """Keep, per key, the row that sorts first; ``seq`` is unique.

    The aggregate carries only key and order, and the rows are picked by a semi-join
    on the unique ``seq``, which cannot skew; columns the caller drops are never read.
    """
    named = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], *[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      F.col(seq).alias("_seq"))
    groups = named.groupBy(*[f"_k{i}" for i in range(len(keys))])
    if order:
        best = F.min(F.struct(*[f"_o{i}" for i in range(len(order))], "_seq"))["_seq"]
    else:
        best = F.min("_seq")
    firsts = groups.agg(best.alias("_first")).select("_first")
    return df.join(firsts, df[seq] == firsts["_first"], "left_semi")


def dedupe_display(df: DataFrame, title_keys: Sequence[str], date_keys: Sequence[str],
                   *, seq: str = "seq") -> DataFrame:
    """First row per display key (https-normalised link, else type/title/date)."""
    return _keep_first(df, [display_key(title_keys, date_keys)], [], seq)


def dedupe_exact(df: DataFrame, keys: Sequence[str], *, seq: str = "seq",
                 source_rank: str | None = None) -> DataFrame:
    """First row per exact key tuple; across sources a fixed source rank orders first."""
    order = [F.col(source_rank)] if source_rank else []
    return _keep_first(df, [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], order, seq)


def dedupe_sidebar(df: DataFrame, *, seq: str = "seq", type_col: str = "type",
                   item: str = "item") -> DataFrame:
    """One notification per (type, visible label): best sidebar link score, earliest on ties."""
    score = link_score_typed(F.col(f"{item}.link"), F.col(type_col))
    return _keep_first(df, [sidebar_key(type_col, item)], [-score], seq)
