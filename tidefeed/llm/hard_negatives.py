"""Hard negatives: rows of another label that score just below an anchor's positives.

Rows are dealt into blocks of bounded size by a hash of their id, anchors likewise.
Every block of rows meets every block of anchors (a stated query set against all
rows) in a threshold join (``l2ap``): an inverted index without the dimensions that
suffix norms cover, partial scores, pruning by remaining norms.  Thresholds start
high and are lowered round by round, only for anchors whose windows are not full;
a window is full when enough rows above the threshold were found, for all rows
above it have then been seen.  Every block sends its best rows of a window only,
so what meets per anchor is bounded by the window and the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .l2ap import pairs_above

#: Rows and anchors of a block.
ROW_BLOCK, ANCHOR_BLOCK = 8192, 2048
#: Thresholds for positives, as shares of the highest score possible; -1 lets every row pass.
POSITIVE_ROUNDS = (0.6, 0.25, -1.0)
#: Thresholds for negatives: how far down a window a round looks; 1 is its whole.
NEGATIVE_ROUNDS = (0.1, 0.4, 1.0)


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """Each component as the whole number below ``scale`` times it, held in a double."""
    def down(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0 ** 52, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, down)


def usable(rows: DataFrame) -> DataFrame:
    """``id, label, v`` of the rows that take part, one row per id."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    return kept.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as a matrix; shorter lists are filled with zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), lengths.max(initial=0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` highest scores of each group, ties by smaller id."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


def _positives_of(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 3
        if rows.num_rows and anchors.num_rows:
            ids, labels = (rows[c].to_numpy() for c in ("id", "label"))
            names, wanted, floors = (anchors[c].to_numpy() for c in ("id", "label", "floor"))
            v, q = _matrix(rows["v"]), _matrix(anchors["v"])
            found = []
            for label in np.unique(wanted):
                mine, same = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
                a, b, score = pairs_above(_wide(q[mine], v), _wide(v[same], q), floors[mine])
                a, b = mine[a], same[b]
                other = names[a] != ids[b]
                a, b, score = a[other], b[other], score[other]
                top = best(a, score, ids[b], k)
                found.append((names[a[top]], ids[b[top]], score[top]))
            out = [np.concatenate(c) for c in zip(*found)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), out)))
    return search


def _wide(m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``m`` with as many dimensions as the wider of the two (zeros are added)."""
    return np.pad(m, ((0, 0), (0, max(0, other.shape[1] - m.shape[1]))))


def _negatives_of(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64)] * 4]
        if rows.num_rows and anchors.num_rows:
            ids, labels = (rows[c].to_numpy() for c in ("id", "label"))
            names, own, floors = (anchors[c].to_numpy() for c in ("id", "label", "floor"))
            v, q = _matrix(rows["v"]), _matrix(anchors["v"])
            a, b, score = pairs_above(_wide(q, v), _wide(v, q), floors.astype(float))
            other = own[a] != labels[b]
            a, b, score = a[other], b[other], score[other]
            windows = anchors["windows"].to_pylist()
            for at in range(max(len(w) for w in windows)):
                low, high, named = (np.array([w[at][c] if at < len(w) else d for w in windows], np.int64)
                                    for c, d in (("low", 0), ("high", -1), ("positive_id", 0)))
                inside = np.flatnonzero((score >= low[a]) & (score <= high[a]))
                top = inside[best(a[inside], score[inside], ids[b[inside]], k)]
                found.append([names[a[top]], named[a[top]], ids[b[top]], score[top]])
        out = [np.concatenate(c) for c in zip(*found)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "negative_score"), out)))
    return search


def _meet(rows: DataFrame, blocks: int, anchors: DataFrame, n_anchors: int, search, schema: str) -> DataFrame:
    """Run ``search`` on every block of rows with every block of anchors."""
    parts = -(-n_anchors // ANCHOR_BLOCK) or 1
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = anchors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, schema)


def _ranked(found: DataFrame, group: tuple[str, ...], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), name)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(rows: DataFrame, blocks: int, anchors: DataFrame, k: int) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: the ``k`` best other rows of each anchor's label."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    highest = rows.agg(F.max(norm)).first()[0] or 0.0
    pending, done = anchors, None
    for share in POSITIVE_ROUNDS:
        n = pending.count()
        if not n:
            break
        asked = pending.withColumn("floor", F.lit(share * highest) * norm * (1 + 1e-9 if share < 0 else 1))
        found = _meet(rows, blocks, asked, n, _positives_of(k), "anchor_id long, positive_id long, positive_score long")
        top = saved(_ranked(found, ("anchor_id",), "positive_score", "positive_id", k).drop("rank"), "positives")
        full = top if share <= -1 else top.join(
            top.groupBy("anchor_id").count().where(F.col("count") == k).select("anchor_id"), "anchor_id", "left_semi")
        done = full if done is None else done.unionByName(full)
        pending = saved(pending.join(full.select(F.col("anchor_id").alias("id")).distinct(), "id", "left_anti"), "pending")
    return done


def negatives(rows: DataFrame, blocks: int, anchors: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, negative_score`` for ``windows`` of scores ``low`` to ``high``."""
    schema = "anchor_id long, positive_id long, negative_id long, negative_score long"
    keys = ("anchor_id", "positive_id")
    done = anchors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, negative_id long, negative_score long, rank int")
    pending = windows
    for share in NEGATIVE_ROUNDS:
        floor = F.col("low") if share >= 1 else F.greatest("low", F.col("high") - F.floor((F.col("high") - F.col("low")) * share))
        grouped = pending.groupBy("anchor_id").agg(
            F.min(floor).alias("floor"), F.collect_list(F.struct("positive_id", "low", "high")).alias("windows"))
        asked = saved(anchors.join(grouped, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "asked")
        n = asked.count()
        if not n:
            break
        found = _meet(rows, blocks, asked, n, _negatives_of(k), schema)
        top = saved(_ranked(found, keys, "negative_score", "negative_id", k), "negatives")
        seen = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        judged = saved(pending.join(asked.select(F.col("id").alias("anchor_id"), "floor"), "anchor_id").join(
            seen, list(keys), "left").withColumn("full", (F.coalesce("n", F.lit(0)) >= k) | (F.col("floor") <= F.col("low"))), "judged")
        done = done.unionByName(top.join(judged.where("full").select(*keys), list(keys), "left_semi"))
        pending = judged.where("not full").select(*keys, "low", "high")
    return done


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], n_positives: int = 5, n_negatives: int = 3) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id``, ``label`` (whole numbers) and ``embedding`` (whole numbers in
    doubles, see :func:`quantised`); ``is_anchor`` gives a condition on an id.  A score is
    the inner product; higher comes first, ties by smaller id.  An anchor's positives are
    its ``n_positives`` best other rows of its label; for each of them the ``n_negatives``
    best rows of another label between 50 and 95 percent of the positive's score come out.

    Rows with a null id, label or vector or any null or non-finite component take no
    part.  Repeated ids count once, with the smallest label and vector.  Shorter
    vectors are filled with zeros.  Anchors without positives, and positives without
    a row in their window (those of negative score have none), have no row; an empty table gives an empty result.
    Other columns are ignored.
    """
    named = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").cast("array<double>").alias("v"))
    kept = saved(usable(named), "vectors")
    blocks = -(-kept.count() // ROW_BLOCK) or 1
    dealt = kept.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    anchors = saved(kept.where(is_anchor(F.col("id"))), "anchors")
    near = positives(dealt, blocks, anchors, n_positives)
    if near is None:
        near = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, positive_score long")
    # 50 p <= 100 n <= 95 p, in whole numbers that cannot overflow
    windows = near.where("positive_score >= 0").select(
        "anchor_id", "positive_id", F.expr("positive_score - positive_score div 2").alias("low"),
        F.expr("positive_score - positive_score div 20 - if(positive_score % 20 > 0, 1, 0)").alias("high")).where("low <= high")
    far = negatives(dealt, blocks, anchors, windows, n_negatives)
    return far.join(near, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
