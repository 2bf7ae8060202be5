"""Merge rows that share an item identity (the reference's ordered fold), skew-safe.

The fold visits rows in ``seq`` order.  An incoming row becomes the primary
record only when its link scores **strictly** higher than the accumulated
record's link; every empty field of the primary is then filled from the other
record, and the last-edited pair follows its own date rule.

Closed form used here (derived from that fold, see README):

* The accumulated link score before row *i* is the highest score among earlier
  rows that carry a link, or 0 when none does.  Row *i* "wins" when its own
  score is strictly higher.  Only the first row at each score value can raise
  the running maximum, so the per-identity table ``(score -> first seq)`` --
  a handful of entries -- decides every row's win flag.
* Each field's final value is the first non-empty value in the order: winners,
  latest first; then the first row; then the other rows in ``seq`` order.  That
  is a ``min(struct(priority, value))`` aggregate, which Spark pre-aggregates
  map-side, so a hot identity (e.g. ``empty-item``) never lands whole in one task.
* The join that attaches the score table is salted for every identity, so the
  rows of a hot one are dealt over several keys without a test of its size.
* A row hands over its last-edited pair when its date beats the record's date at that
  point.  Until a row has a raw date, the record's date is the latest shown date seen, and
  from then on the latest raw date seen; each field is therefore that of the last row
  which hands over and has it, else of the first row that has it.  The dates seen before a
  row are running maxima, taken in two levels (over blocks of a key, then inside a block),
  over only the rows that carry a last-edited value, so no key's rows meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.links import link_score

LE_RAW = "last_edited_date_raw"
LE_DISPLAY = "last_edited_date"


def _empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


#: Copies of a key's score table, so that the rows of a hot key are dealt over as many join keys.
SALTS = 16


def score_table(rows: DataFrame, keys: Sequence[str], *, seq: str = "seq",
                score_col: str = "_score", has_col: str = "_has_link") -> DataFrame:
    """Per key of several rows the table ``score -> first seq``, once for each salt.

    Two narrow aggregates build it (at most one entry per distinct score).
    """
    keys = list(keys)
    firsts = (rows.groupBy(*keys, F.when(F.col(has_col), F.col(score_col)).alias("_s"))
                  .agg(F.min(seq).alias("_fs"), F.count(F.lit(1)).alias("_n")))
    table = (firsts.groupBy(*keys)
                   .agg(F.collect_list(F.when(F.col("_s").isNotNull(),
                                              F.struct(F.col("_s").alias("s"), F.col("_fs").alias("fs"))))
                        .alias("_scores"),
                        F.min("_fs").alias("_first_seq"),
                        F.sum("_n").alias("_rows")))
    return table.where("_rows > 1").drop("_rows").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def win_flags(rows: DataFrame, table: DataFrame, keys: Sequence[str], *, seq: str = "seq", score_col: str = "_score") -> DataFrame:
    """Add ``_win`` / ``_first``: did the row take over as primary in the fold?

    ``table`` (:func:`score_table` of all rows) is joined to the rows on key and salt,
    always, whatever the size of a key.
    """
    keys = list(keys)
    tagged = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(seq)), F.lit(SALTS)).cast("int"))
    joined = tagged.join(table, on=[*keys, "_salt"], how="left")
    before = F.aggregate(
        F.filter("_scores", lambda e: e["fs"] < F.col(seq)),
        F.lit(None).cast("int"),
        lambda acc, e: F.when(acc.isNull() | (e["s"] > acc), e["s"]).otherwise(acc))
    return (joined
            .withColumn("_first", F.col("_first_seq").isNull() | (F.col(seq) == F.col("_first_seq")))
            .withColumn("_win", ~F.col("_first") & (F.col(score_col) > F.coalesce(before, F.lit(0))))
            .drop("_scores", "_first_seq", "_salt"))


def _same_keys(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys, null keys included."""
    named = other.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    same = [rows[k].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)]
    return rows.join(named, same, "left").drop(*(f"_key{i}" for i in range(len(keys))))


#: Positions of one key that are folded together.
BLOCK = 4096


def last_edited(rows: DataFrame, keys: Sequence[str], *, seq: str = "seq") -> DataFrame:
    """``keys, _le_r, _le_d``: the last-edited pair that the fold leaves for each key.

    ``rows`` are the rows that carry a raw or a shown last-edited value, with their
    ``_win`` flag.
    """
    keys = list(keys)

    def filled(c: Column) -> Column:
        return c.isNotNull() & (c != "")

    raw, shown = F.col(LE_RAW).cast("string"), F.col(LE_DISPLAY).cast("string")
    dated = rows.select(*keys, seq, "_win", raw.alias("_r"), shown.alias("_d"), F.floor(F.col(seq) / BLOCK).alias("_block"),
                        filled(raw).alias("_has_r"), filled(shown).alias("_has_d"))
    dated = dated.withColumn("_raw_date", F.when(F.col("_has_r"), parse_date("_r", "store"))).withColumn(
        "_shown_date", F.when(~F.col("_has_r"), parse_date("_d", "store")))
    seen = ("_raw_date", "_shown_date", "_has_r")
    blocks = dated.groupBy(*keys, "_block").agg(*(F.max(c).alias(c) for c in seen))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *(F.max(c).over(earlier).alias(f"_b{c}") for c in seen))
    before = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    placed = dated.select("*", *(F.max(c).over(before).alias(f"_in{c}") for c in seen))
    placed = _same_keys(placed, blocks, [*keys, "_block"])
    raw_seen, shown_seen, any_raw = (F.greatest(f"_b{c}", f"_in{c}") for c in seen)
    record = F.when(any_raw, raw_seen).otherwise(shown_seen)
    own = F.coalesce("_raw_date", "_shown_date")
    hands_over = F.coalesce(own > record, F.when(record.isNull(), own.isNotNull() | F.col("_win")), F.lit(False))
    judged = placed.withColumn("_over", hands_over)

    def field(has: str, value: str) -> Column:
        last = F.max(F.when(F.col(has) & F.col("_over"), F.struct(F.col(seq), F.col(value))))
        first = F.min(F.when(F.col(has), F.struct(F.col(seq), F.col(value))))
        return F.coalesce(last[value], first[value])

    return judged.groupBy(*keys).agg(field("_has_r", "_r").alias("_le_r"), field("_has_d", "_d").alias("_le_d"))


def merge_items(df: DataFrame, *, key: str = "identity", seq: str = "seq",
                group_cols: Sequence[str] = (), fields: Sequence[str] | None = None,
                carry: Sequence[str] = (), extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """One row per ``group_cols + key``; fields merged exactly as the ordered fold does.

    ``key`` is computed with ``item_identity`` when the column is missing.
    The output keeps ``seq`` = first occurrence, so "list order" survives.
    ``carry`` columns ride along (for ``extra_aggs``, further aggregates over
    the same groups computed in the same pass).
    """
    if key not in df.columns:
        from ..functions.identity import add_identity
        df = add_identity(df, key)
    keys = [*group_cols, key]
    if fields is None:
        fields = [c for c in df.columns if c not in (*keys, seq)]
    has_le = LE_RAW in fields and LE_DISPLAY in fields
    has_link = "link" in df.columns
    rows = df.select(*keys, seq, *fields, *[c for c in carry if c not in fields],
                     (link_score("link") if has_link else F.lit(0)).alias("_score"),
                     (~_empty(F.col("link")) if has_link else F.lit(False)).alias("_has_link"))
    table = score_table(rows, keys, seq=seq)
    flagged = win_flags(rows, table, keys, seq=seq)
    p0 = F.when(F.col("_win"), F.lit(0)).otherwise(F.lit(1))
    p1 = F.when(F.col("_win"), -F.col(seq)).otherwise(F.col(seq))
    aggs = [F.min(seq).alias(seq)]
    for f in fields:
        if has_le and f in (LE_RAW, LE_DISPLAY):
            continue
        aggs.append(F.min(F.struct(_empty(F.col(f)).alias("e"), p0.alias("p0"), p1.alias("p1"),
                                   F.col(f).alias("v")))["v"].alias(f))
    if has_le:
        # a group without last-edited rows keeps the plain fill result
        aggs.append(F.min(F.struct(F.lit(0).alias("e"), p0.alias("p0"), p1.alias("p1"),
                                   F.col(LE_RAW).alias("v")))["v"].alias("_le_raw0"))
        aggs.append(F.min(F.struct(F.lit(0).alias("e"), p0.alias("p0"), p1.alias("p1"),
                                   F.col(LE_DISPLAY).alias("v")))["v"].alias("_le_disp0"))
    out = flagged.groupBy(*keys).agg(*aggs, *extra_aggs)
    if has_le:
        carries = ~_empty(F.col(LE_RAW)) | ~_empty(F.col(LE_DISPLAY))
        edited = last_edited(win_flags(rows.where(carries), table, keys, seq=seq), keys, seq=seq)
        out = (_same_keys(out, edited, keys)
                  .withColumn(LE_RAW, F.coalesce("_le_r", "_le_raw0"))
                  .withColumn(LE_DISPLAY, F.coalesce("_le_d", "_le_disp0"))
                  .drop("_le_r", "_le_d", "_le_raw0", "_le_disp0"))
    extra_names = [c for c in out.columns if c not in (*keys, seq, *fields)]
    return out.select(*keys, seq, *fields, *extra_names)
