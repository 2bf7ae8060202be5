"""Notification table operators: dedupe, upsert, week buckets, 48-hour window, scrape info.

A notification row is ``(seq, type, timestamp, scrape_date, item struct)``.
Every operator keys on ``notification_identity`` = normalised type + item identity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import notification_date, ntz_micros, parse_iso
from ..functions.identity import notification_identity
from ..functions.text import first_nonempty
from .dedupe import first_per_key
from .merge import merge_items

NID = "nid"

ITEM_STRING_FIELDS = ("document_name", "title", "document_number", "link", "summary",
                      "release_date", "release_date_raw", "edited_date", "edited_date_raw",
                      "last_edited_date", "last_edited_date_raw", "publish_date", "publish_date_raw")


def conform_item(df: DataFrame, item: str = "item") -> DataFrame:
    """Add the canonical item fields missing from the nested struct (as NULL)."""
    have = set(df.schema[item].dataType.fieldNames())
    col = F.col(item)
    changed = False
    for f in ITEM_STRING_FIELDS:
        if f not in have:
            col = col.withField(f, F.lit(None).cast("string"))
            changed = True
    return df.withColumn(item, col) if changed else df


def with_nid(df: DataFrame, *, type_col: str = "type", item: str = "item") -> DataFrame:
    """Add the notification identity column (computed from the nested item)."""
    if NID in df.columns:
        return df
    from ..functions.identity import add_identity
    fields = df.schema[item].dataType.fieldNames()
    flat = df.select(*df.columns, *[F.col(f"{item}.{f}").alias(f) for f in fields if f not in df.columns])
    ident_df = add_identity(flat, "_ident")
    out = ident_df.withColumn(NID, notification_identity(F.col(type_col), F.col("_ident")))
    return out.select(*df.columns, NID)


def _merge_nested(df: DataFrame, *, item: str, seq: str, carry: Sequence[str] = (),
                  extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """Merge the nested items of rows sharing ``nid`` (the item fold), one row per nid."""
    fields = df.schema[item].dataType.fieldNames()
    flat = df.select(NID, seq, *carry, *[F.col(f"{item}.{f}").alias(f) for f in fields])
    merged = merge_items(flat, key=NID, seq=seq, fields=fields, carry=carry, extra_aggs=extra_aggs)
    extra = [c for c in merged.columns if c not in (NID, seq, *fields)]
    return merged.select(NID, seq, *extra, F.struct(*[F.col(f) for f in fields]).alias(item))


def _first(col: str, seq: str) -> Column:
    return F.min(F.struct(F.col(seq).alias("s"), F.col(col).alias("v")))["v"]


def dedupe_notifications(df: DataFrame, *, seq: str = "seq", item: str = "item",
                         ts: str = "timestamp", scrape: str = "scrape_date") -> DataFrame:
    """One notification per identity: items merged in order, newest timestamp kept.

    The newest timestamp wins (earliest row on ties) and brings its scrape
    date along when it has one; type and other columns come from the first
    row.  All of it is one aggregation pass with the item merge.
    """
    df = with_nid(df, item=item)
    others = [c for c in df.columns if c not in (NID, seq, item, ts, scrape)]
    newest = F.min(F.when(F.col(ts).isNotNull(),
                          F.struct((-ntz_micros(F.col(ts))).alias("o"),
                                   F.col(seq).alias("s"), F.col(ts).alias("t"), F.col(scrape).alias("sd"))))
    extra = [_first(c, seq).alias(c) for c in others]
    extra += [newest.alias("_newest"), _first(ts, seq).alias("_ts0"), _first(scrape, seq).alias("_sd0")]
    out = _merge_nested(df, item=item, seq=seq, carry=[*others, ts, scrape], extra_aggs=extra)
    out = (out.withColumn(ts, F.coalesce(F.col("_newest.t"), F.col("_ts0")))
              .withColumn(scrape, F.coalesce(F.col("_newest.sd"), F.col("_sd0")))
              .drop("_newest", "_ts0", "_sd0"))
    return out.select(*df.columns)


def upsert_notifications(store: DataFrame, new: DataFrame, *, as_of, new_type: str | Column | None = None,
                         seq: str = "seq", item: str = "item") -> DataFrame:
    """Add new items to the notification table.

    Known identities keep their row and timestamps and merge the new item
    into theirs; unknown ones are inserted stamped with ``as_of``.  The store
    is assumed already deduplicated (``read_notifications`` does it).  Store
    rows order before new rows (a leading ``_batch`` rank), so "first row"
    means the stored one whenever it exists.
    """
    as_of_col = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    store = with_nid(store, item=item)
    incoming = new
    if new_type is not None:
        incoming = incoming.withColumn("type", F.lit(new_type) if isinstance(new_type, str) else new_type)
    incoming = (with_nid(incoming, item=item)
                .withColumn("timestamp", as_of_col)
                .withColumn("scrape_date", as_of_col))
    both = (store.withColumn("_batch", F.lit(0))
                 .unionByName(incoming.select(*store.columns).withColumn("_batch", F.lit(1))))
    # order key: (batch, seq) packed so the merge fold sees stored rows first
    both = both.withColumn("_order", F.struct(F.col("_batch"), F.col(seq)))
    others = [c for c in store.columns if c not in (NID, seq, item)]
    extra = [F.min(F.struct(F.col("_order").alias("o"), F.col(c).alias("v")))["v"].alias(c) for c in others]
    extra.append(F.min(F.struct(F.col("_order").alias("o"), F.col("_order")[seq].alias("v")))["v"].alias("_seq0"))
    ranked = both
    # the fold needs a single sortable sequence: stored rows keep their seq,
    # new rows are shifted past every stored seq by a scalar subquery
    offset = store.agg(F.coalesce(F.max(seq), F.lit(-1)) + F.lit(1)).scalar()
    ranked = ranked.withColumn(seq, F.when(F.col("_batch") == 0, F.col(seq)).otherwise(offset + F.col(seq)))
    out = _merge_nested(ranked, item=item, seq=seq, carry=[*others, "_order"], extra_aggs=extra)
    return out.drop(seq).withColumnRenamed("_seq0", seq).select(*store.columns)


def bucket_by_week(df: DataFrame, as_of, *, seq: str = "seq", item: str = "item") -> DataFrame:
    """First notification per identity, bucketed by whole-day age: week_1, week_2, archived.

    Age is ``floor((as_of - date) / 24h)``; future dates fall to ``archived``;
    undated notifications are dropped.
    """
    as_of_col = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    firsts = first_per_key(with_nid(conform_item(df, item), item=item), [NID], [seq])
    d = notification_date(item)
    secs = ntz_micros(as_of_col) - ntz_micros(F.col("item_date"))
    age = F.floor(secs / F.lit(86_400_000_000)).cast("long")
    bucket = (F.when((age >= 0) & (age <= 7), F.lit("week_1"))
               .when((age >= 8) & (age <= 14), F.lit("week_2"))
               .otherwise(F.lit("archived")))
    from .common import bind
    return (bind(firsts, "item_date", d).where(F.col("item_date").isNotNull())
                  .withColumn("age_days", age).withColumn("bucket", bucket))


ZONE_RE = "T.*(Z|[+-]\\d{2}:?\\d{2})$"


def active_notifications(df: DataFrame, as_of, *, hours: int = 48, item: str = "item") -> DataFrame:
    """Items released less than ``hours`` before ``as_of`` (future dates pass).

    Only the first non-empty raw date is read; it must be ISO and zone-free,
    else the row is dropped (the reference cannot compare a zoned value).
    """
    as_of_col = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    df = conform_item(df, item)
    raw = first_nonempty(*[f"{item}.{k}" for k in ("release_date_raw", "edited_date_raw",
                                                    "last_edited_date_raw", "publish_date_raw")])
    d = F.when(~raw.rlike(ZONE_RE), parse_iso(raw))
    from .common import bind
    secs = ntz_micros(as_of_col) - ntz_micros(F.col("item_date"))
    return bind(df, "item_date", d).where(
        F.col("item_date").isNotNull() & (secs < F.lit(hours * 3600 * 1_000_000)))


def last_scrape_info(df: DataFrame, *, scrape: str = "scrape_date") -> DataFrame:
    """(last_scrape, scrape_count, new_items_this_session) as one row.

    Rows whose scrape date does not parse are skipped for the maximum but still
    counted; with no parseable date at all the row is (NULL, 0, 0).
    """
    sd = F.col(scrape).try_cast("timestamp_ntz")
    newest = df.agg(F.max(sd)).scalar()
    agg = df.agg(F.max(sd).alias("last_scrape"), F.count(F.lit(1)).alias("_n"),
                 F.count_if(F.to_date(sd) == F.to_date(newest)).alias("_same_day"))
    has = F.col("last_scrape").isNotNull()
    return agg.select(F.col("last_scrape"),
                      F.when(has, F.col("_n")).otherwise(F.lit(0)).alias("scrape_count"),
                      F.when(has, F.col("_same_day")).otherwise(F.lit(0)).alias("new_items_this_session"))


def group_notifications(df: DataFrame, as_of, types: Sequence[str], *, seq: str = "seq",
                        item: str = "item") -> DataFrame:
    """Week bucket, then one row per (bucket, type, visible label): best sidebar link, earliest on ties.

    Rows stay rows (no per-group lists), so a huge bucket never becomes one value.
    """
    from ..functions.identity import sidebar_key
    from ..functions.links import link_score_typed
    bucketed = bucket_by_week(df, as_of, seq=seq, item=item).where(F.col("type").isin(*types))
    score = link_score_typed(F.col(f"{item}.link"), F.col("type"))
    return first_per_key(bucketed, [F.col("bucket"), sidebar_key("type", item)], [-score, F.col(seq)])
