"""Structured Streaming forms of the snapshot diff and the notification table.

``stream_new_items`` emits an item the first time its identity is seen within a
``horizon``: the state expires, and an identity not seen for longer than the horizon
counts as new again (unlike the batch diff, which forgets exactly what the previous
snapshot lacks).  Its state lives in the session's state store.

``stream_first_seen`` never forgets.  Identities seen are a table in hash buckets
(``sources.bucket_store``), and each micro-batch is reduced to the identities that its
buckets lack, so nothing grows on any heap; the table is the stream of new items.

``stream_upsert_notifications`` maintains the notification table per micro-batch in the
same kind of store: a batch reads and rewrites only the buckets it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import first_per_key
from ..operators.notifications import NID, dedupe_notifications, with_nid
from ..session import remove_path, scratch_path
from ..sources.bucket_store import BucketStore

BUCKETS = 64


def stream_new_items(sdf: DataFrame, *, horizon: str | None = None, event_time: str = "timestamp") -> DataFrame:
    keyed = with_nid(sdf)
    if horizon:
        # watermarks need an instant (TIMESTAMP); our times are naive, so the
        # watermark runs on a derived column (a daylight-saving hour does not
        # matter for a state horizon)
        timed = keyed.withColumn("_event_ts", F.col(event_time).cast("timestamp"))
        return (timed.withWatermark("_event_ts", horizon)
                     .dropDuplicatesWithinWatermark([NID]).drop("_event_ts"))
    return keyed.dropDuplicates([NID])


def _staged(rows: DataFrame) -> tuple[DataFrame, str]:
    """A copy of a micro-batch, which is read more than once, and where it is."""
    path = scratch_path(rows.sparkSession, f"tidefeed-batch-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path), path


def first_seen_batch(batch: DataFrame, batch_id: int, path: str, *, buckets: int = BUCKETS, stream: str | None = None) -> None:
    """One micro-batch: append the first row (by ``seq``) of each identity the store lacks.

    Only the buckets of the batch's identities are read, and of them only the identity.
    """
    store = BucketStore(batch.sparkSession, path, [NID], buckets)
    if store.applied(stream, batch_id):
        return
    rows, copy = _staged(with_nid(batch.select("seq", "type", "timestamp", "scrape_date", "item")))
    firsts = first_per_key(rows, [NID], ["seq"])
    touched = store.touched(firsts)
    if touched:
        known = store.read(touched)
        if known is not None:
            firsts = firsts.join(known.select(NID), NID, "left_anti")
        store.commit(firsts.withColumn("batch_id", F.lit(batch_id).cast("long")), touched, append=True, stream=stream, batch_id=batch_id)
        store.compact()
        store.vacuum()
    remove_path(batch.sparkSession, copy)


def stream_first_seen(sdf: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS):
    """Start the query (``availableNow``) that appends never-seen items to the table at ``path``."""
    return (sdf.writeStream.foreachBatch(lambda b, i: first_seen_batch(b, i, path, buckets=buckets, stream=checkpoint))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _merged(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Stored and new rows merged; a stored row whose identity the batch lacks is passed on as it is."""
    if stored is None:
        return with_nid(dedupe_notifications(new.drop(NID)))
    named = new.select(F.col(NID).alias("_named")).distinct()
    met = stored[NID].eqNullSafe(named["_named"])
    rows = stored.join(named, met, "left_semi").drop(NID).unionByName(new.drop(NID))
    return with_nid(dedupe_notifications(rows)).unionByName(stored.join(named, met, "left_anti"))


def upsert_batch(batch: DataFrame, batch_id: int, path: str, *, buckets: int = BUCKETS, stream: str | None = None) -> None:
    """One micro-batch: merge the batch into the buckets it touches and commit them as a new version.

    Stored and new rows are merged by ``seq`` with their own timestamps (the newest is
    kept), so the table does not depend on how rows fall into batches.  A crash at any
    point leaves the version before; the replayed batch then finds the rows it needs.
    A batch already applied for its ``stream`` is left out.
    """
    store = BucketStore(batch.sparkSession, path, [NID], buckets)
    if store.applied(stream, batch_id):
        return
    new, copy = _staged(with_nid(batch.select("seq", "type", "timestamp", "scrape_date", "item")))
    touched = store.touched(new)
    if touched:
        store.commit(_merged(store.read(touched), new), touched, stream=stream, batch_id=batch_id)
        store.vacuum()
    remove_path(batch.sparkSession, copy)


def stream_upsert_notifications(sdf: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS):
    """Start the upkeep query (``availableNow``); returns the StreamingQuery."""
    return (sdf.writeStream.foreachBatch(lambda b, i: upsert_batch(b, i, path, buckets=buckets, stream=checkpoint))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_table(spark, path: str) -> DataFrame:
    """Rows of the newest committed version of a store."""
    return BucketStore(spark, path, [NID]).read()
