"""Keyed tables that survive a crash during a write: immutable bucket versions and a manifest.

Rows live in hash buckets of their key.  A commit writes new files for the buckets it
touches, below a version of its own, and then one manifest that names for every bucket
the versions that hold its rows.  The manifest becomes visible by a single rename, so a
reader sees the table before the commit or after it, whatever dies in between, and files
of a commit that never got its manifest are never read.  A manifest also remembers the
last batch applied for each stream, so a batch replayed after a crash is applied once.

One writer at a time; readers need no coordination.  Everything is below the table's path:
``data/<version>/bucket=<n>/*.parquet`` and ``manifest/<version>.json``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_names, read_text, remove_path, rename_path, write_text

#: Versions of a bucket that are read together before an append rewrites it as one.
MAX_PARTS = 8


@dataclass(frozen=True)
class Manifest:
    """One committed state: versions of each bucket, the last batch of each stream, figures of the commit."""

    version: int = 0
    parts: dict[int, list[int]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    oldest: dict[int, str] = field(default_factory=dict)
    counts: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Manifest":
        d = json.loads(text)
        return cls(d["version"], {int(b): v for b, v in d["parts"].items()}, d["streams"],
                   {int(b): v for b, v in d["oldest"].items()}, d["counts"])


class BucketStore:
    """A table below ``path``, dealt over ``buckets`` by a hash of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    # -- states ----------------------------------------------------------------

    def _state(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        names = file_names(self.spark, f"{self.path}/manifest")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest committed state (or that of ``version``); an empty one before the first commit."""
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest.from_json(read_text(self.spark, self._state(version))) if version else Manifest()

    def _publish(self, manifest: Manifest) -> None:
        """Make a state visible: written aside, then renamed; fails if another writer took the version."""
        aside = f"{self.path}/manifest/_{manifest.version:012d}.tmp"
        write_text(self.spark, aside, manifest.to_json())
        if not rename_path(self.spark, aside, self._state(manifest.version)):
            raise RuntimeError(f"version {manifest.version} of {self.path} was committed by another writer")

    # -- rows ------------------------------------------------------------------

    def bucket(self) -> Column:
        """Bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame | None:
        """Rows of the newest state, or of some buckets only; None where nothing is stored."""
        manifest = self.manifest(version)
        wanted = sorted(manifest.parts if buckets is None else set(buckets) & set(manifest.parts))
        paths = [f"{self.path}/data/{v:012d}/bucket={b}" for b in wanted for v in manifest.parts[b]]
        return self.spark.read.parquet(*paths) if paths else None

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows fall into (at most ``buckets`` numbers)."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def applied(self, stream: str | None, batch_id: int | None) -> bool:
        """The batch of this stream is already part of the table."""
        return stream is not None and batch_id is not None and self.manifest().streams.get(stream, -1) >= batch_id

    def commit(self, rows: DataFrame, touched: Iterable[int], *, append: bool = False, stream: str | None = None,
               batch_id: int | None = None, age: str | None = None, count_by: Iterable[str] = ()) -> Manifest:
        """Write ``rows`` as the new content of the buckets ``touched`` (or added to it) and publish the state.

        ``rows`` must fall into ``touched`` only; a touched bucket without rows becomes
        empty.  With ``age`` the manifest keeps each bucket's smallest value of that
        column, with ``count_by`` the whole table's row counts by these columns.
        """
        last, touched = self.manifest(), list(touched)
        version = last.version + 1
        target = f"{self.path}/data/{version:012d}"
        # a bucket larger than a task's share is dealt over several; files of an earlier attempt at this version are replaced
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target, compression="zstd")
        written = {int(n.split("=")[1]) for n in file_names(self.spark, target) if n.startswith("bucket=")}
        if not written <= set(touched):
            raise ValueError(f"rows outside of the buckets named: {sorted(written - set(touched))}")
        kept = {b: v for b, v in last.parts.items() if append or b not in touched}
        parts = kept | {b: [*kept.get(b, []), version] for b in written}
        oldest = {b: v for b, v in last.oldest.items() if b in kept}
        if age and written:
            new = self.spark.read.parquet(target)
            for b, v in new.groupBy("bucket").agg(F.min(age).cast("string")).collect():
                oldest[b] = min(filter(None, (v, oldest.get(b))), default="")
        counts = last.counts
        if count_by:
            by = list(count_by)
            paths = [f"{self.path}/data/{v:012d}/bucket={b}" for b, vs in parts.items() for v in vs]
            stored = self.spark.read.parquet(*paths).groupBy(*by).count() if paths else None
            counts = [list(r) for r in stored.collect()] if stored is not None else []
        streams = last.streams | ({stream: batch_id} if stream is not None and batch_id is not None else {})
        manifest = Manifest(version, parts, streams, oldest, counts)
        self._publish(manifest)
        return manifest

    def compact(self) -> None:
        """Rewrite the buckets that appends have cut into more than ``MAX_PARTS`` versions."""
        cut = [b for b, v in self.manifest().parts.items() if len(v) > MAX_PARTS]
        if cut:
            self.commit(self.read(cut), cut)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` states and the files only they name."""
        versions = self.versions()
        for v in versions[:-keep]:
            remove_path(self.spark, self._state(v))
        named = {v for state in versions[-keep:] for vs in self.manifest(state).parts.values() for v in vs}
        for v in map(int, file_names(self.spark, f"{self.path}/data")):
            if v not in named and v <= max(versions, default=0):
                remove_path(self.spark, f"{self.path}/data/{v:012d}")
