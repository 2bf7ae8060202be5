"""Spark session helpers.

The library never creates clusters or servers of its own: ``get_spark`` only
fills in settings that are still unset, so a session handed over by a cluster
keeps its own master, shuffle sizing and checkpoint folder.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution re-plans joins and splits
# skewed shuffle partitions at run time; the UI server stays off.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "tidefeed", *, master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with our defaults."""
    builder = SparkSession.builder.appName(app)
    active = SparkSession.getActiveSession()
    if active is None:
        builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
        for key, value in _DEFAULTS.items():
            builder = builder.config(key, value)
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A configured ``spark.checkpoint.dir`` is used as given.  Without one a folder on
    this machine is made, but only under a local master (tests, single-machine runs):
    executors on other machines could not read it.
    """
    configured = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tidefeed-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def _workers_see(root: str, master: str) -> bool:
    """Python workers can import the package without being sent it."""
    if os.path.basename(root) in ("site-packages", "dist-packages"):
        return True  # installed, as on every machine of the cluster
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return master.startswith("local") and root in map(os.path.abspath, filter(None, seen))


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, so that its functions run from any working folder.

    Workers unpickle functions by module name.  The package is sent once per session,
    unless it is installed or a local session's workers find it by themselves.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "_tidefeed_shipped", False) or _workers_see(root, context.master):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tidefeed-zip-"), "tidefeed")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "tidefeed"))
    context._tidefeed_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table once nothing reads it any more."""
    target, fs = _file(spark, path)
    fs.delete(target, True)


def _file(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file (replacing one of that name)."""
    target, fs = _file(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """Read a small text file."""
    target, fs = _file(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none where it does not exist."""
    target, fs = _file(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def rename_path(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file unless the new name is taken."""
    (old, fs), (new, _) = _file(spark, path), _file(spark, to)
    return not fs.exists(new) and fs.rename(old, new)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run inside go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def materialize(df, **options):
    """Write ``df`` as a parquet table in the shared checkpoint folder and continue from it.

    Used after expensive per-row extraction that several later branches read: the
    work runs once, and lineage is cut at a columnar copy on shared storage that
    survives executor loss.  The result is lazy, so the table stays until the
    caller ends the session or passes its path to :func:`remove_path`.  ``options`` are
    those of the parquet writer.
    """
    import uuid
    path = scratch_path(df.sparkSession, f"tidefeed-mat-{uuid.uuid4().hex}")
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
