"""Disk that a job takes besides its result: intermediate tables and shuffle files."""

import os
import random
import tempfile
import time

import pytest

from tidefeed.plans.catalog import q_write_summary_cache
from tidefeed.plans.catalog_stores import q_extraction_table
from tidefeed.session import ensure_checkpoint_dir, shuffles_removed


def _size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def _left(spark, before, most=0):
    """Octets of shuffle files that were not there before, within ten seconds at ``most`` so many (files go in the background)."""
    for _ in range(100):
        left = sum(length for name, length in _shuffle_files(spark).items() if name not in before)
        if left <= most:
            break
        time.sleep(0.1)
    return left


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName(): files.apply(n).length() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle_")}


@pytest.fixture(scope="module")
def documents(spark):
    """A folder of tables with 600 documents of invented words, and its size."""
    folder, made = tempfile.mkdtemp(prefix="tf-disk-"), random.Random(5)
    words = ["".join(made.choices("abcdefghijklmnopqrstuvwxyz", k=made.randint(2, 10))) for _ in range(3000)]
    texts = [" ".join(made.choices(words, k=600)) + ", " + made.choice(words) for _ in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder, _size(f"{folder}/documents.parquet")


def test_shuffle_files_go_with_their_query(spark):
    before = _shuffle_files(spark)
    with shuffles_removed(spark):
        spark.range(1000).repartition(3).write.parquet(tempfile.mkdtemp(prefix="tf-disk-") + "/t")
    assert _left(spark, before) == 0


def test_extraction_table_keeps_less_than_three_times_its_documents(spark, documents):
    folder, size = documents
    kept, files = _size(ensure_checkpoint_dir(spark)[len("file:"):]), _shuffle_files(spark)
    found = q_extraction_table(spark, folder)
    assert _size(ensure_checkpoint_dir(spark)[len("file:"):]) - kept < 3 * size
    assert _left(spark, files, size / 50) <= size / 50
    assert found.count() == 800  # two listed parts of two documents in three


def test_write_summary_cache_leaves_no_shuffled_texts(spark, documents):
    folder, size = documents
    files = _shuffle_files(spark)
    q_write_summary_cache(spark, folder)
    assert _left(spark, files, size / 50) <= size / 50
