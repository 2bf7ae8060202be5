"""Spelling variants: words one edit away from a much more frequent word.

Two words of at most ``m`` letters, one edit apart, share their first ``m // 2`` letters
or their last ``m - m // 2``; every word is therefore dealt, for both lengths ``m`` it can
have a partner in, to the cell of that prefix and to the cell of that suffix (reversed).
Spark sorts the cells; each task scans them in order by rows of an edit matrix that
adjacent words share (``edit_scan``).  A cell of more than ``CELL_WORDS`` words is cut by a
hash into slices that meet two by two, so no task holds a hot prefix whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved
from .edit_scan import near_pairs

#: A run of letters, A-Z still in either case.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of a cell that is not cut, and words scanned at once.
CELL_WORDS, BATCH_WORDS = 4096, 50_000
_CELL = ("backwards", "m", "part", "i", "j")


def runs(docs: DataFrame, dropped: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word``: every run of letters of every text, lower-cased A-Z.

    ``dropped`` may give, from the id and the run, the place (from 0) of a code point to
    leave out, or null.
    """
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    said = docs.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    if dropped is None:
        return said.select(F.col("run").alias("word"))
    at = dropped(F.col("id"), F.col("run"))
    rest = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return said.select(F.coalesce(rest, F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: the distinct words of enough code points and occurrences."""
    long_enough = words.where(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _cells(words: DataFrame) -> DataFrame:
    """Each word in the cells where it may have a partner: ``backwards, m, part, i, j, scan, n, slice``."""
    length, half = F.length("word"), F.floor(F.col("m") / 2).cast("int")
    entries = words.withColumn("m", F.explode(F.array(length, length + 1))).withColumn("backwards", F.explode(F.array(F.lit(False), F.lit(True))))
    entries = entries.withColumn("scan", F.when(F.col("backwards"), F.reverse("word")).otherwise(F.col("word")))
    size = F.when(F.col("backwards"), F.col("m") - half).otherwise(half)
    entries = entries.select("backwards", "m", F.substring(F.col("scan"), F.lit(1), size).alias("part"), "scan", "n")
    key = ["backwards", "m", "part"]
    hot = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL_WORDS)
    sliced = entries.join(hot, key, "left").withColumn(
        "slices", F.coalesce(F.ceil(F.col("size") / CELL_WORDS), F.lit(1)).cast("int")).withColumn(
        "slice", F.pmod(F.xxhash64("scan"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    return sliced.select(*key, "scan", "n", "slice", other).select(
        *key, F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "scan", "n", "slice")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, both ways, of the cells of a sorted partition."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_WORDS:
            whole = pa.Table.from_batches(held).combine_chunks()
            cell = _cell_numbers(whole)
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield from _near(whole.slice(0, cut), cell[:cut])
            held = whole.slice(cut).to_batches()
            rows = whole.num_rows - cut
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from _near(whole, _cell_numbers(whole))


def _cell_numbers(table: pa.Table) -> np.ndarray:
    """Cells numbered in order."""
    changed = np.zeros(table.num_rows, bool)
    for name in _CELL:
        column = table[name].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def _near(table: pa.Table, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = table["scan"].to_pylist()
    backwards = table["backwards"].to_numpy()
    m, i, j, slices, n = (table[c].to_numpy() for c in ("m", "i", "j", "slice", "n"))
    length = np.fromiter(map(len, words), np.int64, len(words))
    for a, b in near_pairs(words, cell):
        # a pair counts where its longer word has m letters, and in one cell of slices
        good = (np.maximum(length[a], length[b]) == m[a]) & ((i[a] == j[a]) | (slices[a] != slices[b]))
        a, b = a[good], b[good]
        left, right = [words[x] for x in a], [words[x] for x in b]
        for at in np.flatnonzero(backwards[a]):
            left[at], right[at] = left[at][::-1], right[at][::-1]
        # pairs that share the prefix come from the cell of the prefix
        half = (m[a] // 2).tolist()
        once = np.array([not back or x[:h] != y[:h] for back, h, x, y in zip(backwards[a].tolist(), half, left, right)], bool)
        keep = np.flatnonzero(once)
        x, y = [left[k] for k in keep], [right[k] for k in keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x + y, pa.string()), pa.array(y + x, pa.string()), pa.array(np.r_[n[b][keep], n[a][keep]])],
            names=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words of ``words`` (``word, n``) one edit apart, once."""
    dealt = _cells(words).repartition(*_CELL).sortWithinPartitions(*_CELL, "scan")
    return dealt.mapInArrow(_scan, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word that forms lead to, by doubling the steps of every word."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = saved(now.select("word", "root").join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (distinct ``word`` and ``n``).

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's
    form is its near word of largest ``n`` (ties: the smallest in code-point order) if that
    is at least ``ratio`` times the word's own, else null; the root is the last word that
    forms lead to, the word itself without a form.  An empty table gives an empty result.
    """
    words = saved(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left")
    frequent = -F.col("best.less") >= ratio * F.col("n")
    judged = saved(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, dropped: Callable[[Column, Column], Column] | None = None,
             least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """:func:`group_variants` over the words of ``docs`` (``doc_id, text``).

    Null and empty texts have no words; repeated rows count each time; texts of any
    length are read whole; other columns are ignored.
    """
    return group_variants(vocabulary(runs(docs, dropped), least_length, least_count), ratio)
