"""MinHash near-duplicates, with odd sketches for candidate verification.

Each text's distinct word shingles give MinHash samples; bands of samples bring
candidates together; the samples folded into a parity bitmap (odd sketch) give a
precise estimate of high similarities from the population count of an XOR, which
drops most wrong candidates; full shingle sets then confirm every link.

Work per group stays linear.  Texts with equal shingle sets are one class from the
start.  In each band bucket all members are first compared with the bucket's
smallest member only.  What these links leave apart is compared in a second round:
members outside the bucket's largest component against all its members.  The join
itself tests sizes, odd sketches and a finer parity bitmap of the full sets, and
counts a pair in its first common bucket only, so what it emits are close to the
threshold, not all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced
from .components import components
from .id_filter import asked, without
from .shingles import WordHashes, mixed, shingle_set

#: 40 bands of 5 samples: a pair at similarity 0.8 misses every band with probability 1.3e-7.
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
SKETCH_BITS = 512
#: Percent below the threshold at which an estimate drops a candidate.  The estimate's tail is skewed: at similarity
#: 0.8 it is this low with probability 1.2e-8 (5.7e-6 for 16), less than the bands miss.
SLACK = 22
#: Bits of the parity bitmap of a full set, the largest set it is used for, and its slack (six deviations).
PARITY_BITS, PARITY_SET, PARITY_SLACK = 2048, 1500, 4

_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_FOLD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
#: Shingles handled at once, so that numpy works inside the processor's cache.
_SLICE = 1 << 15


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Samples (texts x SAMPLES) of non-empty shingle sets."""
    out = np.empty((len(sets), SAMPLES), np.uint32)
    at = 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= _SLICE):
            total += len(sets[upto])
            upto += 1
        x = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at:upto - 1]])
        for j in range(SAMPLES):
            out[at:upto, j] = np.minimum.reduceat(x * _FACTORS[j] + _SHIFTS[j], starts)
        at = upto
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (texts x BANDS)."""
    parts = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(samples), BANDS))
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (texts x SKETCH_BITS / 64): every sample flips the bit it hashes to."""
    bit = (mixed(samples.astype(np.uint64) + _FOLD) % np.uint64(SKETCH_BITS)).astype(np.int64)
    out = np.empty((len(samples), SKETCH_BITS // 64), np.int64)
    for at in range(0, len(samples), 1024):
        part = bit[at:at + 1024] + np.arange(len(bit[at:at + 1024]))[:, None] * SKETCH_BITS
        odd = (np.bincount(part.ravel(), minlength=len(part) * SKETCH_BITS) & 1).astype(np.uint8)
        out[at:at + 1024] = np.packbits(odd).view(np.int64).reshape(len(part), -1)
    return out


def parity_bitmaps(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Parity bitmap of each full set: every shingle flips one bit."""
    out = []
    for s in sets:
        odd = np.bincount((s % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return out


def signature_column(text: Column, shingle: int) -> Column:
    """Struct of set size, set digest, band keys, odd sketch and parity bitmap; the last four are null without shingles."""

    def signed(hashes: WordHashes, texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(hashes.of(t), shingle) for t in texts]
        full = [s for s in sets if len(s)]
        samples = minhash(full) if full else np.empty((0, SAMPLES), np.uint32)
        bands, sketches, parities = iter(bands_of(samples)), iter(odd_sketches(samples)), iter(parity_bitmaps(full))
        return pd.DataFrame({
            "n_shingles": np.array([len(s) for s in sets], np.int64),
            "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "bands": [next(bands) if len(s) else None for s in sets],
            "sketch": [next(sketches) if len(s) else None for s in sets],
            "parity": [next(parities) if len(s) else None for s in sets]})

    @F.pandas_udf("n_shingles long, set_hash binary, bands array<long>, sketch array<long>, parity array<long>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield from (signed(hashes, texts) for texts in sliced(batch, 1000))

    return signature(text)


def set_column(text: Column, shingle: int) -> Column:
    """The full distinct shingle set of each text."""

    @F.pandas_udf("array<long>")
    def full_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for batch in batches:
            for texts in sliced(batch, 500):
                yield pd.Series([shingle_set(hashes.of(t), shingle).view(np.int64) for t in texts], dtype=object)

    return full_set(text)


def _differing(a: Column, b: Column, bits: int) -> Column:
    """Size of a symmetric difference from two parity bitmaps."""
    # written out word by word, so that it is compiled with the join that tests it
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)), F.lit(0))
    return -bits / 2.0 * F.log(1.0 - F.least(2.0 * apart / bits, F.lit(0.999)))


def estimate(a: Column, b: Column) -> Column:
    """Similarity in percent from two odd sketches."""
    return 100.0 - 100.0 * _differing(a, b, SKETCH_BITS) / (2.0 * SAMPLES)


def close_sizes(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be ``percent`` similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def close_sets(a: Column, b: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """The parity bitmaps of two full sets allow ``percent``; true for sets too large for them."""
    apart, total = _differing(a, b, PARITY_BITS), size_a + size_b
    return (F.greatest(size_a, size_b) > PARITY_SET) | (100.0 * (total - apart) >= (percent - PARITY_SLACK) * (total + apart))


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets are similar enough.  ``texts`` has ``id, text`` of all classes."""
    pairs = saved(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = saved(asked(texts, "id", ids).dropDuplicates(["id"]).select(
        "id", set_column(F.col("text"), shingle).alias("s")), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("m"))
    return saved(shared.where(100 * F.col("n") >= percent * (F.col("m") - F.col("n"))).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Two documents are linked if their sets of distinct ``shingle``-word shingles
    (A-Z lower-cased; shorter texts are one shingle) have ``percent`` of their union
    in common; a component is all that links reach, named by its smallest id, and
    only that document is kept.

    Null or empty texts have no shingles and are linked with nothing.  Rows that
    repeat an id and a shingle set come out once; an id repeated with other texts is
    a row for each set, and classes whose smallest id it is count as linked.  Rows
    with a null id come out once per set with a null component, kept.  An empty table gives an
    empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    signed = saved(texts.select("id", signature_column(F.col("text"), shingle).alias("s")).select("id", "s.*"), "signed")
    classes = signed.where(F.col("set_hash").isNotNull() & F.col("id").isNotNull()).groupBy("set_hash").agg(
        F.min("id").alias("class_id"))
    chosen = signed.join(classes.withColumnRenamed("set_hash", "h"), (F.col("id") == F.col("class_id")) & (
        F.col("set_hash") == F.col("h")), "left_semi")
    reps = saved(chosen.select("id", "n_shingles", "bands", "sketch", "parity"), "classes")

    entries = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(
        "first_id < last_id").drop("last_id")
    members = saved(entries.join(shared, "bucket"), "buckets")

    def side(suffix: str, *columns: str) -> DataFrame:
        return reps.select(*(F.col(c).alias(c + suffix) for c in ("id", *columns)))

    stars = members.where("id <> first_id").select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b")).distinct()
    known = ("n_shingles", "sketch")
    near = stars.join(side("_a", *known), "id_a").join(side("_b", *known), "id_b").where(
        close_sizes(F.col("n_shingles_a"), F.col("n_shingles_b"), percent)
        & (estimate(F.col("sketch_a"), F.col("sketch_b")) >= percent - SLACK))
    links = _confirmed(near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), texts, shingle, percent)
    found = saved(components(links), "components")

    # Second round: buckets whose members are not all in one component.
    labelled = members.join(found, "id", "left").select(
        "band", "bucket", "id", "first_id", F.coalesce("component", "id").alias("component"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed_buckets = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", "n").alias("main")).where(
        "parts > 1").drop("parts")
    left_over = labelled.where("id <> first_id").join(mixed_buckets, "bucket")
    apart = saved(left_over.join(reps, "id"), "apart")

    def half(rows: DataFrame, suffix: str) -> DataFrame:
        columns = ("id", "band", "bucket", "component", "n_shingles", "bands", "sketch", "parity")
        return rows.select(*(F.col(c).alias(c + suffix) for c in columns))

    first_common = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), F.lit(True)) - 1
    late = half(apart.where("component <> main"), "_a").join(half(apart, "_b"), (
        F.col("bucket_a") == F.col("bucket_b")) & (F.col("component_a") != F.col("component_b"))
        & close_sizes(F.col("n_shingles_a"), F.col("n_shingles_b"), percent)
        & (estimate(F.col("sketch_a"), F.col("sketch_b")) >= percent - SLACK)
        & close_sets(F.col("parity_a"), F.col("parity_b"), F.col("n_shingles_a"), F.col("n_shingles_b"), percent)
        & (first_common == F.col("band_a")))
    late = late.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    more = _confirmed(late, texts, shingle, percent)
    joined = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    documents = signed.select("id", "n_shingles", "set_hash").distinct()
    named = documents.join(classes, "set_hash", "left").join(
        joined.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class_id", "id"))
    return named.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _named_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id names them alone, and a copy of all others with an own id each (None if there are none).

    Own ids are above every given id.
    """
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = saved(counts.where("doc_id is null or n > 1").select(F.col("doc_id").alias("shared_id")), "shared")
    if not shared.limit(1).count():
        return docs, None
    known = shared.where("shared_id is not null")
    odd = asked(docs, "doc_id", known).unionByName(docs.where("doc_id is null"))
    highest = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    own = F.lit(highest + 1) + F.monotonically_increasing_id()
    odd = saved(odd.select(own.alias("own id"), F.struct("*").alias("row")), "odd")
    return without(docs.where("doc_id is not null"), "doc_id", known), odd


def drop_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns unchanged, with one row of each component of :func:`near_duplicates`.

    Rows are judged one by one: an id repeated with several texts names several
    documents, repeated rows are copies, and rows without an id take part like others.
    The row that stays has the smallest id (any one of rows that share it); a row without
    an id stays only if no row of its component has one.  Rows without a word all stay.
    """
    plain, odd = _named_rows(docs)
    named = plain.select("doc_id", "text")
    if odd is None:
        gone = near_duplicates(named, shingle, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
        return without(plain, "doc_id", saved(gone, "gone"))
    own = odd.select(F.col("own id").alias("doc_id"), F.col("row.doc_id").alias("given"), "row.text")
    judged = saved(near_duplicates(named.unionByName(own.drop("given")), shingle, percent), "judged")
    given = own.select("doc_id", F.struct(F.col("given").isNull().alias("nameless"), F.col("given").alias("first"), F.col("doc_id").alias("own")).alias("o"))
    plainly = F.struct(F.lit(False).alias("nameless"), F.col("doc_id").alias("first"), F.col("doc_id").alias("own"))
    placed = judged.join(given, "doc_id", "left").select("doc_id", "component_id", F.coalesce("o", plainly).alias("o"))
    best = placed.groupBy("component_id").agg(F.min("o").alias("best"))
    gone = saved(placed.join(best, "component_id").where("o <> best").select(F.col("doc_id").alias("gone_id")), "gone")
    return without(plain, "doc_id", gone).unionByName(without(odd, "own id", gone).select("row.*"))
