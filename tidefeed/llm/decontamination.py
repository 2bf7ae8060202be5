"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Documents and benchmark items are compared as lower-case letters and digits with
one space for everything between.  An item of m characters that occurs in a
document with at most k edits shares at least m - q + 1 - k q character q-grams
with it, all on diagonals (document place minus item place) at most k apart.  So
shared q-grams are counted in overlapping bands of diagonals, bands that reach
the bound are regions to look at, and a banded alignment confirms each region or
drops it.

Documents are read once per block of items and nothing is shuffled.  Items are a
stated query set: they are split by hash into blocks of a bounded size, and one
block at a time is indexed and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .id_filter import without

#: Length of a q-gram; the three doublings in :func:`gram_keys` make eight.
Q = 8
#: Edits allowed per 100 characters of an item.
EDIT_PERCENT = 10
#: Characters of items in one block (about 20 bytes of index for each).
BLOCK_CHARS = 2_000_000
#: Normalised characters compared at once.
SLICE = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22
_SPACE = 32


def _letters() -> np.ndarray:
    """Lower-case code of every letter or digit below 0x3000, 0 for everything else."""
    table = np.zeros(0x3000, np.uint32)
    for code in range(len(table)):
        if chr(code).isalnum():
            low = chr(code).lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_LETTERS = _letters()


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the compared characters of a text, and the place of each in the text."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(raw) and raw.max() >= len(_LETTERS):
        codes = np.where(raw < len(_LETTERS), _LETTERS[np.minimum(raw, len(_LETTERS) - 1)], raw)
    else:
        codes = _LETTERS[raw]
    letter = codes != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    places = np.flatnonzero(keep)
    codes = codes[places]
    codes[codes == 0] = _SPACE
    return codes, places


def gram_keys(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key for the eight characters from each place on."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    factor = _MULTIPLIER
    keys = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):
            keys = keys[:-step] * factor + keys[step:]
            factor = factor * factor
    return keys


@dataclass(frozen=True)
class ItemIndex:
    """Q-grams of a block of items, sorted by key, with each item's edit budget and bound."""

    ids: np.ndarray
    codes: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], edit_percent: int = EDIT_PERCENT) -> ItemIndex:
        """Index items; those with fewer than Q compared characters are too short to name and are left out.

        A short item's budget is lowered until the lemma's bound is at least one
        shared q-gram, so the filter never loses an occurrence within the budget.
        """
        named = []
        for item_id, text in items:
            codes = normalised(text)[0]
            codes = codes[:-1] if len(codes) and codes[-1] == _SPACE else codes
            if len(codes) >= Q:
                named.append((item_id, codes))
        sizes = np.array([len(c) for _, c in named], np.int64)
        budget = np.minimum(sizes * edit_percent // 100, (sizes - Q) // Q)
        grams = [gram_keys(c) for _, c in named]
        keys = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(named)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        seen = np.zeros(1 << _TABLE_BITS, bool)
        seen[_slot(keys)] = True
        return cls(np.array([i for i, _ in named], object), [c for _, c in named], budget,
                   sizes - Q + 1 - budget * Q, keys, np.append(first, len(order)), item[order], place[order], seen)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


#: Pairs of equal q-grams (one of a text, one of an item) held at once.
_PAIRS = 1 << 21


def shared_grams(index: ItemIndex, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item, item place and document place of every q-gram shared with an item, in pieces of about ``_PAIRS``.

    A repetitive text shares each of its q-grams with many places of a repetitive item.
    """
    keys = gram_keys(codes)
    at = np.flatnonzero(index.seen[_slot(keys)])
    slot = np.searchsorted(index.keys, keys[at])
    known = index.keys[np.minimum(slot, len(index.keys) - 1)] == keys[at]
    at, slot = at[known], slot[known]
    times = index.first[slot + 1] - index.first[slot]
    piece = np.cumsum(times) // _PAIRS
    for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(piece)) + 1):
        a, s, t = at[cut], slot[cut], times[cut]
        entry = np.repeat(index.first[s] - np.append(0, np.cumsum(t)[:-1]), t) + np.arange(t.sum())
        yield index.item[entry], index.place[entry], np.repeat(a, t)


def candidate_bands(index: ItemIndex, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows ``(owner, item, band)`` whose band of diagonals reaches the item's bound.

    Band b of an item with budget k covers the 2 (k + 1) diagonals from b (k + 1) on,
    so any k + 1 neighbouring diagonals lie in one band.  ``owner`` numbers the
    document of each character.
    """
    # One sortable number per (owner, item, cell); cells may be negative near the start.
    span = len(codes) + 2 * int(max(map(len, index.codes))) + 4
    counted = []
    for item, place, at in shared_grams(index, codes):
        cell = (at - place) // (index.budget[item] + 1)
        counted.append(np.unique((owner[at] * len(index.ids) + item) * span + cell + span - len(codes) - 2, return_counts=True))
    cells, where = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
    if not len(cells):
        return np.empty((0, 3), np.int64)
    count = np.bincount(where, np.concatenate([n for _, n in counted])).astype(np.int64)
    follows = np.zeros(len(cells), np.int64)
    follows[:-1] = np.where(cells[1:] == cells[:-1] + 1, count[1:], 0)
    before = np.ones(len(cells), bool)
    before[1:] = cells[1:] != cells[:-1] + 1
    starts = np.concatenate([cells, cells[before] - 1])
    totals = np.concatenate([count + follows, count[before]])
    pair, cell = starts // span, starts % span - (span - len(codes) - 2)
    who, item = pair // len(index.ids), pair % len(index.ids)
    good = totals >= index.bound[item]
    return np.stack([who[good], item[good], cell[good]], axis=1)


def align(index: ItemIndex, items: np.ndarray, codes: np.ndarray, lows: np.ndarray, firsts: np.ndarray,
          lasts: np.ndarray) -> np.ndarray:
    """Best occurrence of each item in its band: rows ``(edits, start, end)``, edits above the budget if none.

    Band n covers the diagonals from ``lows[n]`` to ``lows[n] + 2 budget + 1`` inside
    ``codes[firsts[n]:lasts[n]]``.  All bands advance together, one item character
    at a time; a cell holds the edits and, below them, the start it was reached
    from, so the smallest number is the fewest edits with the earliest start.
    """
    sizes, widths = np.array([len(index.codes[i]) for i in items]), 2 * (index.budget[items] + 1)
    patterns = np.zeros((len(items), sizes.max()), np.uint32)
    for n, i in enumerate(items):
        patterns[n, :sizes[n]] = index.codes[i]
    unit, width = 1 << 40, int(widths.max())
    offsets = np.arange(width)
    at = lows[:, None] + offsets
    first, last = firsts[:, None], lasts[:, None]
    outside = np.int64(sizes.max() + width + 1) * unit
    narrow = offsets >= widths[:, None]
    row = np.where((at >= first) & (at <= last) & ~narrow, at + 1 - first, outside)  # starts count from 1
    ramp = offsets * unit
    result = np.empty((len(items), 3), np.int64)
    for i in range(patterns.shape[1]):
        valid = (at >= first) & (at < last)
        same = codes[np.minimum(np.maximum(at, 0), len(codes) - 1)] == patterns[:, i, None]
        new = np.where(valid, np.where(same, row, row + unit), outside)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + unit)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        row[narrow] = outside
        at = at + 1
        done = np.flatnonzero(sizes == i + 1)
        if len(done):
            best = row[done].argmin(axis=1)
            value = row[done, best]
            result[done] = np.stack([value // unit, value % unit - 1 + firsts[done], lows[done] + best + i + 1], axis=1)
    return result


#: Cells (bands x diagonals) aligned at once.
_ALIGNED = 400_000


def occurrences(index: ItemIndex, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``(document, item, start, end, edits)`` of items in the documents ``codes[bounds[i]:bounds[i + 1]]``."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bands = candidate_bands(index, codes, owner)
    bands = bands[np.argsort(index.budget[bands[:, 1]], kind="stable")]
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for part in np.array_split(bands, int((index.budget[bands[:, 1]] + 1).sum()) * 2 // _ALIGNED + 1):
        if not len(part):
            continue
        who, items, band = part.T
        hits = align(index, items, codes, band * (index.budget[items] + 1), bounds[who], bounds[who + 1])
        for n in np.flatnonzero(hits[:, 0] <= index.budget[items]):
            found.setdefault((int(who[n]), int(items[n])), []).append(tuple(hits[n].tolist()))
    return [(who, item, start, end, edits) for (who, item), hits in found.items() for edits, start, end in apart(hits)]


def apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping occurrences ``(edits, start, end)`` the one of fewest edits, then the earliest."""
    taken: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(hits):
        if all(end <= s or start >= e for _, s, e in taken):
            taken.append((edits, start, end))
    return taken


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                  ("edits", pa.int64()), ("key", pa.int64())])


def _slices(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[np.ndarray]]]:
    """Normalised texts joined up to SLICE characters; a longer text comes in overlapping parts."""
    parts: list[np.ndarray] = []
    who: list[int] = []
    places: list[np.ndarray] = []
    held = 0
    for n, text in enumerate(texts):
        codes, place = normalised(text)
        for at in range(0, max(len(codes) - overlap, 1), SLICE):
            part = slice(at, at + SLICE + overlap)
            parts.append(codes[part])
            places.append(place[part])
            who.append(n)
            held += len(parts[-1])
            if held >= SLICE:
                yield np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]), who, places
                parts, who, places, held = [], [], [], 0
    if held:
        yield np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]), who, places


def _found(docs: DataFrame, benchmark: DataFrame, edit_percent: int) -> DataFrame:
    """Rows of :func:`contaminated`, with a ``key`` of the text where the document's id is null."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = total // BLOCK_CHARS + 1
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("key"))
    columns = "doc_id long, item_id long, start long, end long, edits long, key long"
    found = spark.createDataFrame([], columns)
    for block in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = ItemIndex.of([(r["item_id"], r["text"]) for r in chosen], edit_percent)
        if not len(index.ids):
            continue
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            overlap = 2 * max(map(len, index.codes))
            for batch in batches:
                ids, texts, keys = (batch.column(n).to_pylist() for n in range(3))
                # slices of one text overlap: what both sides of a cut report is settled over the whole text
                hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for codes, bounds, who, places in _slices(texts, overlap):
                    for part, item, start, end, edits in occurrences(index, codes, bounds):
                        place = places[part]
                        hits.setdefault((who[part], item), []).append(
                            (edits, int(place[start - bounds[part]]), int(place[end - 1 - bounds[part]]) + 1))
                rows = [(ids[n], index.ids[item], start, end, edits, keys[n])
                        for (n, item), found_here in hits.items() for edits, start, end in apart(found_here)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t.type) for c, t in zip(zip(*rows) if rows else [[]] * 6, _OUT)], schema=_OUT)

        found = found.unionByName(texts.mapInArrow(search, columns))
    return found


def _text_key() -> Column:
    """Hash of the text of a row without an id; null for others."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT) -> DataFrame:
    """``doc_id, item_id, start, end, edits`` of every benchmark item found in a document.

    ``start`` and ``end`` are code points of the document's text, ``edits`` the edit
    distance between the compared characters, at most ``edit_percent`` of the item's.
    Overlapping occurrences of one item give one row, with the fewest edits.  Null
    and empty texts and items match nothing, nor do items of under Q letters;
    repeated documents, ids or items give the same rows once; documents and items with
    a null id are reported with a null id; a part of an item is no occurrence; empty
    tables give an empty result; other columns are ignored.
    """
    return _found(docs, benchmark, edit_percent).drop("key").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, nameless: bool = False) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, in which no benchmark item was found.

    Rows with a null id stay whatever their text is, unless ``nameless``: then those with an item in it go too.
    """
    leaks = saved(_found(docs, benchmark, EDIT_PERCENT).select("doc_id", "key").distinct(), "leaks")
    gone = leaks.where("doc_id is not null").select(F.col("doc_id").alias("gone_id"))
    if not nameless:
        return without(docs, "doc_id", gone)
    texts = leaks.where("doc_id is null").select(F.col("key").alias("leaking text"))
    left = docs.where("doc_id is null").join(texts, _text_key() == F.col("leaking text"), "left_anti")
    return without(docs.where("doc_id is not null"), "doc_id", gone).unionByName(left)
