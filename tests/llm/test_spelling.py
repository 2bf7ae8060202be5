"""Near words against all pairs, variants against the contract in plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefeed.llm import edit_scan, queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1:] or len(a) == len(b) and a[at + 1:] == b[at + 1:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.text("abcÿ", min_size=1, max_size=8), max_size=25), max_size=4))
def test_scan_finds_all_pairs_of_a_cell(groups):
    words = [w for g in groups for w in sorted(g)]
    cell = np.array([k for k, g in enumerate(groups) for _ in g], np.int64)
    got = [(int(a), int(b)) for x, y in edit_scan.near_pairs(words, cell) for a, b in zip(x, y)]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in range(len(words)) for b in range(a + 1, len(words))
                        if cell[a] == cell[b] and one_edit(words[a], words[b])}


def contract(rows):
    n = Counter()
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: set() for w in n}
    by_rest = {}
    for w in n:
        for i in range(len(w)):
            by_rest.setdefault(w[:i] + w[i + 1:], set()).add(w)
            by_rest.setdefault(w, set()).add(w)
    for group in by_rest.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def variants(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in spelling.variants(docs, queries.dropped_letter).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_meets_the_contract(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == contract(rows) and len(got) > 1000


def test_hot_cells_are_cut(spark, monkeypatch):
    """All words share a prefix, so cells are cut into slices that meet two by two."""
    monkeypatch.setattr(spelling, "CELL_WORDS", 10)
    words = [f"aaaaa{x}{y}" for x in "abcdefgh" for y in "abcdefgh"] + ["aaaaa", "aaaaaa"]
    rows = [(k, " ".join(words) + " " + " ".join(words[k::7])) for k in range(5)]
    assert variants(spark, rows) == contract(rows)


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BATCH_WORDS", 7)
    table = spark.createDataFrame(pd.DataFrame({"word": [f"word{a}{b}" for a in "abcdefg" for b in "abcdefg"], "n": range(3, 52)}))
    got = {(r.word, r.near) for r in spelling.near_words(table).collect()}
    words = [r.word for r in table.collect()]
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "house " * 9 + "HOUSE housé housé housé houses houses houses×÷"), (3, "ho use house's"),
            (None, "house house"), (4, "tie" * 50_000 + " " + "house"), (5, "tie" * 50_000), (6, "tie" * 50_000),
            (7, "batía batía batía batéa batéa batéa " + "batøa " * 9), (7, "batXa " * 9)]
    assert variants(spark, rows) == contract(rows)
    assert variants(spark, []) == set()
    clash = spark.createDataFrame([(1, "words words words", 1, "x")], "doc_id long, text string, n int, word string")
    assert [tuple(r) for r in spelling.variants(clash).collect()] == [("words", None, "words", 3, 0, None)]
    assert [r.n for r in spelling.variants(clash, least_length=1, least_count=1).collect()] == [3]
