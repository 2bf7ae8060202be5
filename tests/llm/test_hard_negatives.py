"""Hard negatives and the threshold join against all pairs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefeed.llm import hard_negatives as H
from tidefeed.llm.l2ap import indexed_dimensions, pairs_above, suffix_norms

FIFTIETH = staticmethod(lambda vec_id: vec_id % 50 == 0).__func__


def brute(rows, k=5, m=3):
    """The contract, pair by pair, in Python's whole numbers."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, list(v))), (label, list(v)))
    rows = [(i, label, [int(x) for x in v]) for i, (label, v) in best.items()]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = set()
    for i, label, v in rows:
        if i % 50:
            continue
        scored = sorted((-score(v, w), j, other) for j, other, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            inside = [(n, b) for n, b, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out |= {(i, j, r + 1, b, -p, -n) for r, (n, b) in enumerate(inside[:m])}
    return out


def mined(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = [tuple(r) for r in H.mine(table, FIFTIETH, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 30), st.floats(-0.5, 1.0))
def test_threshold_join_is_whole(seed, dims, share):
    rng = np.random.default_rng(seed)
    q = rng.integers(-9, 10, (rng.integers(0, 40), dims)).astype(float)
    v = rng.integers(-9, 10, (rng.integers(0, 200), dims)) * rng.integers(0, 3, dims).astype(float)
    top = np.abs(q @ v.T).max(initial=0)
    floors = np.floor(share * top * rng.random(len(q)))
    a, b, s = pairs_above(q, v, floors)
    scores = q @ v.T
    assert {(int(x), int(y), int(z)) for x, y, z in zip(a, b, s)} == {
        (x, y, int(scores[x, y])) for x, y in np.argwhere(scores >= floors[:, None]).tolist()}


def test_index_leaves_out_weak_dimensions():
    v = np.array([[9.0, 3.0, 1.0, 1.0], [1.0, 1.0, 0.0, 0.0]])
    assert indexed_dimensions(suffix_norms(v), 2.0).tolist() == [2, 0]
    assert indexed_dimensions(suffix_norms(v), -1.0).tolist() == [4, 4]


def test_numbers_beyond_doubles_and_64_bits():
    big = float(1 << 40)
    q, v = np.array([[big, 1.0]]), np.array([[big, 1.0], [big, 0.0], [-big * 2 ** 10, 0.0]])
    _, b, s = pairs_above(q, v, np.array([-float(1 << 62)]))
    assert b.tolist() == [0, 1] and s.tolist() == [(1 << 63) - 1] * 2
    _, b, s = pairs_above(np.array([[float(1 << 29), 1.0]]), np.array([[float(1 << 29), 1.0], [0.0, 0.0]]), np.array([0.0]))
    assert s.tolist() == [(1 << 58) + 1, 0]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(H, "ROW_BLOCK", 90)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 3)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (4, 12))
    rows = [(i, int(i % 4 if i % 3 else 0), np.floor(centres[i % 4] + rng.normal(0, 25, 12)).tolist()) for i in range(420)]
    want = brute(rows)
    assert len(want) > 40 and mined(spark, rows) == want
    assert mined(spark, rows, n_positives=2, n_negatives=1) == brute(rows, 2, 1)


def test_one_text_many_times(spark, monkeypatch):
    """Ties by the hundred, most rows of one label, and negatives equal to the anchor."""
    monkeypatch.setattr(H, "ROW_BLOCK", 64)
    rows = [(i, 1, [3.0, 4.0]) for i in range(200)] + [(i, 2, [2.0, 3.0] if i % 2 else [3.0, 4.0]) for i in range(200, 300)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, 1, [2.0, 2.0]), (0, 1, [2.0, 2.0]), (0, 1, [3.0, 2.0]), (None, 1, [9.0, 9.0]), (50, None, [2.0, 2.0]), (1, 1, None),
            (2, 1, [2.0, None]), (3, 1, [float("nan"), 1.0]), (4, 1, [float("inf"), 1.0]), (5, 1, [2.0, 1.0]), (6, 1, []),
            (7, 2, [1.0, 1.0]), (8, 2, [1.0]), (9, 2, [0.0, 0.0]), (100, 2, [0.0, 0.0]), (150, 3, [-1.0, -1.0]), (-50, 2, [1.0, 1.0])]
    got = mined(spark, rows)
    padded = [(i, l, v and (v + [0.0, 0.0])[:2] if v is not None else v) for i, l, v in rows]
    padded = [(i, l, [0.0, 0.0] if v == [] else v) for i, l, v in padded]
    assert got == brute(padded) and got
    clash = spark.createDataFrame([(0, 1, [1.0], 3, 4), (1, 1, [2.0], 3, 4)], "vec_id long, label int, embedding array<double>, rank int, id int")
    assert H.mine(clash, FIFTIETH).collect() == []
    assert mined(spark, []) == set()
    assert mined(spark, [(1, 1, [1.0])]) == set()


def test_quantised(spark):
    df = spark.createDataFrame([([0.05424950644373894, -0.001, 1e300, None],)], "e array<double>")
    assert df.select(H.quantised(df.e)).first()[0] == [13.0, -1.0, 2.56e302, None]
