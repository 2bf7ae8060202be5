"""Threshold join of a block of queries with a block of vectors (small numpy kernel).

Dimensions are taken strongest first.  A vector's last dimensions, whose norm alone
cannot reach the lowest threshold, stay out of the inverted index; partial scores
are accumulated over the indexed dimensions a few at a time, and pairs that cannot
reach their query's threshold with the norms that remain are dropped.  The few pairs
left get their whole inner product.
"""

from __future__ import annotations

import numpy as np

#: Dimensions accumulated between two prunings, and queries handled at once.
STEP, QUERIES = 8, 128
#: Partial scores are given up for single pairs once this share of a block is still possible.
FEW = 0.1
#: Room for rounding in the bounds; scores themselves are exact.
_SLACK = 1e-9
#: Whole numbers up to here are exact in a double.
_EXACT = 2.0 ** 53


def suffix_norms(vectors: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from ``j`` on, for every ``j`` (vectors x dimensions + 1)."""
    out = np.zeros((len(vectors), vectors.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(vectors[:, ::-1] ** 2, axis=1))[:, ::-1]
    return out


def indexed_dimensions(rest: np.ndarray, least: float) -> np.ndarray:
    """How many leading dimensions of each vector are indexed; the norm of the others is below ``least``."""
    return np.minimum((rest >= least * (1 - _SLACK)).sum(1), rest.shape[1] - 1)


def _whole(queries: np.ndarray, vectors: np.ndarray, floors: np.ndarray):
    """All pairs by Python's whole numbers, for components whose products a double cannot hold."""
    def exact(m: np.ndarray) -> np.ndarray:
        return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)

    scores = exact(queries) @ exact(vectors).T if queries.shape[1] else np.zeros((len(queries), len(vectors)), object)
    q, v = np.nonzero(scores >= np.array([int(np.ceil(f)) for f in floors], object)[:, None])
    top = (1 << 63) - 1
    return q, v, np.array([max(-top, min(top, s)) for s in scores[q, v]], np.int64)


def pairs_above(queries: np.ndarray, vectors: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of queries and vectors, and scores, of all pairs that score at least the query's floor.

    Components are whole numbers held in doubles.  Scores are exact; those beyond 64
    bits come out as the largest or smallest 64-bit number.
    """
    none = np.empty(0, np.int64)
    if not len(queries) or not len(vectors):
        return none, none, none
    with np.errstate(over="ignore"):
        q_norm, v_norm = np.sqrt((queries ** 2).sum(1)), np.sqrt((vectors ** 2).sum(1))
    if not q_norm.max() * v_norm.max() < _EXACT:
        return _whole(queries, vectors, floors)

    strongest = np.argsort(-(vectors ** 2).sum(0), kind="stable")
    q, v = queries[:, strongest], vectors[:, strongest]
    possible = (floors <= 0) | (q_norm > 0)  # a query of norm 0 scores 0 with everything
    least = np.min(np.where(floors > 0, floors / np.maximum(q_norm, 1e-300), 0)[possible], initial=np.inf)
    q_rest, v_rest = suffix_norms(q), suffix_norms(v)
    cut = indexed_dimensions(v_rest, least)
    by_cut = np.argsort(-cut, kind="stable")  # the postings of a dimension are then the first rows
    by_cut = by_cut[(cut[by_cut] > 0) | (least <= 0)]
    v, v_rest, cut = v[by_cut], v_rest[by_cut], cut[by_cut]
    index = np.where(np.arange(v.shape[1]) < cut[:, None], v, 0.0)

    found = []
    for at in range(0, len(q), QUERIES):
        mine = slice(at, at + QUERIES)
        a, b = _candidates(q[mine], q_rest[mine], floors[mine], index, v_rest, cut)
        for part in range(0, len(a), 1 << 17):
            i, j = a[part:part + (1 << 17)], b[part:part + (1 << 17)]
            score = np.einsum("ij,ij->i", q[mine][i], v[j])
            hit = score >= floors[mine][i]
            found.append((i[hit] + at, by_cut[j[hit]], score[hit].astype(np.int64)))
    if not found:
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*found))


def _candidates(q, q_rest, floors, index, v_rest, cut):
    """Pairs that the norms allow, after accumulating indexed dimensions while many are possible."""
    live = np.arange(len(index))
    partial = np.zeros((len(q), len(index)))
    alive = np.ones(partial.shape, bool)
    need = floors[:, None] - _SLACK * (1 + np.abs(floors[:, None]))
    for at in range(0, index.shape[1], STEP):
        n = int(np.searchsorted(-cut[live], -at, "left"))  # rows with more than `at` indexed dimensions
        partial[:, :n] += q[:, at:at + STEP] @ index[live[:n], at:at + STEP].T
        upto = np.minimum(at + STEP, cut[live])
        alive = partial + q_rest[:, upto] * v_rest[live, upto] * (1 + _SLACK) >= need
        keep = alive.any(0)
        live, partial, alive = live[keep], partial[:, keep], alive[:, keep]
        if not n or alive.sum() <= FEW * len(q) * len(index):
            break
    a, b = np.nonzero(alive)
    return a, live[b]
