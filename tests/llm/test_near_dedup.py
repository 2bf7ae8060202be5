"""Near-duplicates against all pairs; components against union-find."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefeed.llm import near_dedup as N
from tidefeed.llm.components import components
from tidefeed.llm.shingles import WordHashes, shingle_set

SF = "/root/testdata/sf0.01"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(docs, size, percent=80):
    sets = {d: shingles(t, size) for d, t in docs}
    keys = sorted(sets)
    edges = []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                edges.append((b, a))
    named = roots(keys, edges)
    return {(d, len(sets[d]), named[d], named[d] == d) for d in keys}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    named = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert named == {n: r for n, r in roots({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]]).items()}


def test_a_long_chain_is_one_component(spark):
    edges = [(n, n + 1) for n in range(60)]
    random.Random(1).shuffle(edges)
    assert {r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}


def test_sketch_estimates_high_similarities(spark):
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90, 97):
        misses = []
        for _ in range(40):
            whole = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            cut = 3 * (100 - percent)
            sketches = N.odd_sketches(N.minhash([np.unique(whole[cut:]), np.unique(whole[:600 - cut])]))
            z = sum(int(x).bit_count() for x in (sketches[0] ^ sketches[1]).view(np.uint64))
            misses.append(100 + 50 * N.SKETCH_BITS * np.log(1 - min(2 * z / N.SKETCH_BITS, 0.999)) / (2 * N.SAMPLES) - percent)
        assert abs(np.mean(misses)) < 3 and np.std(misses) < 6


def near_copies(seed, groups, copies, words=60):
    """Groups of near copies at all distances, chains of small changes, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    docs, number = [], 0
    for _ in range(groups):
        text = rng.choices(vocabulary, k=words)
        for _ in range(copies):
            now = list(text)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                now[rng.randrange(words)] = rng.choice(vocabulary)
            docs.append((number, " ".join(now)))
            number += 1
            if rng.random() < 0.3:
                text = now
    rng.shuffle(docs)
    return docs


def result(spark, docs, size, extra=False):
    frame = spark.createDataFrame([(d, t, 1, "z", 2) for d, t in docs], "doc_id long, text string, id int, bucket string, component int")
    return {tuple(r) for r in N.near_duplicates(frame, size).collect()}


def test_groups_and_chains_equal_all_pairs(spark):
    docs = near_copies(7, 12, 30) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "w1 " * 400)]
    assert result(spark, docs, 2) == brute(docs, 2)
    assert result(spark, docs, 5) == brute(docs, 5)


def test_one_large_group_of_near_copies(spark):
    docs = near_copies(11, 1, 500, 40)
    assert result(spark, docs, 2) == brute(docs, 2)


def test_whole_table_with_production_parameters(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(spark, docs, 5) == brute(docs, 5)


def test_odd_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C  D E F"), (None, None)]
    assert result(spark, docs, 2) == {(1, 5, 1, True), (2, 5, 1, False), (None, 5, None, True), (None, 0, None, True)}
    frame = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, gone_id int")
    left = N.drop_duplicates(frame)
    assert left.columns == frame.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "None"]
    assert N.near_duplicates(frame.limit(0)).count() == 0


def test_shingles_of_short_texts_are_the_whole_sequence():
    hashes = WordHashes()
    assert len(shingle_set(hashes.of("a b c"), 5)) == 1 and len(shingle_set(hashes.of(" "), 5)) == 0
    assert shingle_set(hashes.of("a b"), 5)[0] != shingle_set(hashes.of("b a"), 5)[0]


def test_sketches_miss_less_than_bands():
    from math import comb, log
    bits, missed = N.SKETCH_BITS, 0.0
    odd = np.zeros(bits + 1)  # chance of each number of odd bits after 2 n flips
    odd[0], k = 1.0, np.arange(bits + 1)
    similar = np.array([100 + 100 * bits / 2 * log(1 - min(2 * n / bits, 0.999)) / (2 * N.SAMPLES) for n in k])
    for n in range(N.SAMPLES + 1):
        missed += comb(N.SAMPLES, n) * 0.2 ** n * 0.8 ** (N.SAMPLES - n) * odd[similar < 80 - N.SLACK].sum()
        for _ in range(2):
            more = np.zeros(bits + 1)
            more[1:] += odd[:-1] * (bits - k[:-1]) / bits
            more[:-1] += odd[1:] * k[1:] / bits
            odd = more
    assert missed < (1 - 0.8 ** N.ROWS) ** N.BANDS


def test_rows_that_share_an_id_or_have_none(spark):
    """Each text stays once, whatever ids its rows carry."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abce")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (None, b), (None, b), (None, e), (None, e), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long, `own id` string")
    left = N.drop_duplicates(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(3, b), (5, a), (7, c), (None, e), (None, None), (9, ""), (9, "")], key=str)
    near = [(1, a), (1, a + " tail"), (2, b), (None, a + " end")]
    left = N.drop_duplicates(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in left) == [(1, "a0"), (2, "b0")]
    assert [r.doc_id for r in N.drop_duplicates(spark.createDataFrame([(4, a), (2, a), (4, b), (None, a)], "doc_id long, text string")).orderBy("doc_id").collect()] == [2, 4]
