"""Language-model scores against counts kept in plain dictionaries."""

import collections
import math
import zlib

import numpy as np

from tidefeed.llm import lm_score as L
from tidefeed.llm.shingles import WordHashes

SF = "/root/testdata/sf0.01"


def brute(docs):
    words = [(d, (t or "").encode().lower().split() + [None]) for d, t in docs]
    held = [zlib.crc32((str(d) if d is not None else "").encode()) % 10 == 0 for d, _ in docs]
    count, pairs, history = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, w), out in zip(words, held):
        if not out:
            count.update(w)
            history["<s>"] += 1
            pairs.update(zip(["<s>", *w], w))
    history.update(count)
    n, v = sum(count.values()), len(count)
    rows = []
    for (d, w), out in zip(words, held):
        p = [(count[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        score = sum(math.log10((pairs[h, x] + L.PRIOR * q) / (history[h] + L.PRIOR)) for h, x, q in zip(["<s>", *w], w, p))
        rows.append((d, out, len(w), sum(count[x] > 0 for x in w), n, round(sum(map(math.log10, p)), 6), round(score, 6)))
    return rows


def scored(frame, **options):
    return [(r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in L.score_documents(frame, **options).collect()]


def test_whole_table_in_many_blocks_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = scored(docs, block_chars=200_000)
    assert sorted(rows) == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the base on texts it has not seen


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "A a\x0bb"), (3, "A a\x0bb"), (None, "a"), (4, "é É \xa0"), (5, "x" * 100_000), (6, "b a " * 3000)]
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, block int, train string")
    rows = scored(frame, block_chars=1000)
    assert sorted(map(str, rows)) == sorted(map(str, brute(docs)))
    assert scored(frame.limit(0)) == []


def test_without_training_documents(spark):
    held = next(n for n in range(100) if zlib.crc32(str(n).encode()) % 10 == 0)
    frame = spark.createDataFrame([(held, "some words")], "doc_id long, text string")
    assert scored(frame) == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_probabilities_sum_to_one():
    texts = ["a b a c", "b b a", "c"]
    block = L.Block(texts, np.ones(3, bool))
    tokens, types = int(block.word_counts.sum()) - 3, len(block.word_keys) - 1  # without the start
    machine = L.Automaton(block, block.word_counts, block.pair_counts, tokens, types)
    unseen = 0.1 / (tokens + 0.1 * (types + 1))
    end = int(np.flatnonzero(block.word_keys == np.uint64(WordHashes()[L._END]))[0])
    for state in set(range(len(block.word_keys))) - {end}:  # nothing follows the end
        mine = (block.history == state) & machine.has_arc
        others = set(range(len(block.word_keys))) - set(block.word[mine].tolist()) - {block.start}
        rest = sum(10 ** machine.root[w] for w in others) + unseen
        assert abs((10 ** machine.arc[mine]).sum() + 10 ** machine.failure[state] * rest - 1) < 1e-9


def test_packed_keys_and_counts():
    rng = np.random.default_rng(6)
    for n in (1, 2, 50, 5000):
        for top in (300, 1 << 40, (1 << 64) - 1):
            keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (L.unpack_keys(L.pack_keys(keys)) == keys).all()
    for counts in ([], [0, 1], [200], [70_000, 1], [1 << 40]):
        assert L.unpack_counts(L.pack_counts(np.array(counts, np.int64))).tolist() == counts
