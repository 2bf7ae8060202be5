"""Decontamination against a plain edit-distance search."""

import random

import numpy as np

from tidefeed.llm import decontamination as D

SF = "/root/testdata/sf0.01"


def brute_distance(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
    return min(row)


def found_in(index, text):
    codes, bounds, _, _ = next(D._slices([text], 2000))
    return {(int(index.ids[item]), edits) for _, item, _, _, edits in D.occurrences(index, codes, bounds)}


def test_same_items_and_edits_as_brute_force():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "omega", "x", "run", "sigma"]
    items = [(n, " ".join(rng.choices(words, k=rng.randint(4, 18)))) for n in range(12)]
    index = D.ItemIndex.of(items)
    for _ in range(60):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 12)):
            at, kind = rng.randrange(len(item)), rng.choice("sid")
            if kind == "s":
                item[at] = "q"
            elif kind == "d":
                del item[at]
            else:
                item.insert(at, "z")
        text = " ".join(rng.choices(words, k=20)) + " " + "".join(item) + " " + " ".join(rng.choices(words, k=10))
        plain = "".join(map(chr, D.normalised(text)[0]))
        expected = set()
        for n, (_, codes) in enumerate(zip(index.ids, index.codes)):
            edits = brute_distance("".join(map(chr, codes)), plain)
            if edits <= index.budget[n]:
                expected.add((int(index.ids[n]), edits))
        best = {}
        for item_id, edits in found_in(index, text):
            best[item_id] = min(edits, best.get(item_id, 99))
        assert set(best.items()) == expected


def test_spans_name_the_place_in_the_text():
    index = D.ItemIndex.of([(7, "The quick, brown fox jumps over!")])
    text = "Ünrelated -- «THE  quick brown\nfox*** jumps OVER»; end"
    codes, bounds, _, places = next(D._slices([text], 200))
    [(_, _, start, end, edits)] = D.occurrences(index, codes, bounds)
    assert edits == 0 and text[places[0][start]:places[0][end - 1] + 1] == "THE  quick brown\nfox*** jumps OVER"


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(D, "SLICE", 500)
    item = "a passage that must be found wherever it lies"
    index = D.ItemIndex.of([(1, item)])
    filler = "lorem ipsum dolor sit amet " * 100
    for at in range(0, 1500, 37):
        text = filler[:at] + item + filler[at:]
        hits = [(int(p[s - b[w]]), int(p[e - 1 - b[w]]) + 1) for codes, b, who, ps in D._slices([text], 2 * len(item))
                for w, i, s, e, k in D.occurrences(index, codes, b) for p in [ps[w]] if k == 0]
        assert (at, at + len(item)) in hits


def test_a_passage_across_two_documents_is_none():
    index = D.ItemIndex.of([(1, "one passage that is split between documents")])
    codes, bounds, _, _ = next(D._slices(["xx one passage that is", "split between documents yy"], 200))
    assert D.occurrences(index, codes, bounds) == []


def test_whole_table_against_substring_search(spark):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, benchmark).collect()}

    def plain(text):
        return "".join(map(chr, D.normalised(text)[0])).strip()

    items = {r["item_id"]: plain(r["text"]) for r in benchmark.collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in plain(r["text"])}
    assert exact and exact <= got and len(got - exact) <= len(exact) // 10
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, benchmark).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}


def test_odd_rows(spark):
    leak = "this very passage is in the benchmark set"
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (None, leak, 0), (3, f"so {leak} ok", 0), (3, f"so {leak} ok", 0), (4, "clean", 1)],
        "doc_id long, text string, gone_id int")
    benchmark = spark.createDataFrame([(1, leak, 5), (1, leak, 5), (2, None, 5), (3, "", 5), (4, "short", 5), (None, "clean text here", 5)],
                                      "item_id long, text string, doc_id int")
    rows = {tuple(r) for r in D.contaminated(docs, benchmark).collect()}
    assert rows == {(None, 1, 0, len(leak), 0), (3, 1, 3, 3 + len(leak), 0)}
    left = D.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4", "None"]
    assert D.contaminated(docs.limit(0), benchmark).count() == 0
    assert D.contaminated(docs, benchmark.limit(0)).count() == 0


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r) for r in D.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(D, "BLOCK_CHARS", 4000)
    assert {tuple(r) for r in D.contaminated(docs, benchmark).collect()} == whole


def test_bound_is_never_below_one():
    index = D.ItemIndex.of([(n, "abcdefgh " * n) for n in range(1, 60)])
    assert (index.bound >= 1).all() and (np.diff(index.budget) >= 0).all()


def test_rows_and_items_without_an_id(spark, tmp_path):
    import corpus_pipeline as P
    leak, second = "this very passage is in the benchmark set", "another passage whose item has no name"
    docs = spark.createDataFrame([(None, leak, 1), (None, "clean", 2), (None, None, 3), (1, f"so {second} ok", 4), (2, "clean", 5), (None, leak + "!", 6)],
                                 "doc_id long, text string, key int")
    benchmark = spark.createDataFrame([(1, leak), (None, second)], "item_id long, text string")
    rows = {tuple(r) for r in D.contaminated(docs, benchmark).collect()}
    assert rows == {(None, 1, 0, len(leak), 0), (1, None, 3, 3 + len(second), 0)}
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = P.decontaminate(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r["key"] for r in left.collect()) == [2, 3, 5]


def test_an_occurrence_across_a_cut_is_one_row(spark):
    from tidefeed.llm import decontamination as D
    rng = random.Random(8)
    item = "".join(rng.choice("bcdfghjklm") for _ in range(210))
    for at in (D.SLICE - 10, D.SLICE - 205, D.SLICE + 300, D.SLICE + 415):
        text = "".join(rng.choice("nopqrstuvw") for _ in range(at)) + item + "".join(rng.choice("nopqrstuvw") for _ in range(D.SLICE))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = D.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
        assert [tuple(r) for r in found] == [(1, 7, at, at + 210, 0)]


def test_repetitive_text_and_item_take_bounded_memory():
    import tracemalloc
    from tidefeed.llm import decontamination as D
    index = D.ItemIndex.of([(1, "a" * 1000)])
    codes = D.normalised("a" * 100_000)[0]
    tracemalloc.start()
    bands = D.candidate_bands(index, codes, np.zeros(len(codes), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bands) and peak < 500e6
    small = D.normalised("a" * 3000)[0]
    whole = D.candidate_bands(index, small, np.zeros(3000, np.int64))
    held, D._PAIRS = D._PAIRS, 1000
    try:
        assert (D.candidate_bands(index, small, np.zeros(3000, np.int64)) == whole).all()
    finally:
        D._PAIRS = held
