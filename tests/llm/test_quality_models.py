"""Boosted trees, document statistics and the two quality operators."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefeed.llm import doc_stats as S
from tidefeed.llm import quality_classifier, quality_rules
from tidefeed.llm.gbt import Params, train

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, score double, s string, label int"  # the last three clash with inner names


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b é", max_size=60))
def test_counts_match_brute_force(text):
    assert S.text_stats(text)[:5] == brute_counts(text)


def test_flat_scoring_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = train(x, y, Params(trees=10, depth=3))

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = (model.left if row[model.feature[node]] <= model.threshold[node] else model.right)[node]
            total += model.value[node]
        return total

    assert np.allclose(model.margin(x), [walk(r) for r in x])
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.9


def test_monotone_columns_never_turn():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(600, 3))
    y = (np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 600) > 0.5).astype(float)
    model = train(x, y, Params(trees=30, depth=4), {0: -1})
    base = rng.uniform(size=(200, 3))
    steps = []
    for value in np.linspace(-0.1, 1.1, 25):
        moved = base.copy()
        moved[:, 0] = value
        steps.append(model.margin(moved))
    assert (np.diff(np.array(steps), axis=0) <= 1e-12).all()


@pytest.mark.parametrize("labels", [[], [1.0] * 4, [0.0] * 4])
def test_without_both_labels_the_model_is_constant(labels):
    model = train(np.zeros((len(labels), 2)), np.array(labels))
    assert len(set(model.probability(np.random.default_rng(0).normal(size=(5, 2))))) == 1


def test_held_out_accuracy_and_folds(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit_classifier(docs, labels)
    rows = quality_classifier.classify(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97
    rules = quality_rules.judge(docs, quality_rules.fit_rules(docs, labels)).join(labels, "doc_id").collect()
    judged = [r for r in rules if not r["base_failed"]]
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in judged]) > 0.97


def test_odd_rows(spark):
    rows = [(1, None, 0.0, "", 1), (2, "", 0.0, "", 0), (None, "a b", 0.0, "", 1), (3, "x " * 60, 0.0, "", 1),
            (3, "x " * 60, 0.0, "", 1), (4, "w" * 300_000, 0.0, "", 0)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    model = quality_classifier.fit_classifier(docs, labels)
    out = quality_classifier.classify(docs, model)
    assert out.count() == 6 and out.where("score between 0 and 1 and predicted in (0, 1)").count() == 6
    rules = quality_rules.fit_rules(docs, labels)
    judged = {(r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.judge(docs, rules).collect()}
    assert judged == {(1, 0, 0, True), (2, 0, 0, True), (None, 2, 0, True), (3, 60, 60, True), (4, 1, 0, True)}
    assert quality_classifier.keep_good(docs, model).columns == docs.columns
    assert quality_rules.keep_passing(docs, rules).count() == 0
    empty = docs.limit(0)
    assert quality_classifier.classify(empty, quality_classifier.fit_classifier(empty, labels.limit(0))).count() == 0
    assert quality_rules.judge(empty, rules).count() == 0
