"""The pipeline stage by stage, on the given tables."""

import public_tokenizers

import corpus_pipeline as P
import __spark_entry__ as E
from tidefeed.llm import decontamination, near_dedup, quality_classifier, quality_rules, sentencepiece_codec

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = [docs]
    for name, stage in P.STAGES[:-1]:
        now = P.saved(stage(spark, kept[-1], SF), "test")
        assert now.columns == docs.columns and now.join(kept[-1], docs.columns, "left_anti").count() == 0, name
        kept.append(now)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    good = quality_classifier.classify(kept[0], quality_classifier.fit_classifier(kept[0], labels)).where("predicted = 1")
    assert ids[1] == {r["doc_id"] for r in good.collect()} < ids[0]
    passed = quality_rules.judge(kept[1], quality_rules.fit_rules(kept[1], labels)).where("kept")
    assert ids[2] == {r["doc_id"] for r in passed.collect()} < ids[1]
    assert ids[3] == {r["doc_id"] for r in near_dedup.near_duplicates(kept[2]).where("kept").collect()} < ids[2]
    leaks = {r["doc_id"] for r in decontamination.contaminated(kept[3], benchmark).collect()}
    assert ids[4] == ids[3] - leaks < ids[3]
    last = P.STAGES[-1][1](spark, kept[-1], SF).collect()
    assert {r["doc_id"] for r in last} == ids[4]
    library = sentencepiece_codec._processor(sentencepiece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    texts = {r["doc_id"]: r["text"] for r in kept[-1].collect()}
    assert all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)) for r in last)
    assert sorted(r["ids_sha256"] for r in P.run(spark, SF).collect()) == sorted(r["ids_sha256"] for r in last)


def test_clean_labelled_documents_stay(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = P.apply_rules(spark, P.saved(P.classify(spark, docs, SF), "test"), SF)
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    long = [r["doc_id"] for r in clean.collect() if len(r["text"].split()) >= 50]
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(d in ids for d in long) >= 0.98 * len(long)


def test_everything_is_registered():
    names = [n for n in E.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
