"""Corpus pipeline: five stages over ``documents``, each one of the operators in ``tidefeed.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
rows of documents with their columns unchanged; the last returns every document
that is left with its packed token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.llm import decontamination, near_dedup, quality_classifier, quality_rules, sentencepiece_codec
from tidefeed.llm.common import saved, small_batches, table
from tidefeed.llm.queries import piece_model


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (fitted on labelled rows of ``docs``)."""
    return quality_classifier.keep_good(docs, quality_classifier.fit_classifier(docs, table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the constrained trees."""
    return quality_rules.keep_passing(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    small_batches(spark)
    return near_dedup.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any item of the benchmark, rows without an id included."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed, with their count) and digests of ids and decoded text."""
    small_batches(spark)
    encoded = sentencepiece_codec.encode_decode(spark, docs, piece_model())
    return encoded.select(
        "doc_id", "ids", sentencepiece_codec.n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("near-duplicates", deduplicate),
          ("decontamination", decontaminate), ("encoding", encode)]

#: The tree models and the aligned search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each result to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
