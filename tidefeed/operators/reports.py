"""Aggregate reports: section counts, new-item banner, audit report, cache cleanup, repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import audit_summary, bad_summary, first_sentences, issue_key, mid_phrase_start
from ..functions.text import blank, pystrip

# Sections every topic snapshot reports, zero when empty.
SECTIONS = ("publications", "presentations", "news")


def section_counts(df: DataFrame, *, sections: Sequence[str] = SECTIONS,
                   topic: str = "topic", section: str = "section") -> DataFrame:
    """Rows per (topic, section); the fixed sections appear with 0 when empty.

    The input is aggregated once; the zero-filled grid is built from that
    (topic x section)-sized result, so the input plan is read a single time.
    """
    counts = df.groupBy(topic, section).agg(F.count(F.lit(1)).alias("n"))
    fixed = F.array(*[F.lit(s) for s in sections])
    per_topic = counts.groupBy(topic).agg(
        F.array_union(fixed, F.collect_set(F.col(section))).alias("_sections"),   # bounded: sections of one topic
        F.map_from_entries(F.collect_list(F.struct(F.col(section), F.col("n")))).alias("_n"))
    return per_topic.select(topic, F.explode("_sections").alias(section), "_n").select(
        topic, section, F.coalesce(F.try_element_at("_n", F.col(section)), F.lit(0)).cast("long").alias("n"))


def new_item_banner(new: DataFrame, is_first: Column | bool, *, sections: Sequence[str] = SECTIONS,
                    topic: str = "topic", section: str = "section") -> DataFrame:
    """New rows per section to announce; nothing on a first snapshot."""
    first = F.lit(is_first) if isinstance(is_first, bool) else is_first
    counts = section_counts(new, sections=sections, topic=topic, section=section)
    return counts.withColumn("banner", F.when(first, F.lit(0)).otherwise(F.col("n")).cast("long")) \
                 .withColumn("show", F.col("banner") >= 1)


def audit(df: DataFrame, text: str = "summary") -> DataFrame:
    """Attach the audit struct's fields to every row.

    ``audited`` is restated as the cheap test it is (non-empty text), so a
    filter on it, pushed below the projection, does not re-run the audit.
    """
    from .common import bind
    return (bind(df, "_a", audit_summary(F.col(text)))
              .select("*", "_a.status", "_a.score", "_a.issues", "_a.sentence_count",
                      (blank(text) != "").alias("audited"))
              .drop("_a"))


def audit_report(audited: DataFrame) -> DataFrame:
    """Totals plus one row per issue kind (``total, passed, failed, pass_pct, fail_pct,
    avg_score, issue_type, issue_count, issue_pct``); without any issue one totals row, its kind NULL.

    Empty texts are not part of the report.  Percentages are floor divisions;
    the average score is summed in hundredths (scores have two decimals) and
    rounded half-up, so it is exact and independent of partitioning.  One scan:
    each audited row contributes a NULL marker (for the totals) and one row per
    issue; the grouped result has at most one row per issue kind, so relating
    totals to kinds happens on a handful of rows.
    """
    done = audited.where(F.col("audited"))
    hundredths = F.round(F.col("score") * 100).cast("long")
    exploded = done.select(
        (F.col("status") == "PASS").alias("_pass"), hundredths.alias("_h"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("issues"))).alias("issue"))
    grouped = (exploded.groupBy(issue_key(F.col("issue")).alias("issue_type"))
                       .agg(F.count(F.lit(1)).alias("n"), F.count_if("_pass").alias("p"),
                            F.sum("_h").alias("h")))
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(1))   # bounded: one row per issue kind (+1)
    tot = F.max(F.when(F.col("issue_type").isNull(), F.col("n"))).over(w)
    passed = F.max(F.when(F.col("issue_type").isNull(), F.col("p"))).over(w)
    hsum = F.max(F.when(F.col("issue_type").isNull(), F.col("h"))).over(w)
    report = grouped.select(
        tot.alias("total"), passed.alias("passed"), (tot - passed).alias("failed"),
        F.floor(passed * 100 / tot).cast("long").alias("pass_pct"),
        F.floor((tot - passed) * 100 / tot).cast("long").alias("fail_pct"),
        (F.round(hsum / tot) / F.lit(100.0)).alias("avg_score"),
        "issue_type", F.col("n").alias("issue_count"),
        F.floor(F.col("n") * 100 / tot).cast("long").alias("issue_pct"))
    shown = report.withColumn("issue_count", F.when(F.col("issue_type").isNotNull(), F.col("issue_count")).otherwise(0))
    shown = shown.withColumn("issue_pct", F.when(F.col("issue_type").isNotNull(), F.col("issue_pct")).otherwise(0))
    # the totals row stands in when no text has an issue
    kinds = F.count_if(F.col("issue_type").isNotNull()).over(w)
    return shown.withColumn("_kinds", kinds).where(F.col("issue_type").isNotNull() | (F.col("_kinds") == 0)).drop("_kinds")


def audit_totals(audited: DataFrame) -> DataFrame:
    """The report's overall line: total, passed, failed, percents and mean score."""
    done = audited.where(F.col("audited"))
    hundredths = F.round(F.col("score") * 100).cast("long")
    t = done.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("status") == "PASS").alias("passed"),
                 F.count_if(F.col("status") == "FAIL").alias("failed"),
                 F.sum(hundredths).alias("_h"))
    return t.select(
        "total", "passed", "failed",
        F.when(F.col("total") > 0, F.floor(F.col("passed") * 100 / F.col("total"))).otherwise(0).cast("long").alias("pass_pct"),
        F.when(F.col("total") > 0, F.floor(F.col("failed") * 100 / F.col("total"))).otherwise(0).cast("long").alias("fail_pct"),
        F.when(F.col("total") > 0, F.round(F.col("_h") / F.col("total")) / F.lit(100.0)).otherwise(F.lit(0.0)).alias("avg_score"))


def cache_cleanup(cache: DataFrame, *, summary: str = "summary", topic: str = "topic",
                  dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split a summary cache by ``bad_summary``: (entries kept, report per topic/action/reason).

    With ``dry_run`` the kept frame is the whole cache (nothing removed) while
    the report still says what would go.
    """
    flagged = cache.withColumn("_bad", bad_summary(F.col(summary)))
    kept = cache if dry_run else flagged.where(~F.col("_bad.is_bad")).drop("_bad")
    report = (flagged.groupBy(topic,
                              F.when(F.col("_bad.is_bad"), F.lit("remove")).otherwise(F.lit("keep")).alias("action"),
                              F.col("_bad.reason_kind").alias("reason"))
                     .agg(F.count(F.lit(1)).alias("n")))
    return kept, report


def repair_summaries(items: DataFrame, best: Column | None = None, *, summary: str = "summary",
                     title_keys: Sequence[str] = ("document_name", "title")) -> DataFrame:
    """Repair empty, mid-phrase or over-long summaries (adds ``repair_candidate`` / ``repaired``).

    A candidate takes the first two sentences of ``best`` (default: its own
    summary when that differs from the title) unless those start mid-phrase,
    else its own first two sentences, else it stays as it is.
    """
    current = pystrip(summary)
    normalized = first_sentences(current, 2, clean="collapse")
    candidate = (current == "") | mid_phrase_start(current) | (normalized != current)
    present = [k for k in title_keys if k in items.columns]
    title = pystrip(F.coalesce(*[F.nullif(F.col(k), F.lit("")) for k in present], F.lit("")))
    if best is None:
        best = F.when((current != "") & (F.lower(current) != F.lower(title)), current).otherwise(F.lit(""))
    best_two = first_sentences(best, 2, clean="collapse")
    fixed = (F.when((best_two != "") & ~mid_phrase_start(best_two), best_two)
              .when((normalized != "") & ~mid_phrase_start(normalized), normalized)
              .otherwise(F.col(summary)))
    new_summary = F.when(candidate, fixed).otherwise(F.col(summary))
    return (items.withColumn("repair_candidate", candidate)
                 .withColumn("repaired", candidate & (blank(new_summary) != blank(summary)))
                 .withColumn(summary, new_summary))


def repair_counts(repaired: DataFrame) -> DataFrame:
    """(candidates, updated) for a repaired frame."""
    return repaired.agg(F.count_if("repair_candidate").alias("candidates"),
                        F.count_if("repaired").alias("updated"))
