"""Summary cascade: cache -> abstract -> linked page, with the gates at each step.

For each item that may carry a summary (not a presentation): a fresh cached
summary that passes the gates wins; else the item's abstract (contact details
stripped, gated, rewritten in the third person, cut to two sentences, with its
first sentence as the last resort); else, when the item has only a link, the
linked page's summary.  ``summarizer`` is an optional hook (a function from a
DataFrame with ``_cascade_input`` to one with ``_generated``) for a model; with
none, this is the non-model path of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import normalize_link
from ..functions.quality import (first_sentences, is_uninformative, mid_phrase_start, sentence_head, split_sentences,
                                 strip_contact_info, third_person)
from ..functions.text import blank, cache_key, clean_text, first_nonempty, let, pystrip
from .dedupe import first_per_key
from .enrich import cache_lookup
from .filters import is_presentation


def _two(c: Column) -> Column:
    """The first two sentences in the third person; no rewrite reaches over or touches a terminator, so only they are rewritten."""
    return first_sentences(third_person(sentence_head(c, 2), "summary"), 2)


def summary_cascade(items: DataFrame, *, pages_summary: DataFrame | None = None,
                    cache: DataFrame | None = None, as_of=None, ttl_hours: int = 48,
                    summarizer=None) -> DataFrame:
    """Adds ``generated_summary`` ('' when no step yields one)."""
    cols = set(items.columns)

    def c(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")

    df = items.withColumns({
        "_abstract": clean_text(first_nonempty(c("abstract"), c("description"), c("summary"))),
        "_link": pystrip(c("link")),
        "_title": clean_text(first_nonempty(c("title"), c("document_name"))),
    })
    df = df.withColumn("cache_key", cache_key(first_nonempty("_abstract", "_link", "_title")))
    if cache is not None:
        df = cache_lookup(df, cache, as_of=as_of, ttl_hours=ttl_hours)
    else:
        df = df.withColumn("cached_summary", F.lit(None).cast("string"))
    if pages_summary is not None:
        keyed = pages_summary.select(normalize_link("url").alias("_plink"), "page_id", F.col("summary").alias("_page_summary"))
        first = first_per_key(keyed.where(F.col("_plink") != ""), ["_plink"], ["page_id"]).drop("page_id")
        # only rows without an abstract can use a page: the others carry no join key
        wanted = F.when(F.col("_abstract") == "", F.nullif(normalize_link("_link"), F.lit("")))
        df = df.withColumn("_plink", wanted).join(first, "_plink", "left").drop("_plink")
    else:
        df = df.withColumn("_page_summary", F.lit(None).cast("string"))
    if summarizer is not None:
        df = summarizer(df.withColumn("_cascade_input", F.col("_abstract")))
    gen = F.col("_generated") if summarizer is not None else F.lit(None).cast("string")

    cached_out = let(_two(F.col("cached_summary")), lambda o: F.when(
        (blank(F.col("cached_summary")) != "") & ~mid_phrase_start(o), o))
    cleaned = strip_contact_info(F.col("_abstract"))

    def from_abstract(cl):
        model = let(_two(gen), lambda o: F.when((blank(gen) != "") & ~mid_phrase_start(o), o))
        own = let(_two(first_sentences(cl, 2)), lambda o: F.when((o != "") & ~mid_phrase_start(o), o))
        first = F.try_element_at(split_sentences(cl), F.lit(1))
        last = F.when(first.isNotNull() & ~is_uninformative(first, "summary") & ~mid_phrase_start(first), first)
        return F.when((cl == "") | is_uninformative(cl, "summary"), F.lit("")).otherwise(
            F.coalesce(model, own, last, F.lit("")))

    page = let(_two(F.col("_page_summary")), lambda o: F.when(
        (blank(F.col("_page_summary")) != "") & (o != "") & ~is_uninformative(o, "summary") & ~mid_phrase_start(o), o))
    result = (F.when(is_presentation(c("resource_type")), F.lit(""))
               .when((F.col("_abstract") == "") & (F.col("_link") == ""), F.lit(""))
               .when(cached_out.isNotNull(), cached_out)
               .when(F.col("_abstract") != "", let(cleaned, from_abstract))
               .otherwise(F.coalesce(page, F.lit(""))))
    return (df.withColumn("generated_summary", result)
              .drop("_abstract", "_link", "_title", "_page_summary", "cached_summary", "cache_key",
                    *(["_cascade_input", "_generated"] if summarizer is not None else [])))
