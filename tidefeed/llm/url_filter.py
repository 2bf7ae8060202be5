"""URL filters: host-suffix and path-prefix expressions joined with hashed rules.

Each URL is expanded into expressions (a suffix of its host and a prefix of its
path) of just the shapes that rules have: as many host labels, as many path
characters.  Expressions and rules meet in an equi-join on a short hash prefix,
full digests confirm a match, and the longest matching rule decides.  Everything
is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of the digest that the join uses.
SHORT = 8
#: Copies of every rule, so that URLs that share a hot expression are dealt over as many keys.
SALTS = 16
#: Verdict for a URL that no rule fits.
DEFAULT_VERDICT = "allow"

RULES_SCHEMA = "host string, path string, verdict string"


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as ``(host, path, verdict)``."""
    return spark.createDataFrame(list(rules), RULES_SCHEMA)


def url_host(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    """Digest of an expression; the newline keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expressions(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """Digests of the (host suffix, path prefix) pairs with a label count and a path length that rules have."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)),
                           lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n)))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)),
                           lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: digest(s, p))))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with digest and precedence; hosts are lower-cased, null parts are empty.

    Of rules with the same host and path ``block`` wins over ``allow`` (otherwise the
    alphabetically last verdict); rules with an empty host fit no URL.
    """
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    named = rules.select(host.alias("host"), path.alias("path"), "verdict").where(F.col("host") != "")
    return named.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.concat("host", "path").alias("rule"), "verdict",
        F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("path_length"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's; the longest rule (host and path together) wins, among equally long ones
    the alphabetically last.  Null URLs and URLs without ``://`` have empty host and
    path and no rule.  Repeated rows come out as often as they occur; a table
    without rows, or without rules, is allowed; other columns are ignored.

    Rows are grouped once by id and URL before they are expanded, so copies of a
    page cost one row; the expanded rows carry a salt, and rules are copied per
    salt, so an expression that a third of all URLs share is dealt over
    :data:`SALTS` keys where the rules are too large for Spark to broadcast.
    """
    known = prepared(rules)
    shapes = known.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths"))
    labels, lengths = shapes.select("labels").scalar(), shapes.select("lengths").scalar()
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(
        F.count(F.lit(1)).alias("copies"))
    cut = urls.select("id", "url", "copies", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    shaped = cut.withColumn("labels", labels).withColumn("lengths", lengths)
    expanded = shaped.select(
        "id", "url", "copies", "host", "path", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).alias("salt"),
        F.explode_outer(F.when(F.col("host") != "", _expressions(
            F.col("host"), F.col("path"), F.col("labels"), F.col("lengths")))).alias("expression"))
    salted = known.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(
        "short", F.substring("rule_digest", 1, SHORT))
    matched = expanded.join(
        salted, (F.substring("expression", 1, SHORT) == F.col("short")) & (F.col("salt") == F.col("rule_salt"))
        & (F.col("expression") == F.col("rule_digest")), "left")
    best = matched.groupBy("id", "url").agg(
        F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best"))
    result = best.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"), "copies")
    return result.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
