"""Identity and key columns: labels, item identity, notification identity, display keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import DATE_TOKEN_KEYS, date_token
from .links import normalize_link
from .text import blank, first_nonempty, normalize_text

LABEL_KEYS = ("document_name", "title", "document_number")


def item_label(keys: Sequence[str] = LABEL_KEYS) -> Column:
    """First non-empty of document_name, title, document_number; normalised."""
    return normalize_text(first_nonempty(*keys))


def _identity(label: Column, token: Column, number: Column, link: Column) -> Column:
    """The identity rule on normalised parts."""
    return (F.when((label != "") & (token != ""), F.concat(F.lit("label::"), label, F.lit("::date::"), token))
             .when((number != "") & (token != ""), F.concat(F.lit("document::"), number, F.lit("::date::"), token))
             .when(label != "", F.concat(F.lit("label::"), label))
             .when(link != "", F.concat(F.lit("link::"), link))
             .when(token != "", F.concat(F.lit("date::"), token))
             .otherwise(F.lit("empty-item")))


def item_identity(*, label_keys: Sequence[str] = LABEL_KEYS,
                  date_keys: Sequence[str] = DATE_TOKEN_KEYS,
                  number_col: str = "document_number", link_col: str = "link") -> Column:
    """Stable identity of an item across hosts and links.

    ``label::L::date::D`` -> ``document::N::date::D`` -> ``label::L`` ->
    ``link::<normalised link>`` -> ``date::D`` -> ``empty-item``.
    """
    label = item_label(label_keys)
    token = date_token(date_keys)
    number = normalize_text(number_col)
    link = normalize_link(link_col)
    return _identity(label, token, number, link)


def notification_identity(ntype, identity) -> Column:
    """normalised type + '::' + item identity."""
    return F.concat(normalize_text(ntype), F.lit("::"), identity)


def display_key(title_keys: Sequence[str], date_keys: Sequence[str], *,
                link_col: str = "link", type_col: str = "resource_type") -> Column:
    """``link::<https-normalised link>`` when a link exists, else type/title/date."""
    link = normalize_link(link_col, default_scheme="https", sanitize=True)
    title = first_nonempty(*[normalize_text(k) for k in title_keys])
    date = first_nonempty(*[normalize_text(k) for k in date_keys])
    rtype = normalize_text(type_col)
    return F.when(link != "", F.concat(F.lit("link::"), link)).otherwise(
        F.concat(F.lit("type::"), rtype, F.lit("::title::"), title, F.lit("::date::"), date))


def sidebar_key(ntype: str = "type", item: str = "item") -> Column:
    """type + '::' + lower-cased visible label (or link)."""
    label = F.lower(F.trim(first_nonempty(f"{item}.document_name", f"{item}.title")))
    label = F.when(label == "", F.lower(F.trim(blank(f"{item}.link")))).otherwise(label)
    return F.concat(blank(ntype), F.lit("::"), label)


def add_identity(df, name: str = "identity", *, label_keys: Sequence[str] = LABEL_KEYS,
                 date_keys: Sequence[str] = DATE_TOKEN_KEYS, number_col: str = "document_number",
                 link_col: str = "link"):
    """DataFrame form of ``item_identity``: label, date token, number and link are
    computed once in their own projection, then combined (no re-evaluation per branch)."""
    present = set(df.columns)

    def c(name):
        return F.col(name) if name in present else F.lit(None).cast("string")
    parts = df.select("*", F.explode(F.array(F.struct(
        normalize_text(first_nonempty(*[c(k) for k in label_keys])).alias("label"),
        normalize_text(first_nonempty(*[c(k) for k in date_keys])).alias("token"),
        normalize_text(c(number_col)).alias("number"),
        normalize_link(c(link_col)).alias("link")))).alias("_id"))
    ident = _identity(F.col("_id.label"), F.col("_id.token"), F.col("_id.number"), F.col("_id.link"))
    return parts.withColumn(name, ident).drop("_id")
