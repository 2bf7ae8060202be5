"""Keeping long texts out of a shuffle when a join asks for few of them.

Hashed ids are marked in a bitmap of fixed size, which is broadcast (8 MB,
whatever the input).  An id whose bit is clear is certainly not asked for; rows
whose bit is set go through an exact join.  With very many ids most bits are set
and the joins work as they would without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap.
BITS = 1 << 26


def _slot(identity: Column) -> Column:
    return F.pmod(F.xxhash64(identity), F.lit(BITS))


def _marked(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` with a last column that is false where the id is certainly not in ``ids``."""
    slot = _slot(F.col(ids.columns[0]))
    marks = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    own = _slot(rows[id_col])
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(marks["bits"], (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    looked_up = rows.join(F.broadcast(marks), F.bitmap_bucket_number(own) == marks["n"], "left")
    set_bit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return looked_up.select(*(rows[c] for c in rows.columns), set_bit.alias("maybe asked for"))


# Spark moves semi- and anti-joins below the filter on the bitmap, which would shuffle
# every text; inner and outer joins stay above it.

def asked(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is in the one-column table ``ids`` of distinct ids."""
    few = _marked(rows, id_col, ids).where("`maybe asked for`").drop("maybe asked for")
    return few.join(ids, few[id_col] == ids[ids.columns[0]]).select(*(few[c] for c in few.columns))


def without(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in the one-column table ``ids`` of distinct ids; rows with a null id stay."""
    both = _marked(rows, id_col, ids)
    few = both.where("`maybe asked for`").drop("maybe asked for")
    named = ids.select(F.col(ids.columns[0]).alias("asked id"))
    rest = few.join(named, few[id_col] == named["asked id"], "left").where(named["asked id"].isNull())
    return both.where("not `maybe asked for`").drop("maybe asked for").unionByName(rest.select(*(few[c] for c in few.columns)))
