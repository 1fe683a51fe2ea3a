"""A bounded set sketch for leaving rows out of a shuffle: one bit for each hash, false positives only.

It has the same size whatever it holds. When it fills up it lets more rows through;
what follows it is an exact join, so no result depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
_WORD = 64


def sketch(df: DataFrame, column: str) -> DataFrame:
    """One row, one column `sketch`: the bits of the column's values, 64 to a long."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int")
    words = df.select((bit / _WORD).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit % _WORD).alias("bits"))
    set_bits = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = df.sparkSession.range(BITS // _WORD).select(F.col("id").cast("int").alias("word"))
    dense = every.join(set_bits, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return dense.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("sketch"))


def may_hold(one_row: DataFrame, column: str) -> Column:
    """Whether the sketch may hold the column's value."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int")
    return F.getbit(F.get(one_row.scalar(), (bit / _WORD).cast("int")), bit % _WORD) == 1
