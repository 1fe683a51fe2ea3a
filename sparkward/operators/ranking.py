"""Ranking and neighbour functions over a key whose rows need not fit in one task.

`row_number`, `rank` and the rest over `PARTITION BY key` send all rows of a key to
one task. Cut by stretches of an integer order column, a task ranks one stretch, and
what came before is carried in from counts aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.operators.running import KEY, STRETCH, Cut, with_stretch


def _before():
    return Window.partitionBy(KEY).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)


def ranks(
    df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], cut: Cut, tiles: int = 4
) -> DataFrame:
    """Adds row_number, rank, dense_rank, percent_rank, cume_dist and ntile.

    Rows are ordered by `order`, rows equal in it are peers; `tie` tells them apart
    where a function must.
    """
    rows = with_stretch(df, keys, order, cut)
    peers = rows.groupBy(KEY, STRETCH, order).agg(F.count("*").alias("_n"))
    counts = peers.groupBy(KEY, STRETCH).agg(
        F.sum("_n").alias("_n"), F.count("*").alias("_moments")
    )
    carry = counts.select(
        KEY, STRETCH,
        F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_done"),
        F.coalesce(F.sum("_moments").over(_before()), F.lit(0)).alias("_done_moments"),
        F.sum("_n").over(Window.partitionBy(KEY)).alias("_all"),
    )
    placed = rows.join(carry, [KEY, STRETCH])
    stretch = Window.partitionBy(KEY, STRETCH)
    by_row, by_peer = stretch.orderBy(order, *tie), stretch.orderBy(order)
    number = F.col("_done") + F.row_number().over(by_row)
    rank = F.col("_done") + F.rank().over(by_peer)
    upto = F.col("_done") + F.count("*").over(by_peer)
    every = F.col("_all")
    ranked = placed.select(
        *df.columns, "_all", number.alias("row_number"), rank.alias("rank"),
        (F.col("_done_moments") + F.dense_rank().over(by_peer)).alias("dense_rank"),
        F.when(every > 1, (rank - 1) / (every - 1)).otherwise(0.0).alias("percent_rank"),
        (upto / every).alias("cume_dist"),
    )
    return ranked.withColumn("ntile", _tile(F.col("row_number"), every, tiles)).drop("_all")


def _tile(number: Column, every: Column, tiles: int) -> Column:
    """The first tiles are one row larger where the rows do not divide evenly."""
    larger = F.pmod(every, F.lit(tiles))
    size = (every - larger) / tiles
    in_larger = larger * (size + 1)
    early = F.ceil(number / (size + 1))
    late = larger + F.ceil((number - in_larger) / F.greatest(size, F.lit(1)))
    return F.when(number <= in_larger, early).otherwise(late).cast("bigint")


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], value: str, cut: Cut
) -> DataFrame:
    """Adds lag, lead, first_value and last_value (of the whole key) of a column."""
    rows = with_stretch(df, keys, order, cut)
    place, own = F.struct(order, *tie), F.struct(value)
    ends = rows.groupBy(KEY, STRETCH).agg(
        F.min_by(own, place).alias("_first"), F.max_by(own, place).alias("_last")
    )
    chain, whole = Window.partitionBy(KEY).orderBy(STRETCH), Window.partitionBy(KEY)
    carry = ends.select(
        KEY, STRETCH,
        F.lag("_last").over(chain).alias("_lag"), F.lead("_first").over(chain).alias("_lead"),
        F.min_by("_first", STRETCH).over(whole).alias("_head"),
        F.max_by("_last", STRETCH).over(whole).alias("_tail"),
    )
    within = Window.partitionBy(KEY, STRETCH).orderBy(order, *tie)
    return rows.join(carry, [KEY, STRETCH]).select(
        *df.columns,
        F.coalesce(F.lag(own).over(within), "_lag").getField(value).alias("lag"),
        F.coalesce(F.lead(own).over(within), "_lead").getField(value).alias("lead"),
        F.col("_head").getField(value).alias("first_value"),
        F.col("_tail").getField(value).alias("last_value"),
    )
