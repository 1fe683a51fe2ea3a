"""Joining points to ranges without comparing each point with each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    width: float,
    also: Column | None = None,
) -> DataFrame:
    """Pairs with `low <= point < high`, as an equi-join on cells of `width`.

    Each range is listed under every cell it covers, so `width` should be near the
    usual length of a range. A crowded cell is an ordinary skewed join key, which
    adaptive execution splits.
    """
    celled = points.withColumn("_cell", F.floor(F.col(point) / F.lit(width)).cast("bigint"))
    listed = ranges.filter(F.col(low) < F.col(high)).withColumn(
        "_cell",
        F.explode(
            F.sequence(
                F.floor(F.col(low) / F.lit(width)).cast("bigint"),
                F.floor(F.col(high) / F.lit(width)).cast("bigint"),
            )
        ),
    )
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return celled.join(listed, "_cell").filter(inside if also is None else inside & also).drop("_cell")
