"""Bounded results: limits, row caps, byte budgets and what was cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.functions.masking import mask_frame

# The caps on a result.
MAX_ROWS = 100
MAX_BYTES = 512 * 1024
SAMPLE_ROWS = 3


# What a cut result says.
def over_rows(max_rows: int) -> str:
    return f"Result truncated: Reached maximum row limit ({max_rows})."


def over_bytes(max_bytes: int) -> str:
    return f"Result truncated: Exceeded maximum payload size ({max_bytes // 1024} KB)."


def clamp(asked: object, most: int = MAX_ROWS) -> int:
    """The limit that holds: 1..most is kept, anything else becomes `most`."""
    try:
        n = int(asked)
    except (TypeError, ValueError):
        return most
    return n if 0 < n <= most else most


def limit_clamp(df: DataFrame, asked: object = None, most: int = MAX_ROWS) -> DataFrame:
    return df.limit(clamp(asked, most))


def top_k(df: DataFrame, order: Sequence[Column], asked: object = None) -> DataFrame:
    """ORDER BY with a clamped LIMIT: each task keeps its own best rows."""
    return limit_clamp(df.orderBy(*order), asked)


def row_cap(df: DataFrame, order: Sequence[Column], max_rows: int = MAX_ROWS) -> DataFrame:
    """The first `max_rows` rows, each with `truncated` and the reason.

    One row more than the cap is enough to know, so the windows see `max_rows + 1`.
    """
    at_most = df.orderBy(*order).limit(max_rows + 1)
    numbered = at_most.withColumns(
        {"_rn": F.row_number().over(Window.orderBy(*order)), "_n": F.count("*").over(Window.partitionBy())}
    )
    cut = F.col("_n") > max_rows
    return numbered.filter(F.col("_rn") <= max_rows).select(
        *df.columns,
        cut.alias("truncated"),
        F.when(cut, over_rows(max_rows))
        .otherwise("").alias("truncation_reason"),
    )


def row_bytes(df: DataFrame) -> Column:
    """UTF-8 length of the row as a JSON object."""
    cells = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return F.octet_length(F.to_json(cells, {"ignoreNullFields": "false"})).cast("bigint")


def byte_budget(
    df: DataFrame,
    order: Sequence[Column],
    max_bytes: int = MAX_BYTES,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """The longest prefix of a row-capped result whose JSON fits the budget.

    Sizes are positive, so the running total passes the budget once and for good. Every
    row says whether one was left out, and for which cap the first of them was. If not
    even the first row fits, no row is left to say so; `result_metrics` does.
    """
    at_most = df.orderBy(*order).limit(max_rows + 1)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = at_most.withColumns(
        {"running_bytes": F.sum(row_bytes(df)).over(so_far), "_rn": F.row_number().over(Window.orderBy(*order))}
    )
    fits = (F.col("_rn") <= max_rows) & (F.col("running_bytes") <= max_bytes)
    everything = Window.partitionBy()
    counted = sized.withColumns({"_fits": F.count_if(fits).over(everything), "_seen": F.count("*").over(everything)})
    cut = F.col("_seen") > F.col("_fits")
    reason = (
        F.when(~cut, "").when(F.col("_fits") == max_rows, over_rows(max_rows)).otherwise(over_bytes(max_bytes))
    )
    return counted.filter(fits).select(
        *df.columns, "running_bytes", cut.alias("truncated"), reason.alias("truncation_reason")
    )


def result_metrics(
    df: DataFrame, order: Sequence[Column], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """One row: rows and bytes returned, and why the result stops where it does.

    The reason is that of the first row left out, whichever cap it breaks.
    """
    at_most = df.orderBy(*order).limit(max_rows + 1)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = at_most.select(
        F.sum(row_bytes(df)).over(so_far).alias("upto"), F.row_number().over(Window.orderBy(*order)).alias("rn")
    )
    fits = (F.col("rn") <= max_rows) & (F.col("upto") <= max_bytes)
    stats = sized.agg(
        F.count_if(fits).alias("row_count"),
        F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("payload_bytes"),
        F.count("*").alias("_seen"),
    )
    cut = F.col("_seen") > F.col("row_count")
    reason = (
        F.when(~cut, "")
        .when(F.col("row_count") == max_rows,
              over_rows(max_rows))
        .otherwise(over_bytes(max_bytes))
    )
    return stats.select(
        "row_count", "payload_bytes", cut.alias("truncated"), reason.alias("truncation_reason")
    )


def sample_rows(df: DataFrame, order: Sequence[Column], n: int = SAMPLE_ROWS) -> DataFrame:
    """A few masked rows, the same ones each time."""
    return mask_frame(df.orderBy(*order).limit(n))
