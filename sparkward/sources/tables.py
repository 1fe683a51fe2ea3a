"""Table scans: Parquet directories and external databases over JDBC."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def scan_table(
    spark: SparkSession, root: str, name: str, allowed: Iterable[str] | None = None
) -> DataFrame:
    """Read one allowlisted table. Names are trimmed and compared in lower case."""
    clean = name.strip().lower()
    if allowed is not None and clean not in {a.lower() for a in allowed}:
        raise PermissionError(f"table '{clean}' is not in the accessible set")
    return spark.read.parquet(f"{root}/{clean}.parquet")


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Read a table of an external database, split over `split_on` ranges.

    Without `split_on` and `bounds` one task reads the table, which suits only
    small ones.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_on is not None:
        if bounds is None:
            raise ValueError("bounds are needed with split_on")
        reader = (
            reader.option("partitionColumn", split_on)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.options(**options).load()
