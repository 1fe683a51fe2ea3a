"""Session settings and the shared folder that cluster jobs write through."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int = 8, app: str = "sparkward") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own.

    Its executors all live on this machine, so where no shared folder is set it may be a temporary one.
    """
    SparkContext._ensure_initialized()
    builder = SparkSession.builder
    if not SparkConf().contains(_CHECKPOINT_DIR):
        builder = builder.config(_CHECKPOINT_DIR, tempfile.mkdtemp(prefix="sparkward-"))
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it. It cannot be set once a session runs."""
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if not configured:
        raise RuntimeError(f"start the session with {_CHECKPOINT_DIR} set to a folder all executors share")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier job has used."""
    return f"{shared_dir(spark)}/sparkward/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder, split by column `by`, and read it back.

    Cuts the lineage where several later passes would each recompute `df`. The
    copy lives outside the executors, so losing one costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
