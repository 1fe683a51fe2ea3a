"""Running Python over rows in bounded Arrow batches, and writing what several jobs need."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkward.session import scratch_path

ROWS = 2048

BatchFn = Callable[[pa.RecordBatch], pa.RecordBatch]


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: T.StructType) -> DataFrame:
    """`make()` runs once per task; what it returns maps each batch of at most ROWS rows.

    The mapped function gives the arrays of `schema` in order.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                arrays = fn(batch.slice(at, ROWS))
                yield pa.RecordBatch.from_arrays(
                    [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, target, strict=True)],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later jobs neither recompute it nor need the executors that did; so its shuffle
    files can go as soon as it is written.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what `kept` wrote for these frames, once all that reads them is written itself."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: Iterable[str], name: str) -> str:
    """`name`, or with underscores after it, so that no column is called so."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def ids_schema(rest: str) -> T.StructType:
    """doc_id, then `rest`."""
    return T.StructType.fromDDL(f"doc_id long, {rest}")


def ids_and_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def filter_texts(df: DataFrame, make: Callable[[], Callable], text: str = "text") -> DataFrame:
    """The rows of `df`, whole, for whose text the function that `make()` gives each task says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(fn(part.column(part.schema.get_field_index(text))), pa.bool_()))

    return df.mapInArrow(run, df.schema)
