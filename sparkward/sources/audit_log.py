"""The audit log: append-only JSON lines, read with a fixed wide schema."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.functions.scrub import scrub_leaves

CORRUPT = "_corrupt"

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("raw_input", T.StringType()),
        T.StructField("rejection_reason", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("safe_sql", T.StringType()),
        T.StructField("tables_accessed", T.ArrayType(T.StringType())),
        T.StructField("row_count", T.LongType()),
        T.StructField("exec_ms", T.DoubleType()),
        T.StructField("proposal_token", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("violation_count", T.IntegerType()),
        T.StructField("quarantine_until", T.LongType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

# The event types that also go to the alert sink.
ALERT_TYPES = ("CIRCUIT_BREAKER_TRIP", "MUTATION_REJECTED", "QUERY_REJECTED")


def read_audit(spark: SparkSession, path: str, modified_after: datetime | None = None) -> DataFrame:
    """All lines of the log, or of its files written after a moment. A line that is no event has
    only `_corrupt` set.

    A log that was never written reads as empty.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], AUDIT_SCHEMA)
    reader = _json_reader(spark.read)
    if modified_after is not None:
        zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
        reader = reader.option("modifiedAfter", modified_after.astimezone(zone).strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.json(path)


def stream_audit(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Follow the log's folder as a stream of events."""
    reader = _json_reader(spark.readStream).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def _json_reader(reader):
    return (
        reader.schema(AUDIT_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )


def good_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_lines(log: DataFrame) -> DataFrame:
    """The lines kept aside. (Spark reads them only along with another column.)"""
    return log.filter(F.col(CORRUPT).isNotNull() & F.col("type").isNull()).select(CORRUPT)


def append_audit(events: DataFrame, path: str) -> None:
    """Append events with credentials redacted in every string field."""
    scrub_leaves(events).write.mode("append").json(path)


def alert_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type").isin(*ALERT_TYPES))


def event_time(epoch_seconds: Column) -> Column:
    """The log's epoch seconds (a double) as a timestamp, to the microsecond."""
    return F.timestamp_micros(F.round(epoch_seconds * 1_000_000).cast("bigint"))


def as_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, kinds JSON lacks written as strings."""
    cells = [_json_cell(f).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def _json_cell(field: T.StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(cell)
    plain = (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType)
    nested = (T.ArrayType, T.StructType, T.MapType)
    if isinstance(field.dataType, T.DecimalType):
        return cell.cast("string")
    return cell if isinstance(field.dataType, plain + nested) else cell.cast("string")
