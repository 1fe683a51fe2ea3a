"""Enforcement and audit jobs over streams of events.

Event time is the event's own timestamp. Rows later than the watermark are dropped
by Spark; nothing depends on how the input is split into files or batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkward.operators.enforce import DEFAULTS, Limits, state_upsert
from sparkward.operators.mutate import PROPOSAL_TTL_S, read_version, versions
from sparkward.session import scratch_path
from sparkward.sources.audit_log import alert_events

WATERMARK = "10 minutes"

TRIP_SCHEMA = (
    "session_id string, us bigint, n_violations bigint, tripped boolean, quarantine_until_us bigint"
)
_TRIP_STATE = "waiting array<bigint>, recent array<bigint>, until_us bigint"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = "org.apache.spark.sql.execution.streaming.state"
_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """Settings for streams that start inside; a started stream keeps them, the session gets its own back.

    State is held in RocksDB, off the heap, unless the session chose a store (a stream
    started earlier goes on with the store its checkpoint names). Session windows are
    merged within each task before they are shuffled.
    """
    wanted = {_MERGE: "true"}
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider"):
        wanted[_PROVIDER] = f"{_STATE}.RocksDBStateStoreProvider"
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_to_table(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Run a stream over all that is available, into a table in the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode(output_mode)
        .trigger(availableNow=True)
    )
    with stream_settings(spark):
        query = writer.start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


#: The event time of the row that ends a finished input, near the last that pandas can hold; its own results never come out.
END = "2262-01-01 00:00:00"


def run_finished(
    inputs: Mapping[str, DataFrame], of: Callable[..., DataFrame], label: str
) -> DataFrame:
    """Run of(*streams) over inputs that are finished, into a table: the rows that wait behind the watermark too.

    `inputs` has the streams under the name of the event time of each. When all that is
    available has been read, a second run of the same checkpoint reads one row more from
    each, at the event time END, and the watermark passes all rows. Its strings are its
    own folder: a join may leave out null keys before the watermark is taken, and must not match it. All else is null.
    """
    spark = next(iter(inputs.values())).sparkSession
    path = scratch_path(spark, label)
    closed = []
    for at, stream in inputs.items():
        place = f"{path}/end-{len(closed)}"
        nullable = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
        spark.createDataFrame([], nullable).write.parquet(place)
        end = spark.readStream.schema(nullable).parquet(place)
        closed.append((at, place, nullable, stream.unionByName(end)))
    out = of(*[stream for *_, stream in closed])

    def run() -> None:
        writer = (
            out.writeStream.format("parquet")
            .option("checkpointLocation", f"{path}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
        )
        with stream_settings(spark):
            query = writer.start(f"{path}/rows")
        query.awaitTermination()

    run()
    for at, place, nullable, _ in closed:
        row = spark.range(1).select(
            *[
                F.lit(END if f.name == at else place if f.dataType.typeName() == "string" else None)
                .cast(f.dataType)
                .alias(f.name)
                for f in spark.createDataFrame([], nullable).schema
            ]
        )
        row.write.mode("append").parquet(place)
    run()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def stream_violations(
    violations: DataFrame, limits: Limits = DEFAULTS, watermark: str = WATERMARK
) -> DataFrame:
    """One row per violation (`session_id`, `at`, `us`), saying whether it trips.

    A violation is judged once the watermark has passed it, in time order, so late
    and shuffled input gives the same rows. State per session: the violations still
    waiting, the last few judged, and the end of the quarantine in force. Reaching
    that end clears the violations before it.
    """
    judged = partial(_judge, limits=limits)
    return (
        violations.withWatermark("at", watermark)
        .groupBy("session_id")
        .applyInPandasWithState(
            judged, TRIP_SCHEMA, _TRIP_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def _judge(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, limits: Limits
) -> Iterator[pd.DataFrame]:
    waiting, recent, until = state.get if state.exists else ([], [], 0)
    if not state.hasTimedOut:
        waiting = sorted([*waiting, *(int(u) for b in batches for u in b["us"].dropna())])
    ready_us = state.getCurrentWatermarkMs() * 1000
    n_ready = int(np.searchsorted(np.asarray(waiting, dtype=np.int64), ready_us, side="right"))
    # `start` moves over the times as they leave the window, so each is seen twice.
    times, start, rows = [*recent, *waiting[:n_ready]], 0, []
    for i in range(len(recent), len(times)):
        us = times[i]
        if until and us >= until:
            start, until = i, 0
        while us - times[start] >= limits.violation_us:
            start += 1
        tripped = i - start + 1 >= limits.max_violations
        if tripped:
            until = us + limits.quarantine_us
        rows.append((key[0], us, i - start + 1, tripped, until))
    recent, waiting = times[start:], waiting[n_ready:]
    # Come back when the next one is due, or when nothing that is kept counts any more.
    due = waiting[0] if waiting else max([until, *(t + limits.violation_us for t in recent)])
    due_ms = due // 1000 + 1
    if waiting or due_ms > state.getCurrentWatermarkMs():
        state.update((waiting, recent, until))
        state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if rows:
        yield pd.DataFrame(
            rows, columns=["session_id", "us", "n_violations", "tripped", "quarantine_until_us"]
        )


def stream_rate(
    queries: DataFrame,
    width: str = "60 seconds",
    slide: str = "10 seconds",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Queries per session and sliding window, emitted when the window has closed."""
    return (
        queries.withWatermark("at", watermark)
        .groupBy(F.window("at", width, slide).alias("w"), "session_id")
        .agg(F.count("*").alias("n_queries"))
        .select(
            F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"),
            "session_id", "n_queries",
        )
    )


def stream_sessions(
    events: DataFrame, by: str = "role", gap: str = "5 minutes", watermark: str = WATERMARK
) -> DataFrame:
    """Periods of activity per role, closed by a gap without events.

    Roles are few and each has many events: start the stream under `stream_settings`.
    """
    return (
        events.withWatermark("at", watermark)
        .groupBy(F.session_window("at", gap).alias("w"), by)
        .agg(F.count("*").alias("n_events"))
        .select(
            by, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"),
            "n_events",
        )
    )


def stream_dedup(events: DataFrame, token: str, watermark: str = WATERMARK) -> DataFrame:
    """Each token once, however often it is replayed within the watermark."""
    return events.withWatermark("at", watermark).dropDuplicatesWithinWatermark([token])


def stream_lifecycle(
    proposed: DataFrame,
    outcomes: DataFrame,
    ttl_s: int = PROPOSAL_TTL_S,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Proposals with the outcome that reached them in time, or none once it is too late.

    Proposals: `proposal_token`, `at`. Outcomes: `token`, `outcome_at`, `type`.
    """
    p = proposed.withWatermark("at", watermark)
    o = outcomes.withWatermark("outcome_at", watermark)
    in_time = F.expr(
        "proposal_token = token AND outcome_at >= at "
        f"AND outcome_at <= at + INTERVAL {ttl_s} SECONDS"
    )
    return p.join(o, in_time, "leftOuter").select(
        "proposal_token",
        F.unix_micros("at").alias("us"),
        F.coalesce("type", F.lit("OPEN")).alias("outcome"),
        F.coalesce(F.unix_micros("outcome_at") - F.unix_micros("at"), F.lit(-1)).alias("latency_us"),
    )


def split_alerts(events: DataFrame, log_path: str, alert_path: str, checkpoint: str):
    """Write every event to the log and severe ones to the alert sink too.

    Each batch has its own folder in both sinks, so a batch run again after a
    failure replaces what it had written.
    """
    def two_sinks(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").json(f"{log_path}/batch={batch_id}")
        alert_events(batch).write.mode("overwrite").json(f"{alert_path}/batch={batch_id}")
        batch.unpersist()

    return (
        events.writeStream.foreachBatch(two_sinks)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(updates: DataFrame, root: str, checkpoint: str, key: str = "session_id"):
    """Keep a versioned state table up to date with a stream of state rows.

    The batch number is the version, so a batch run again after it was committed
    changes nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, batch_id + 1
        if version in versions(spark, root):
            return
        stored = batch.limit(0) if batch_id == 0 else read_version(spark, root, batch_id)
        # The checkpoint lets one writer in; what it left unfinished is replaced.
        state_upsert(stored, batch, key).write.mode("overwrite").parquet(f"{root}/v{version}")

    return (
        updates.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

