"""Streams give the rows of the batch rules, however the input is cut."""

import random

import pytest
from pyspark.sql import functions as F

from sparkward.operators import enforce as E
from sparkward.operators.running import Cut
from sparkward.operators.mutate import read_version, versions
from sparkward.session import scratch_path
from sparkward.streaming import streams as S

LIMITS = E.Limits(max_violations=3, violation_window_s=60, quarantine_s=100, cut=Cut(600_000_000))
BASE = 1_700_000_000_000_000
DELAY_S = 600


def violations(n=400, seed=5):
    rnd, us, out = random.Random(seed), BASE, []
    for _ in range(n):
        us += rnd.choice([1_000_000, 7_000_000, 20_000_000, 200_000_000])
        out.append((rnd.choice("aaab"), us))
    return out


def judged(data):
    """The rule, one violation after the other."""
    rows, state = [], {}
    for s, us in sorted(data, key=lambda r: r[1]):
        recent, until = state.get(s, ([], 0))
        if until and us >= until:
            recent, until = [], 0
        recent = [t for t in recent if us - t < LIMITS.violation_us] + [us]
        tripped = len(recent) >= LIMITS.max_violations
        until = us + LIMITS.quarantine_us if tripped else until
        state[s] = (recent, until)
        rows.append((s, us, len(recent), tripped, until))
    return rows


def as_stream(spark, data, files, seed):
    """The rows spread over files, out of order within the watermark's reach."""
    rnd = random.Random(seed)
    late = sorted(data, key=lambda r: r[1] + rnd.randrange(DELAY_S * 1_000_000 // 2))
    path = scratch_path(spark, "stream-in")
    size = -(-len(late) // files)
    for i in range(files):
        part = late[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, "session_id string, us bigint").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("session_id string, us bigint").option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("at", F.timestamp_micros("us"))


@pytest.mark.parametrize("files,seed", [(1, 1), (4, 2), (4, 3)])
def test_violations(spark, files, seed):
    data = violations()
    out = S.run_to_table(S.stream_violations(as_stream(spark, data, files, seed), LIMITS, f"{DELAY_S} seconds"), "test-trips")
    mark = (max(us for _, us in data) - DELAY_S * 1_000_000) // 1000 * 1000
    want = [r for r in judged(data) if r[1] <= mark]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert any(r[3] for r in want) and not all(r[3] for r in want)


def test_a_stopped_stream_goes_on(spark):
    """Two runs over a growing folder, with one checkpoint, miss and repeat nothing."""
    data = violations(200, 9)
    first, second = data[:120], data[120:]
    path, place = scratch_path(spark, "grow-in"), scratch_path(spark, "grow-out")

    def add(part):
        spark.createDataFrame(part, "session_id string, us bigint").coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema("session_id string, us bigint").parquet(path).withColumn("at", F.timestamp_micros("us"))
        q = (S.stream_violations(stream, LIMITS, "10 seconds").writeStream.format("parquet")
             .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/rows"))
        q.awaitTermination()

    add(first), run(), add(second), run()
    mark = (data[-1][1] - 10_000_000) // 1000 * 1000
    got = sorted(tuple(r) for r in spark.read.schema(S.TRIP_SCHEMA).parquet(f"{place}/rows").collect())
    assert got == sorted(r for r in judged(data) if r[1] <= mark)


def test_state_upserts_survive_a_repeat(spark):
    path, place = scratch_path(spark, "state-in"), scratch_path(spark, "state-out")
    schema = "session_id string, violations bigint, quarantine_until bigint, last_seen bigint"
    for rows in ([("a", 1, None, 1), ("b", 1, None, 2)], [("a", 2, 9, 5)], [("a", 7, 1, 3), ("c", 1, None, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    S.upsert_stream(stream, f"{place}/t", f"{place}/c1").awaitTermination()
    want = [("a", 2, 9, 5), ("b", 1, None, 2), ("c", 1, None, 9)]
    assert sorted(tuple(r) for r in read_version(spark, f"{place}/t").collect()) == want
    before = versions(spark, f"{place}/t")
    # The same batches again, as after a lost checkpoint: nothing changes.
    S.upsert_stream(stream, f"{place}/t", f"{place}/c2").awaitTermination()
    assert versions(spark, f"{place}/t") == before
    assert sorted(tuple(r) for r in read_version(spark, f"{place}/t").collect()) == want


def test_late_rows_are_dropped(spark):
    """Spark drops by the watermark of the batch before, so lateness shows a batch later."""
    path = scratch_path(spark, "late-in")
    at = (0, 10_000_000_000, 11_000_000_000, 1, 20_000_000_000)
    for rows in ([("a", BASE + us)] for us in at):
        spark.createDataFrame(rows, "session_id string, us bigint").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("session_id string, us bigint").option("maxFilesPerTrigger", 1).parquet(path)
    out = S.run_to_table(S.stream_violations(stream.withColumn("at", F.timestamp_micros("us")), LIMITS, "1 second"), "late")
    assert sorted(r["us"] - BASE for r in out.collect()) == [0, 10_000_000_000, 11_000_000_000]
