"""A finished input gives the rows of the batch rules, the last watermark's reach included."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkward.streaming import streams as S
from test_streams import BASE, DELAY_S, LIMITS, as_stream, judged, violations

DELAY = f"{DELAY_S} seconds"
MINUTE = 60_000_000


@pytest.fixture(scope="module")
def data():
    """Most rows lie within the watermark of the last."""
    own = violations(40, 3)
    end = own[-1][1]
    return own + [("ab"[i % 2], end + 1_000_000 * (i + 1)) for i in range(60)]


def test_violations_to_the_end(spark, data):
    stream = as_stream(spark, data, 3, 2)
    out = S.run_finished({"at": stream}, lambda s: S.stream_violations(s, LIMITS, DELAY), "test-all-trips")
    assert sorted(tuple(r) for r in out.collect()) == sorted(judged(data))


def test_rate_to_the_end(spark, data):
    out = S.run_finished({"at": as_stream(spark, data, 3, 2)}, lambda s: S.stream_rate(s, "2 minutes", "1 minute", DELAY), "test-all-rate")
    wanted = Counter((start * MINUTE, s) for s, us in data for start in (us // MINUTE - 1, us // MINUTE))
    assert {(r["start_us"], r["session_id"]): r["n_queries"] for r in out.collect()} == wanted


def test_sessions_to_the_end(spark, data):
    stream = as_stream(spark, data, 3, 2)
    out = S.run_finished({"at": stream}, lambda s: S.stream_sessions(s, "session_id", "15 seconds", DELAY), "test-all-sessions")
    wanted = []
    for s in {s for s, _ in data}:
        own = sorted(us for t, us in data if t == s)
        for us in own:
            if wanted and wanted[-1][0] == s and us < wanted[-1][2]:
                wanted[-1] = (s, wanted[-1][1], us + 15_000_000, wanted[-1][3] + 1)
            else:
                wanted.append((s, us, us + 15_000_000, 1))
    assert sorted(tuple(r) for r in out.collect()) == sorted(wanted)


def test_lifecycle_to_the_end(spark):
    proposals = [(f"p{i}", BASE + i * 1_000_000) for i in range(50)]
    outcomes = [(f"p{i}", BASE + i * 1_000_000 + (i + 1) * 10_000_000) for i in range(0, 50, 2)]
    p = as_stream(spark, proposals, 2, 1).select(F.col("session_id").alias("proposal_token"), "at")
    o = as_stream(spark, outcomes, 2, 1).select(F.col("session_id").alias("token"), F.col("at").alias("outcome_at"), F.lit("DONE").alias("type"))
    out = S.run_finished({"at": p, "outcome_at": o}, lambda p, o: S.stream_lifecycle(p, o, 300, DELAY), "test-all-lifecycle")
    late = dict(outcomes)
    wanted = [(t, us, "DONE", late[t] - us) if t in late and late[t] - us <= 300_000_000 else (t, us, "OPEN", -1) for t, us in proposals]
    assert sorted(tuple(r) for r in out.collect()) == sorted(wanted)
