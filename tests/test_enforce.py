"""Enforcement against a plain simulation of one session at a time."""

import random

import pytest
from pyspark.sql import functions as F

from sparkward.operators import enforce as E
from sparkward.operators.running import Cut

LIMITS = E.Limits(
    max_violations=3, violation_window_s=30, quarantine_s=90, max_queries=5, rate_window_s=10,
    max_compute_us=4_000_000, compute_window_s=60, cut=Cut(20_000_000),
)


def log(seed, n=800, hot="a", step=900_000):
    """Events (id, session, us, kind, spent): one session holds over a third of them."""
    rnd = random.Random(seed)
    us, out = 1_700_000_000_000_000, []
    for i in range(n):
        us += rnd.choice([0, 1, 1000, step, step, 3 * step, 40 * step if rnd.random() < 0.05 else step])
        out.append((i, rnd.choice([hot] * 4 + list("bcdef")), us, rnd.choice(["query", "query", "error", "write"]),
                    rnd.randrange(0, 900_000)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "event_id bigint, session_id string, us bigint, kind string, spent_us bigint")


def fold(data, limit, width):
    """Admission, one event after the other."""
    kept, out = {}, {}
    for i, s, us, *_ in sorted(data, key=lambda r: (r[1] or "", r[2], r[0])):
        now = [t for t in kept.get(s, []) if us - t < width]
        out[i] = len(now) < limit
        kept[s] = now + [us] if out[i] else now
    return out


@pytest.mark.parametrize("seed,width", [(1, 20_000_000), (3, 3_000_000), (4, 1_500_000), (5, 90_000_000)])
def test_rate_admission(spark, seed, width):
    data = log(seed)
    limits = E.Limits(**{**LIMITS.__dict__, "cut": Cut(width)})
    got = E.rate_admission(frame(spark, data), "session_id", "event_id", limits)
    assert got.columns == ["event_id", "session_id", "us", "kind", "spent_us", "admitted"]
    admitted = {r["event_id"]: r["admitted"] for r in got.collect()}
    assert admitted == fold(data, LIMITS.max_queries, LIMITS.rate_us)
    assert {True, False} <= set(admitted.values())


def test_rate_admission_of_a_session_that_never_pauses(spark):
    """Over the limit throughout: one long run, folded in batches."""
    data = [(i, "hot", 1_700_000_000_000_000 + i * 250_000, "query", 0) for i in range(4000)]
    got = E.rate_admission(frame(spark, data), "session_id", "event_id", LIMITS)
    assert {r["event_id"]: r["admitted"] for r in got.collect()} == fold(data, LIMITS.max_queries, LIMITS.rate_us)


def test_rate_admission_with_nothing_contested(spark):
    data = [(i, "s", 1_700_000_000_000_000 + i * 60_000_000, "query", 0) for i in range(50)]
    got = E.rate_admission(frame(spark, data), "session_id", "event_id", LIMITS)
    assert got.filter("admitted").count() == 50


def trips(data):
    """Violation counts and trips of each session by direct count."""
    errors = [(i, s, us) for i, s, us, kind, _ in data if kind == "error"]
    n = {i: sum(1 for _, s2, t in errors if s2 == s and 0 <= us - t < LIMITS.violation_us) for i, s, us in errors}
    return n, [(i, s, us) for i, s, us in errors if n[i] >= LIMITS.max_violations]


@pytest.mark.parametrize("seed", [11, 12])
def test_quarantine(spark, seed):
    data = log(seed)
    n, tripped = trips(data)
    violations = frame(spark, data).filter("kind = 'error'").select("event_id", "session_id", "us")
    counted = E.violation_window(violations, ["session_id"], LIMITS)
    assert {r["event_id"]: r["n_violations"] for r in counted.collect()} == n

    islands = []
    for s in sorted({s for _, s, _ in tripped}):
        for us in sorted(t for _, s2, t in tripped if s2 == s):
            if islands and islands[-1][0] == s and us <= islands[-1][2]:
                islands[-1] = (s, islands[-1][1], us + LIMITS.quarantine_us, islands[-1][3] + 1)
            else:
                islands.append((s, us, us + LIMITS.quarantine_us, 1))
    got = E.quarantine_intervals(E.breaker_trips(violations, ["session_id"], LIMITS), ["session_id"], LIMITS)
    assert sorted(tuple(r) for r in got.collect()) == sorted(islands) and islands

    asof = E.quarantine_asof(frame(spark, data), ["session_id"], F.col("kind") == "error", LIMITS)
    for r in asof.collect():
        last = max((t for _, s, t in tripped if s == r["session_id"] and t <= r["us"]), default=None)
        left = 0 if last is None else max(0, last + LIMITS.quarantine_us - r["us"])
        assert (r["quarantined"], r["remaining_s"]) == (left > 0, left // 1_000_000)


@pytest.mark.parametrize("seed", [21])
def test_write_gate_and_budget(spark, seed):
    data = log(seed)
    _, tripped = trips(data)
    gated = E.write_gate(
        frame(spark, data), ["session_id"], is_violation=F.col("kind") == "error", is_query=F.col("kind") == "query",
        is_write=F.col("kind") == "write", spent_us="spent_us", limits=LIMITS,
    )
    seen = set()
    for r in gated.collect():
        past = [(us, kind, spent) for _, s, us, kind, spent in data if s == r["session_id"] and us < r["us"]]
        last = max((t for _, s, t in tripped if s == r["session_id"] and t < r["us"]), default=None)
        n = sum(1 for us, kind, _ in past if kind == "query" and r["us"] - us < LIMITS.rate_us)
        spent = sum(c for us, _, c in past if r["us"] - us < LIMITS.compute_us)
        if r["kind"] == "write" and last is not None and r["us"] < last + LIMITS.quarantine_us:
            want = "QUARANTINED"
        elif n >= LIMITS.max_queries:
            want = "RATE_LIMITED"
        else:
            want = "COMPUTE_EXHAUSTED" if spent >= LIMITS.max_compute_us else "ALLOWED"
        assert r["verdict"] == want
        seen.add(want)
    assert seen == {"QUARANTINED", "RATE_LIMITED", "COMPUTE_EXHAUSTED", "ALLOWED"}


def test_health_reads_only_what_matters(spark):
    data = log(31)
    at = data[-1][2] - 5_000_000
    keys = {"is_violation": F.col("kind") == "error", "is_query": F.col("kind") == "query", "spent_us": "spent_us"}
    got = {r["session_id"]: r for r in E.health_snapshot(frame(spark, data), ["session_id"], at, limits=LIMITS, **keys).collect()}
    _, tripped = trips(data)
    assert set(got) == {s for _, s, us, *_ in data if us <= at}
    for s, r in got.items():
        past = [(us, kind, c) for _, s2, us, kind, c in data if s2 == s and us <= at]
        last = max((t for _, s2, t in tripped if s2 == s and t <= at), default=0)
        assert r["is_quarantined"] == (at < last + LIMITS.quarantine_us)
        assert r["violations_in_window"] == sum(1 for us, k, _ in past if k == "error" and at - us < LIMITS.violation_us)
        assert r["queries_in_window"] == sum(1 for us, k, _ in past if k == "query" and at - us < LIMITS.rate_us)
        assert r["compute_s"] == round(sum(c for us, _, c in past if at - us < LIMITS.compute_us) / 1e6, 3)


def test_a_reset_clears_every_rule(spark):
    base = 1_700_000_000_000_000
    data = [(i, "s", base + i * 1_000_000, k, 0) for i, k in enumerate(["error", "error", "reset", "error", "error", "error"])]
    marked = E.reset_epochs(frame(spark, data), ["session_id"], F.col("kind") == "reset", LIMITS)
    counted = E.violation_window(marked.filter("kind = 'error'"), ["session_id", "epoch"], LIMITS)
    assert [r["n_violations"] for r in counted.orderBy("us").collect()] == [1, 2, 1, 2, 3]


def test_state_tables(spark):
    schema = "session_id string, violations bigint, quarantine_until bigint, last_seen bigint"
    stored = spark.createDataFrame([("a", 1, None, 10), ("b", 4, 100, 20)], schema)
    updates = spark.createDataFrame([("a", 2, 50, 30), ("a", 3, 60, 40), ("c", 1, None, 5), ("b", 9, 1, 20)], schema)
    merged = E.state_upsert(stored, updates)
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 3, 60, 40), ("b", 9, 1, 20), ("c", 1, None, 5)]
    reloaded = E.state_merge(stored, updates, 55)
    assert sorted(map(tuple, reloaded.collect()), key=str) == [("a", 3, 60), ("b", 9, 100), ("c", 1, None)]
    assert [r["session_id"] for r in E.state_delete(merged, spark.createDataFrame([("a",), ("b",)], "session_id string")).collect()] == ["c"]


def test_replay_rule(spark):
    rows = [("QUERY_REJECTED", "AST", None, True), ("QUERY_REJECTED", "ROLE", None, False), ("QUERY_ACCEPTED", None, None, False),
            ("MUTATION_REJECTED", None, "bad operator key", True), ("MUTATION_REJECTED", None, "unknown token", False)]
    df = spark.createDataFrame(rows, "type string, stage string, reason string, want boolean")
    assert df.filter(E.log_violation() != F.col("want")).count() == 0


def test_sessions_without_a_name_are_limited_too(spark):
    data = [(i, None if i % 2 else "x", 1_700_000_000_000_000 + i * 1000, "query", 0) for i in range(80)]
    got = E.rate_admission(frame(spark, data), "session_id", "event_id", LIMITS)
    admitted = {r["event_id"]: r["admitted"] for r in got.collect()}
    assert admitted == fold(data, LIMITS.max_queries, LIMITS.rate_us)
