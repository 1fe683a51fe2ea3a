"""Governed reads as one flow: limits, one run, measures, and the log."""

import time

import pytest
from pyspark.sql import functions as F

from sparkward.operators.enforce import Limits
from sparkward.plans import recorded as R
from sparkward.plans.views import Refused, governed_result, governed_session
from sparkward.session import scratch_path

NOW = 1_700_000_000.0


@pytest.fixture
def reader(spark):
    def loaded(session):
        return session.range(1000).select("id", F.concat(F.lit("name-"), "id").alias("name"), F.lit("own").alias("at"), F.lit(1).alias("upto"))

    governed = governed_session(spark, {"t": loaded, "hidden": loaded, "secret": loaded}, ["t"], restricted=["secret"])
    return R.Reader(governed, scratch_path(spark, "reads"), "reader", "reader")


def logged(reader):
    return [r.asDict() for r in R.log_of(reader).orderBy("ts").collect()]


def test_accepted(reader):
    out = R.read(reader, "SELECT id, name, at, upto FROM t ORDER BY id DESC LIMIT 7;", now=NOW)
    assert out.status == "SUCCESS"
    rows = out.result.rows.collect()
    assert [r["id"] for r in rows] == list(range(999, 992, -1)) and rows[0]["at"] == "own"
    assert out.result.metrics["row_count"] == 7 and not out.result.metrics["truncated"] and out.result.tables == ["t"]
    (event,) = logged(reader)
    assert (event["type"], event["session_id"], event["role"], event["row_count"], event["tables_accessed"]) == ("QUERY_ACCEPTED", "reader", "reader", 7, ["t"])
    assert event["exec_ms"] > 0 and event["ts"] == NOW


def test_one_run_for_rows_and_measures(reader):
    """Rows that differ from run to run are measured as they were returned."""
    result = governed_result(reader.governed, "SELECT id, uuid() AS u, repeat('x', CAST(rand() * 3000 AS INT)) AS pad FROM t LIMIT 60", max_bytes=40_000)
    rows = result.rows.collect()
    assert rows == result.rows.collect()
    size = sum(len(f'{{"id":{r["id"]},"u":"{r["u"]}","pad":"{r["pad"]}"}}') for r in rows)
    assert result.metrics["row_count"] == len(rows) < 60 and result.metrics["payload_bytes"] == size <= 40_000
    assert result.metrics["truncated"] and "40000" not in result.metrics["truncation_reason"] and "39 KB" in result.metrics["truncation_reason"]


def test_no_rows_and_no_room(reader):
    none = governed_result(reader.governed, "SELECT id FROM t WHERE id < 0")
    assert none.rows.count() == 0 and none.metrics == {"row_count": 0, "payload_bytes": 0, "truncated": False, "truncation_reason": ""}
    tight = governed_result(reader.governed, "SELECT id FROM t", max_bytes=3)
    assert tight.rows.columns == ["id"] and tight.rows.count() == 0 and tight.metrics["truncated"]


@pytest.mark.parametrize("text,status,stage", [
    ("SELECT * FROM hidden", "FORBIDDEN_ROLE", "ROLE"), ("SELECT * FROM secret", "REJECTED_BY_GUARDRAIL", "AST"), ("SELECT * FROM nowhere", "REJECTED_BY_GUARDRAIL", "AST"),
    ("SELECT 1; SELECT 2", "REJECTED_BY_GUARDRAIL", "AST"), ("DROP TABLE t", "REJECTED_BY_GUARDRAIL", "AST"), ("", "REJECTED_BY_GUARDRAIL", "AST"),
    ("SELECT 1 / (id - id) FROM t", "DATABASE_ERROR", "DB"), ("SELECT reflect('a', 'b')", "REJECTED_BY_GUARDRAIL", "AST"),
])
def test_refusals_are_logged_with_their_stage(reader, text, status, stage):
    out = R.read(reader, text, now=NOW)
    (event,) = logged(reader)
    assert (out.status, out.result, event["type"], event["stage"], event["raw_input"]) == (status, None, "QUERY_REJECTED", stage, text or event["raw_input"])
    assert event["rejection_reason"] and event["row_count"] is None


def test_credentials_are_not_logged(reader):
    R.read(reader, "SELECT * FROM nowhere WHERE x = 'postgresql://alice:s3cr3t@h/db'", now=NOW)
    assert "s3cr3t" not in str(logged(reader))


def with_limits(reader, **limits):
    return R.Reader(reader.governed, reader.log, reader.session_id, reader.role, Limits(**limits))


def test_rate(reader):
    few = with_limits(reader, max_queries=2)
    assert [R.read(few, "SELECT 1 AS one", now=NOW + i).status for i in range(3)] == ["SUCCESS", "SUCCESS", "THROTTLED"]
    other = R.Reader(reader.governed, reader.log, "someone else", None, few.limits)
    assert R.read(other, "SELECT 1 AS one", now=NOW + 3).status == "SUCCESS"
    # What was throttled was not started; the first two leave the window.
    assert R.read(few, "SELECT 1 AS one", now=NOW + 60.5).status == "SUCCESS"
    assert R.read(few, "SELECT 1 AS one", now=NOW + 60.7).status == "THROTTLED"


def test_compute(reader):
    for i, ms in enumerate((600.0, 500.0)):
        R.record(reader, {"ts": NOW + i, "type": "QUERY_ACCEPTED", "exec_ms": ms})
    tight = with_limits(reader, max_compute_us=1_000_000)
    assert R.standing(tight, NOW + 2) == {"queries": 2, "spent_us": 1_100_000, "violations": 0}
    assert R.read(tight, "SELECT 1 AS one", now=NOW + 2).status == "THROTTLED"
    assert R.read(tight, "SELECT 1 AS one", now=NOW + 600.5).status == "SUCCESS"


def test_the_third_violation_trips(reader):
    for i in range(3):
        R.read(reader, "SELECT 1; SELECT 2", now=NOW + i)
        R.read(reader, "SELECT * FROM hidden", now=NOW + i + 0.5)  # no violation
    trips = [e for e in logged(reader) if e["type"] == "CIRCUIT_BREAKER_TRIP"]
    assert [(e["violation_count"], e["quarantine_until"]) for e in trips] == [(3, int(NOW) + 902)]
    assert R.read(reader, "SELECT 1 AS one", now=NOW + 4).status == "SUCCESS"  # reads go on


def test_deadline(spark, reader):
    governed = governed_session(spark, {"big": lambda s: s.range(10**13)}, ["big"])
    slow = R.Reader(governed, reader.log, "slow", None, deadline_s=1.0)
    began = time.time()
    out = R.read(slow, "SELECT count(*) FROM big WHERE hash(id) = 1")
    assert (out.status, out.event["stage"]) == ("EXECUTION_TIMEOUT", "TIMEOUT") and time.time() - began < 30
    assert R.read(slow, "SELECT 1 AS one").status == "SUCCESS"


def test_old_files_are_not_read(reader, monkeypatch):
    R.record(reader, {"ts": NOW, "type": "QUERY_ACCEPTED", "exec_ms": 1.0})
    assert R.standing(reader, NOW + 1)["queries"] == 1
    monkeypatch.setattr(R, "LAG_S", -10**9)  # as if the files had been written long before the windows
    later = time.time() + 10**6
    monkeypatch.setattr(time, "time", lambda: later)
    assert R.standing(reader, later)["queries"] == 0


def test_refused_carries_its_stage(reader):
    with pytest.raises(Refused) as e:
        reader.governed.table("hidden")
    assert e.value.stage == "ROLE"
