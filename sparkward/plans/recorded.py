"""A governed read as one flow: held to the session's limits, run once, measured, and logged.

The audit log is the only state. Before a read, one pass over what was appended to it within the
longest window says how many queries the session started and how much time they took. Files that
are older are skipped by their time, so the pass does not grow with the log.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.operators.bounded import MAX_BYTES
from sparkward.operators.enforce import DEFAULTS, SECOND_US, Limits, log_violation
from sparkward.plans.views import GovernedResult, GovernedSession, Refused, governed_result
from sparkward.sources.audit_log import AUDIT_SCHEMA, CORRUPT, append_audit, good_events, read_audit

# What a read that was refused or failed is called, by stage.
STATUS = {"RATE_LIMIT": "THROTTLED", "AST": "REJECTED_BY_GUARDRAIL", "ROLE": "FORBIDDEN_ROLE", "TIMEOUT": "EXECUTION_TIMEOUT", "DB": "DATABASE_ERROR"}
#: Seconds that a file's time may lag behind its events'.
LAG_S = 60


@dataclass(frozen=True)
class Reader:
    """Who reads: a role's views, the session its reads are counted under, its limits, its log."""

    governed: GovernedSession
    log: str
    session_id: str
    role: str | None = None
    limits: Limits = DEFAULTS
    deadline_s: float | None = None


@dataclass(frozen=True)
class Outcome:
    status: str
    result: GovernedResult | None
    event: dict


def standing(reader: Reader, now: float) -> dict:
    """Queries, microseconds spent and violations of the session within the windows that end now."""
    limits = reader.limits
    reach = max(limits.rate_window_s, limits.compute_window_s, limits.violation_window_s)
    # Moments before 1970 are no file's time.
    since = datetime.fromtimestamp(max(0.0, min(now, time.time()) - reach - LAG_S), timezone.utc)
    log = good_events(read_audit(reader.governed.session, reader.log, modified_after=since))
    own = log.filter((F.col("session_id") == reader.session_id) & (F.col("ts") <= now) & (F.col("ts") > now - reach))
    age = F.lit(now) - F.col("ts")
    query = F.col("type") == "QUERY_ACCEPTED"
    started = query | ((F.col("type") == "QUERY_REJECTED") & ~F.coalesce(F.col("stage"), F.lit("")).isin("RATE_LIMIT", "CB"))
    spent = F.sum(F.when(query & (age < limits.compute_window_s), F.round(F.col("exec_ms") * 1000).cast("bigint")))
    row = own.agg(
        F.count_if(started & (age < limits.rate_window_s)).alias("queries"),
        F.coalesce(spent, F.lit(0)).alias("spent_us"),
        F.count_if(log_violation() & (age < limits.violation_window_s)).alias("violations"),
    ).first()
    return row.asDict()


def _throttle(reader: Reader, now: float) -> dict:
    seen, limits = standing(reader, now), reader.limits
    if seen["queries"] >= limits.max_queries:
        raise Refused(f"more than {limits.max_queries} queries in {limits.rate_window_s} s", "RATE_LIMIT")
    if seen["spent_us"] >= limits.max_compute_us:
        raise Refused(f"more than {limits.max_compute_us / SECOND_US:g} s of compute in {limits.compute_window_s} s", "RATE_LIMIT")
    return seen


class _Deadline:
    """Cancels the jobs of the calling thread once the time is over, also those that begin after that."""

    def __init__(self, reader: Reader):
        self.context, self.tag, self.seconds = reader.governed.session.sparkContext, f"read-{uuid.uuid4().hex}", reader.deadline_s
        self.over, self.done = False, threading.Event()

    def _watch(self) -> None:
        wait = self.seconds
        while not self.done.wait(wait):
            self.over, wait = True, 0.25
            self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> _Deadline:
        if self.seconds is not None:
            self.context.addJobTag(self.tag)
            threading.Thread(target=self._watch, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.done.set()
        if self.seconds is not None:
            self.context.removeJobTag(self.tag)


def record(reader: Reader, event: dict) -> dict:
    schema = [f for f in AUDIT_SCHEMA.fields if f.name != CORRUPT]
    whole = {"session_id": reader.session_id, "role": reader.role} | event
    row = tuple(whole.get(f.name) for f in schema)
    append_audit(reader.governed.session.createDataFrame([row], type(AUDIT_SCHEMA)(schema)).coalesce(1), reader.log)
    return whole


def read(reader: Reader, text: str, limit: int | None = None, max_bytes: int = MAX_BYTES, now: float | None = None) -> Outcome:
    """One read: refused, failed or answered, and logged either way.

    A refusal by the statement check is a violation; the one that reaches the limit is followed by
    the log's CIRCUIT_BREAKER_TRIP. As ever, a quarantine stops writes only.
    """
    at = time.time() if now is None else now
    began, deadline = time.perf_counter(), _Deadline(reader)
    seen: dict = {}
    try:
        seen = _throttle(reader, at)
        began = time.perf_counter()
        with deadline:
            result = governed_result(reader.governed, text, limit, max_bytes)
    except Refused as e:
        stage, why = e.stage, str(e)
    except (PySparkException, Py4JJavaError) as e:
        stage = "TIMEOUT" if deadline.over else "DB"
        why = f"took more than {reader.deadline_s:g} s" if deadline.over else str(e).splitlines()[0]
    else:
        event = {
            "ts": at, "type": "QUERY_ACCEPTED", "raw_input": text, "tables_accessed": result.tables,
            "row_count": result.metrics["row_count"], "exec_ms": round((time.perf_counter() - began) * 1000, 2),
        }
        return Outcome("SUCCESS", result, record(reader, event))
    event = record(reader, {"ts": at, "type": "QUERY_REJECTED", "raw_input": text, "rejection_reason": why, "stage": stage})
    if stage == "AST" and seen["violations"] + 1 >= reader.limits.max_violations:
        trip = {"type": "CIRCUIT_BREAKER_TRIP", "violation_count": seen["violations"] + 1, "quarantine_until": int(at) + reader.limits.quarantine_s}
        record(reader, {"ts": at, **trip})
    return Outcome(STATUS[stage], None, event)


def log_of(reader: Reader) -> DataFrame:
    """All good events of the reader's log."""
    return good_events(read_audit(reader.governed.session, reader.log))
