"""Queries on windowed enforcement, with the events as the log.

A violation is an error, a write is a purchase, compute is the event's value. The
given events are sparse, so windows are days where the defaults are minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.operators import enforce as E
from sparkward.operators.running import HOUR_US, Cut
from sparkward.plans import inputs as I
from sparkward.plans.registry import query
from sparkward.session import written

LIMITS = E.Limits(
    max_violations=5, violation_window_s=7 * 86_400, quarantine_s=86_400,
    max_queries=5, rate_window_s=86_400, max_compute_us=300_000_000, compute_window_s=86_400,
    cut=Cut(HOUR_US),
)
KEYS = ["session_id"]
W, Q, R = LIMITS.violation_us, LIMITS.quarantine_us, LIMITS.rate_us
K, N, B = LIMITS.max_violations, LIMITS.max_queries, LIMITS.max_compute_us
# 2024-01-29 00:00:00 UTC, the moment of the snapshots.
AT_US = 1_706_486_400_000_000


def _violation():
    return F.col("event_type") == "error"


def violations(spark, root) -> DataFrame:
    return I.events(spark, root).filter(_violation()).select("event_id", "session_id", "us")


def _count_over(width: int, by: str = "session_id") -> str:
    return f"(PARTITION BY {by} ORDER BY us RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


_VIOLATIONS = f"""viol AS (SELECT event_id, session_id, us, count(*) OVER {_count_over(W)} AS n_violations
    FROM ev WHERE event_type = 'error')"""
_EV = I.with_sql("ev", "").rstrip()


@query("violation_window", f"{_EV}, {_VIOLATIONS} SELECT * FROM viol")
def violation_window(spark, root):
    return E.violation_window(violations(spark, root), KEYS, LIMITS)


@query("breaker_trips", f"{_EV}, {_VIOLATIONS} SELECT * FROM viol WHERE n_violations >= {K}")
def breaker_trips(spark, root):
    return E.breaker_trips(violations(spark, root), KEYS, LIMITS)


@query("quarantine_intervals", f"""{_EV}, {_VIOLATIONS},
    marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id ORDER BY us) <= {Q} THEN 0 ELSE 1 END
               AS opens FROM viol WHERE n_violations >= {K}),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY us) AS island FROM marked)
    SELECT session_id, min(us) AS start_us, max(us) + {Q} AS end_us, count(*) AS n_trips
    FROM numbered GROUP BY session_id, island""")
def quarantine_intervals(spark, root):
    return E.quarantine_intervals(E.breaker_trips(violations(spark, root), KEYS, LIMITS), KEYS, LIMITS)


_TRIPPED = f"""counted AS (SELECT *, count(CASE WHEN event_type = 'error' THEN 1 END) OVER {_count_over(W)} AS nv
                            FROM ev),
    tripped AS (SELECT *, CASE WHEN event_type = 'error' AND nv >= {K} THEN us END AS trip_us FROM counted)"""


@query("quarantine_asof", f"""{_EV}, {_TRIPPED},
    latest AS (SELECT *, max(trip_us) OVER (PARTITION BY session_id ORDER BY us) AS last FROM tripped)
    SELECT event_id, session_id, us, coalesce(us < last + {Q}, false) AS quarantined,
           CASE WHEN us < last + {Q} THEN (last + {Q} - us) // 1000000 ELSE 0 END AS remaining_s FROM latest""")
def quarantine_asof(spark, root):
    events = I.events(spark, root).select("event_id", "session_id", "us", "event_type")
    return E.quarantine_asof(events, KEYS, _violation(), LIMITS).drop("event_type")


def _before(width: int) -> str:
    return f"(PARTITION BY session_id ORDER BY us RANGE BETWEEN {width - 1} PRECEDING AND 1 PRECEDING)"


@query("write_gate", f"""{_EV}, {_TRIPPED}, judged AS (
    SELECT *, max(trip_us) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING
                                 AND 1 PRECEDING) AS last,
           count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) OVER {_before(R)} AS nq,
           coalesce(sum(spent_us) OVER {_before(R)}, 0) AS spent FROM tripped)
    SELECT event_id, event_type, CASE WHEN event_type = 'purchase' AND us < last + {Q} THEN 'QUARANTINED'
        WHEN nq >= 3 THEN 'RATE_LIMITED' WHEN spent >= {B} THEN 'COMPUTE_EXHAUSTED' ELSE 'ALLOWED' END AS verdict
    FROM judged""")
def write_gate(spark, root):
    events = I.events(spark, root).select("event_id", "session_id", "us", "event_type", "spent_us")
    tight = E.Limits(**{**LIMITS.__dict__, "max_queries": 3})
    gated = E.write_gate(
        events, KEYS, is_violation=_violation(), is_query=F.col("event_type").isin("view", "click"),
        is_write=F.col("event_type") == "purchase", spent_us="spent_us", limits=tight,
    )
    return gated.select("event_id", "event_type", "verdict")


@query("rate_window", f"{_EV} SELECT event_id, session_id, us, count(*) OVER {_count_over(R)} AS n_queries FROM ev")
def rate_window(spark, root):
    return E.rate_window(I.events(spark, root).select("event_id", "session_id", "us"), KEYS, LIMITS)


# The recurrence, one event of every session per step; `kept` holds the admitted times.
@query("rate_admission", f"""WITH RECURSIVE ev AS ({I.SQL['ev']}),
    placed AS (SELECT event_id, session_id, us,
               row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS rn FROM ev),
    fold(session_id, rn, event_id, us, kept, admitted) AS (
        SELECT session_id, rn, event_id, us, [us], true FROM placed WHERE rn = 1
        UNION ALL
        SELECT p.session_id, p.rn, p.event_id, p.us,
               CASE WHEN len(list_filter(f.kept, lambda t: p.us - t < {R})) < {N}
                    THEN list_append(list_filter(f.kept, lambda t: p.us - t < {R}), p.us)
                    ELSE list_filter(f.kept, lambda t: p.us - t < {R}) END,
               len(list_filter(f.kept, lambda t: p.us - t < {R})) < {N}
        FROM fold f JOIN placed p ON p.session_id = f.session_id AND p.rn = f.rn + 1)
    SELECT event_id, session_id, us, admitted FROM fold""")
def rate_admission(spark, root):
    events = I.events(spark, root).select("event_id", "session_id", "us")
    return E.rate_admission(events, "session_id", "event_id", LIMITS)


@query("compute_budget", f"""{_EV} SELECT event_id, session_id, us,
    CAST(coalesce(sum(spent_us) OVER {_before(R)}, 0) AS BIGINT) AS spent_before_us,
    coalesce(sum(spent_us) OVER {_before(R)}, 0) >= {B} AS over_budget FROM ev""")
def compute_budget(spark, root):
    events = I.events(spark, root).select("event_id", "session_id", "us", "spent_us")
    return E.compute_budget(events, KEYS, "spent_us", LIMITS).drop("spent_us")


@query("health_snapshot", f"""{_EV}, {_TRIPPED},
    status AS (SELECT session_id, max(trip_us) AS trip,
        count(CASE WHEN event_type = 'error' AND us > {AT_US - W} THEN 1 END) AS nv,
        count(CASE WHEN event_type <> 'error' AND us > {AT_US - R} THEN 1 END) AS nq,
        coalesce(sum(CASE WHEN us > {AT_US - R} THEN spent_us END), 0) AS spent
        FROM tripped WHERE us <= {AT_US} GROUP BY session_id)
    SELECT session_id, CASE WHEN {AT_US} < trip + {Q} THEN 'QUARANTINED' ELSE 'HEALTHY' END AS status,
        coalesce({AT_US} < trip + {Q}, false) AS is_quarantined,
        coalesce(greatest((trip + {Q} - {AT_US}) // 1000000, 0), 0) AS remaining_s,
        nv AS violations_in_window, {K} AS max_violations, nq AS queries_in_window, {N} AS max_queries,
        round(spent / 1000000, 3) AS compute_s, {B} / 1000000 AS max_compute_s FROM status""")
def health_snapshot(spark, root):
    events = I.events(spark, root).select("session_id", "us", "event_type", "spent_us")
    return E.health_snapshot(
        events, KEYS, AT_US, is_violation=_violation(), is_query=F.col("event_type") != "error",
        spent_us="spent_us", limits=LIMITS,
    )


_RESET = "event_type = 'signup' AND value >= 100"


@query("reset_epochs", f"""{_EV}, marked AS (SELECT *, sum(CASE WHEN {_RESET} THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY us) AS epoch FROM ev)
    SELECT event_id, session_id, CAST(epoch AS BIGINT) AS epoch,
           count(*) OVER {_count_over(W, "session_id, epoch")} AS n_violations FROM marked WHERE event_type = 'error'""")
def reset_epochs(spark, root):
    events = I.events(spark, root).select("event_id", "session_id", "us", "event_type", "value")
    marked = E.reset_epochs(events, KEYS, F.expr(_RESET), LIMITS).filter(_violation())
    # Written once: the next rule makes several passes over it.
    marked = written(marked.select("event_id", "session_id", "us", "epoch"), "epochs")
    counted = E.violation_window(marked, [*KEYS, "epoch"], LIMITS)
    return counted.select("event_id", "session_id", "epoch", "n_violations")


_STATE = f"""{_EV}, {_VIOLATIONS},
    writes AS (SELECT session_id, us, n_violations, max(CASE WHEN n_violations >= {K} THEN us END)
               OVER (PARTITION BY session_id ORDER BY us) + {Q} AS until FROM viol),
    states AS (SELECT session_id, n_violations AS violations, CASE WHEN until > us THEN until END AS quarantine_until,
               us AS last_seen FROM writes)"""
_LAST = "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC) = 1"
_HALF_US = AT_US - 14 * 86_400_000_000


def _states(spark, root) -> DataFrame:
    return written(E.state_rows(violations(spark, root), KEYS, LIMITS), "states")


@query("state_upsert", f"{_STATE} SELECT session_id, violations, CAST(coalesce(quarantine_until, -1) AS BIGINT) "
                       f"AS quarantine_until, last_seen FROM states {_LAST}")
def state_upsert(spark, root):
    states = _states(spark, root)
    young = F.col("last_seen") > _HALF_US
    stored = E.state_upsert(states.limit(0), states.filter(~young))
    merged = E.state_upsert(stored, states.filter(young))
    return merged.withColumn("quarantine_until", F.coalesce("quarantine_until", F.lit(-1)))


@query("state_merge", f"""{_STATE}, stored AS (SELECT * FROM states WHERE last_seen <= {_HALF_US} {_LAST}),
    memory AS (SELECT session_id, count(*) AS violations, max(CASE WHEN n_violations >= {K} THEN us END) + {Q}
               AS quarantine_until FROM viol WHERE us <= {AT_US} AND us > {AT_US - W} GROUP BY session_id)
    SELECT session_id, max(violations) AS violations,
           CAST(coalesce(max(CASE WHEN quarantine_until > {AT_US} THEN quarantine_until END), -1) AS BIGINT)
           AS quarantine_until
    FROM (SELECT session_id, violations, quarantine_until FROM stored
          UNION ALL SELECT * FROM memory) GROUP BY session_id""")
def state_merge(spark, root):
    states = _states(spark, root)
    stored = E.state_upsert(states.limit(0), states.filter(F.col("last_seen") <= _HALF_US))
    recent = E.violation_window(violations(spark, root).filter(F.col("us") <= AT_US), KEYS, LIMITS)
    memory = recent.filter(F.col("us") > AT_US - W).groupBy("session_id").agg(
        F.count("*").alias("violations"),
        (F.max(F.when(F.col("n_violations") >= K, F.col("us"))) + Q).alias("quarantine_until"),
    )
    merged = E.state_merge(memory, stored, AT_US)
    return merged.withColumn("quarantine_until", F.coalesce("quarantine_until", F.lit(-1)))


@query("state_delete", f"""{_STATE}, stored AS (SELECT * FROM states {_LAST})
    SELECT session_id, violations, last_seen FROM stored
    WHERE session_id NOT IN (SELECT session_id FROM ev WHERE event_type = 'signup' AND value >= 300)""")
def state_delete(spark, root):
    states = _states(spark, root)
    stored = E.state_upsert(states.limit(0), states)
    gone = I.events(spark, root).filter("event_type = 'signup' AND value >= 300")
    return E.state_delete(stored, gone).select("session_id", "violations", "last_seen")
