"""The enforcement rules as streams over the event table, run over all it holds.

The input is finished, so the rows behind the last watermark come out too: `run_finished` ends
each stream, and the checks are the rules over all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.operators.mutate import read_version
from sparkward.plans import enforcing as N
from sparkward.plans import inputs as I
from sparkward.plans.registry import query
from sparkward.session import scratch_path
from sparkward.streaming import streams as S

DELAY = "1 day"


def followed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table, one file or a folder of them, as a stream of its files.

    Spark takes a single file as a stream only where a pattern names it.
    """
    schema = I.table(spark, root, name).schema
    return spark.readStream.schema(schema).parquet(f"{root}/{{{name}.parquet}}")


def live_events(spark: SparkSession, root: str) -> DataFrame:
    return followed(spark, root, "events").selectExpr(
        *[f"{e} AS {c}" for c, e in I.EVENT_COLUMNS.items()],
        "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "CAST(ts AS TIMESTAMP) AS at",
    )


_LIVE_VIOLATIONS = f"""WITH RECURSIVE ev AS ({I.SQL['ev']}),
    viol AS (SELECT session_id, us, row_number() OVER (PARTITION BY session_id ORDER BY us) AS rn
             FROM ev WHERE event_type = 'error'),
    fold(session_id, rn, us, recent, until) AS (
        SELECT session_id, rn, us, [us], CAST(0 AS BIGINT) FROM viol WHERE rn = 1
        UNION ALL
        SELECT session_id, rn, us, recent, CASE WHEN len(recent) >= {N.K} THEN us + {N.Q} ELSE until END FROM (
            SELECT p.session_id, p.rn, p.us,
                   list_append(CASE WHEN f.until > 0 AND p.us >= f.until THEN []
                               ELSE list_filter(f.recent, lambda t: p.us - t < {N.W}) END, p.us) AS recent,
                   CASE WHEN f.until > 0 AND p.us >= f.until THEN 0 ELSE f.until END AS until
            FROM fold f JOIN viol p ON p.session_id = f.session_id AND p.rn = f.rn + 1))
    SELECT session_id, us, len(recent) AS n_violations, len(recent) >= {N.K} AS tripped,
           until AS quarantine_until_us FROM fold"""


@query("stream_violations", _LIVE_VIOLATIONS)
def stream_violations(spark, root):
    violations = live_events(spark, root).filter("event_type = 'error'").select("session_id", "us", "at")
    return S.run_finished({"at": violations}, lambda v: S.stream_violations(v, N.LIMITS, DELAY), "trips")


@query("stream_rate", I.with_sql("ev", "").rstrip() + """,
    placed AS (SELECT session_id, unnest(generate_series(us // 21600000000 - 3, us // 21600000000)) * 21600000000
               AS start_us FROM ev)
    SELECT start_us, start_us + 86400000000 AS end_us, session_id, count(*) AS n_queries FROM placed
    GROUP BY 1, 2, 3""")
def stream_rate(spark, root):
    queries = live_events(spark, root).select("session_id", "at")
    return S.run_finished({"at": queries}, lambda q: S.stream_rate(q, "1 day", "6 hours", DELAY), "rate")


@query("stream_sessions", I.with_sql("ev", "").rstrip() + """,
    marked AS (SELECT role, us, CASE WHEN us - lag(us) OVER (PARTITION BY role ORDER BY us) < 900000000 THEN 0 ELSE 1
               END AS opens FROM ev),
    numbered AS (SELECT role, us, sum(opens) OVER (PARTITION BY role ORDER BY us) AS s FROM marked)
    SELECT role, min(us) AS start_us, max(us) + 900000000 AS end_us, count(*) AS n_events
    FROM numbered GROUP BY role, s""")
def stream_sessions(spark, root):
    events = live_events(spark, root).select("role", "at")
    return S.run_finished({"at": events}, lambda e: S.stream_sessions(e, "role", "15 minutes", DELAY), "sessions")


@query("stream_dedup", I.with_sql("ev", "SELECT event_id, session_id, us FROM ev"))
def stream_dedup(spark, root):
    """Every event replayed three times; each counts once."""
    replayed = live_events(spark, root).select(
        "event_id", "session_id", "us", "at", F.explode(F.array(*map(F.lit, range(3)))).alias("replay")
    )
    once = S.stream_dedup(replayed, "event_id", DELAY)
    return S.run_to_table(once.select("event_id", "session_id", "us"), "dedup")


@query("stream_lifecycle", I.with_sql("proposals outcomes", "").rstrip() + """,
    joined AS (SELECT p.proposal_token, p.us, o.type, o.us AS outcome_us FROM proposals p LEFT JOIN outcomes o
        ON o.proposal_token = p.proposal_token AND o.us BETWEEN p.us AND p.us + 300000000)
    SELECT proposal_token, us, coalesce(type, 'OPEN') AS outcome, coalesce(outcome_us - us, -1) AS latency_us
    FROM joined""")
def stream_lifecycle(spark, root):
    orders = followed(spark, root, "orders")
    start = f"unix_micros(CAST(o_orderdate AS TIMESTAMP)) + ({I.PROPOSED_S}) * 1000000"
    token = "concat('p', CAST(o_orderkey AS STRING))"
    proposed = orders.selectExpr(f"{token} AS proposal_token", f"timestamp_micros({start}) AS at")
    outcomes = orders.filter("o_orderstatus <> 'O'").selectExpr(
        f"{token} AS token", f"timestamp_micros({start} + ({I.OUTCOME_S}) * 1000000) AS outcome_at",
        "CASE o_orderstatus WHEN 'F' THEN 'MUTATION_APPLIED' ELSE 'MUTATION_REJECTED' END AS type",
    )
    return S.run_finished({"at": proposed, "outcome_at": outcomes}, S.stream_lifecycle, "lifecycle")


@query("stream_state", I.with_sql("ev", """
    SELECT session_id, us AS last_seen, event_type AS last_type
    FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY us DESC) = 1"""))
def stream_state(spark, root):
    """The last event of every session, kept by upserting each batch of the stream."""
    updates = live_events(spark, root).select("session_id", F.col("us").alias("last_seen"),
                                              F.col("event_type").alias("last_type"))
    place = scratch_path(spark, "state")
    S.upsert_stream(updates, f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return read_version(spark, f"{place}/table")
