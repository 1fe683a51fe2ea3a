"""Queries on the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkward.operators import audit as L
from sparkward.operators import policy as P
from sparkward.plans import inputs as I
from sparkward.plans.registry import query


@query("audit_last_n", I.with_sql("audit", """
    SELECT event_id, type, session_id FROM (SELECT * FROM audit ORDER BY event_id DESC LIMIT 200)
    WHERE event_id % 97 <> 0"""))
def audit_last_n(spark, root):
    log = I.audit_log(spark, root)
    last = L.last_events(log, "event_id", 5000, good=F.col("event_id") % 97 != 0)
    return last.select("event_id", "type", "session_id")


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query("audit_function_usage", I.with_sql("audit", f"""
    SELECT function_name, n_calls, CASE WHEN function_name IN ({_quoted(L.BLOCKED_FUNCTIONS)}) THEN 'BLOCKED_NAME'
        WHEN regexp_matches(function_name, '^({"|".join(L.BLOCKED_PREFIXES)})') THEN 'BLOCKED_PREFIX'
        WHEN function_name IN ({_quoted(L.SAFE_FUNCTIONS)}) THEN 'ALLOWLISTED' ELSE 'OTHER' END AS verdict
    FROM (SELECT f AS function_name, count(*) AS n_calls
          FROM audit, unnest(regexp_extract_all(lower(safe_sql), '([a-z_][a-z0-9_]*)\\s*\\(', 1)) u(f) GROUP BY 1)"""))
def audit_function_usage(spark, root):
    return L.function_usage(I.audit_log(spark, root), "safe_sql")


@query("audit_table_access", I.with_sql("audit", """
    SELECT lower(t) AS table_name, role, count(*) AS n_queries FROM audit, unnest(tables_accessed) u(t)
    WHERE type = 'QUERY_ACCEPTED' GROUP BY 1, 2"""))
def audit_table_access(spark, root):
    return L.table_access(I.audit_log(spark, root))


@query("audit_grant_compliance", I.with_sql("audit", """
    SELECT role, lower(t) AS table_name, count(*) AS n_queries FROM audit, unnest(tables_accessed) u(t)
    WHERE type = 'QUERY_ACCEPTED' AND lower(t) = 'supplier' GROUP BY 1, 2"""))
def audit_grant_compliance(spark, root):
    return L.grant_compliance(I.audit_log(spark, root), P.grants_table(I.role_policy(spark)))


@query("audit_rejections", I.with_sql("audit", "SELECT type, session_id, " + ", ".join(
    f"count(CASE WHEN stage = '{s}' THEN 1 END) AS {s.lower()}" for s in L.STAGES) + """,
    count(*) - count(stage) AS no_stage FROM audit WHERE type IN ('QUERY_REJECTED', 'MUTATION_REJECTED')
    GROUP BY 1, 2"""))
def audit_rejections(spark, root):
    return L.rejections(I.audit_log(spark, root))


@query("audit_rejection_rollup", I.with_sql("audit", """
    SELECT type, stage, count(*) AS n, CAST(grouping_id(type, stage) AS INT) AS level
    FROM (SELECT type, coalesce(stage, 'NONE') AS stage FROM audit
          WHERE type IN ('QUERY_REJECTED', 'MUTATION_REJECTED')) GROUP BY ROLLUP (type, stage)"""))
def audit_rejection_rollup(spark, root):
    return L.rejection_rollup(I.audit_log(spark, root))


@query("audit_usage", I.with_sql("audit", """
    SELECT us // 86400000000 * 86400000000 AS bucket_us, session_id, count(*) AS n_queries,
           CAST(sum(row_count) AS BIGINT) AS n_rows, CAST(sum(CAST(exec_ms AS DECIMAL(28,6))) AS DOUBLE) AS exec_ms_sum,
           max(exec_ms) AS exec_ms_max, quantile_disc(exec_ms, 0.5) AS exec_ms_p50
    FROM audit WHERE type = 'QUERY_ACCEPTED' GROUP BY 1, 2"""))
def audit_usage(spark, root):
    return L.usage(I.audit_log(spark, root), "1 day")
