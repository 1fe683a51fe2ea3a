"""Queries on sources, policy and access scope."""

from __future__ import annotations

from functools import lru_cache, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.functions.masking import masked_view
from sparkward.operators import policy as P
from sparkward.operators.enforce import Limits
from sparkward.plans import check_sql as C
from sparkward.plans import inputs as I
from sparkward.plans.recorded import Reader, read
from sparkward.plans.registry import query
from sparkward.plans.views import (
    GovernedSession, governed_query, governed_result, governed_session, readable_tables,
)
from sparkward.session import scratch_path
from sparkward.sources import audit_log as A
from sparkward.streaming.streams import run_to_table, split_alerts


@lru_cache(maxsize=16)
def role_session(spark: SparkSession, root: str, role: str = "reader") -> GovernedSession:
    """The session of a shipped role over the given tables, customers masked."""
    loaders = {t: partial(I.table, root=root, name=t) for t in I.TABLES}
    loaders["customer"] = partial(I.customer_pii, root=root)
    grants = P.grants_table(I.role_policy(spark))
    return governed_session(
        spark, loaders, readable_tables(grants, role),
        masked={"customer": masked_view}, restricted=I.RESTRICTED,
    )


@query("scan_table", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def scan_table(spark, root):
    orders = I.scan_table(spark, root, " Orders", I.OPEN_TABLES)
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def _entries(spark, root) -> DataFrame:
    """Audit events in the log's own field names."""
    log = I.audit_log(spark, root)
    return log.select(
        (F.col("us") / 1_000_000).alias("ts"), "type", "session_id", "stage", "raw_input",
        "reason", "safe_sql", "tables_accessed", "row_count", "exec_ms", "role", "event_id",
    )


@query("audit_read", I.with_sql("audit", """
    SELECT CASE WHEN event_id % 97 = 0 THEN 'BAD LINE' ELSE type END AS type, count(*) AS n,
           CAST(coalesce(sum(CASE WHEN event_id % 97 <> 0 THEN row_count END), 0) AS BIGINT) AS n_rows,
           count(CASE WHEN event_id % 97 <> 0 THEN stage END) AS n_staged,
           max(CASE WHEN event_id % 97 <> 0 THEN us ELSE 0 END) AS last_us
    FROM audit GROUP BY 1"""))
def audit_read(spark, root):
    entries = _entries(spark, root)
    line = F.when(F.col("event_id") % 97 == 0, F.lit('{"ts": 12.5, "type": "QUERY_'))
    line = line.otherwise(F.to_json(F.struct(*[c for c in entries.columns if c != "event_id"])))
    blank = F.when(F.col("event_id") % 89 == 0, F.concat(line, F.lit("\n"))).otherwise(line)
    path = scratch_path(spark, "audit-lines")
    entries.select(blank.alias("value")).write.text(path)
    log = A.read_audit(spark, path)
    at_us = F.unix_micros(A.event_time(F.col("ts")))
    return log.groupBy(F.coalesce("type", F.lit("BAD LINE")).alias("type")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"),
        F.count("stage").alias("n_staged"), F.coalesce(F.max(at_us), F.lit(0)).alias("last_us"),
    )


@query("audit_append", I.with_sql("audit", """
    SELECT type, count(*) AS n, CAST(0 AS BIGINT) AS n_leaks,
           count(CASE WHEN regexp_matches(raw_input, '\\*\\*\\*') THEN 1 END) AS n_scrubbed FROM (
        SELECT type, """ + C.scrub("raw_input") + """ AS raw_input FROM audit) GROUP BY 1"""))
def audit_append(spark, root):
    path = scratch_path(spark, "audit-append")
    entries = _entries(spark, root).drop("event_id")
    severe = F.col("type").isin(*A.ALERT_TYPES)
    A.append_audit(entries.filter(severe), path)
    A.append_audit(entries.filter(~severe), path)
    raw = F.col("raw_input")
    return A.good_events(A.read_audit(spark, path)).groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(raw.rlike("hunter[0-9]|s3cr?3t[0-9']|Secret=abc")).alias("n_leaks"),
        F.count_if(raw.contains("***")).alias("n_scrubbed"),
    )


@query("audit_stream", I.with_sql("audit", """
    SELECT type, role, count(*) AS n, CAST(sum(CAST(exec_ms AS DECIMAL(18,2))) AS DOUBLE) AS exec_ms
    FROM audit GROUP BY 1, 2"""))
def audit_stream(spark, root):
    path = scratch_path(spark, "audit-followed")
    A.append_audit(_entries(spark, root).drop("event_id"), path)
    followed = run_to_table(A.stream_audit(spark, path).select("type", "role", "exec_ms"), "followed")
    return followed.groupBy("type", "role").agg(
        F.count("*").alias("n"), F.sum(F.col("exec_ms").cast("decimal(18,2)")).cast("double").alias("exec_ms")
    )


@query("alerts", I.with_sql("audit", """
    SELECT type, coalesce(stage, 'NONE') AS stage, count(*) AS n FROM audit
    WHERE type IN ('CIRCUIT_BREAKER_TRIP', 'MUTATION_REJECTED', 'QUERY_REJECTED') GROUP BY 1, 2"""))
def alerts(spark, root):
    path = scratch_path(spark, "alerts")
    A.append_audit(_entries(spark, root).drop("event_id"), f"{path}/in")
    stream = A.good_events(A.stream_audit(spark, f"{path}/in"))
    split_alerts(stream, f"{path}/log", f"{path}/alerts", f"{path}/checkpoint").awaitTermination()
    sent = spark.read.schema(A.AUDIT_SCHEMA).json(f"{path}/alerts")
    return sent.groupBy("type", F.coalesce("stage", F.lit("NONE")).alias("stage")).agg(F.count("*").alias("n"))


@query("result_export", """
    SELECT concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '","price":"',
                  CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '","day":"',
                  strftime(o_orderdate, '%Y-%m-%d'), '","none":null}') AS json FROM orders""")
def result_export(spark, root):
    return A.as_json_rows(
        I.table(spark, root, "orders").selectExpr(
            "o_orderkey", "o_orderstatus", "CAST(o_totalprice AS DECIMAL(12,2)) AS price",
            "CAST(o_orderdate AS DATE) AS day", "CAST(NULL AS STRING) AS none",
        )
    )


_GRANTS = """grants AS (
    SELECT DISTINCT role, lower(t) AS table_name, 'read' AS privilege FROM policy, unnest(tables_read) u(t)
    UNION ALL
    SELECT DISTINCT role, lower(t), 'write' FROM policy, unnest(tables_write) u(t))"""


@query("grants_table", I.with_sql("policy", "").rstrip() + f", {_GRANTS} SELECT * FROM grants")
def grants_table(spark, root):
    return P.grants_table(I.policy(spark, root))


@query("role_capabilities", I.with_sql("policy", """
    SELECT role, coalesce(can_propose, false) AS can_propose, coalesce(can_approve, false) AS can_approve,
           coalesce(management, false) AS management FROM policy"""))
def role_capabilities(spark, root):
    return P.role_capabilities(I.policy(spark, root))


@query("resolve_role", I.with_sql("requests policy", """
    SELECT r.request_id, r.role, coalesce(p.role, 'r0') AS active_role,
           CASE WHEN s.role IS NULL THEN 'orders,nation'
                ELSE coalesce(array_to_string(list_transform(s.tables_read, lambda x: lower(x)), ','), '') END
           AS spec_reads
    FROM requests r LEFT JOIN policy p ON p.role = lower(r.role)
    LEFT JOIN policy s ON s.role = r.role"""))
def resolve_role(spark, root):
    policy = I.policy(spark, root)
    resolved = P.resolve_role(I.requests(spark, root).select("request_id", "role"), policy, "r0")
    return P.role_spec(resolved, policy, ["Orders", "nation"]).select(
        "request_id", "role", "active_role", F.concat_ws(",", "tables_read").alias("spec_reads")
    )


@query("policy_validate", I.with_sql("policy", """
    SELECT d.name AS default_role, count(*) AS n_roles, bool_or(p.role = d.name) AS has_default,
           CAST(0 AS BIGINT) AS n_unnamed, NOT bool_or(p.role = d.name) AS degraded,
           CASE WHEN bool_or(p.role = d.name) THEN 'ok' ELSE 'default role not in roles' END AS reason
    FROM policy p, (VALUES ('r0'), ('nobody')) d(name) GROUP BY 1"""))
def policy_validate(spark, root):
    policy = I.policy(spark, root)
    checks = [
        P.policy_problems(policy, name).select(F.lit(name).alias("default_role"), "*")
        for name in ("r0", "nobody")
    ]
    return checks[0].unionByName(checks[1])


@query("denied_reads", I.with_sql("policy requests", "").rstrip() + f""", {_GRANTS}, touched AS (
    SELECT DISTINCT request_id, role, lower(t) AS table_name FROM requests, unnest(tables_accessed) u(t))
    SELECT request_id, role, string_agg(table_name, ',' ORDER BY table_name) AS denied FROM touched x
    WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.role = x.role AND g.table_name = x.table_name
                      AND g.privilege = 'read') GROUP BY 1, 2""")
def denied_reads(spark, root):
    grants = P.grants_table(I.policy(spark, root))
    denied = P.denied_tables(I.requests(spark, root), grants, "read")
    return denied.withColumn("denied", F.concat_ws(",", "denied"))


@query("denied_writes", I.with_sql("policy proposals", "").rstrip() + f""", {_GRANTS}, touched AS (
    SELECT DISTINCT proposal_token, concat('r', CAST(o_custkey AS STRING)) AS role, lower(t) AS table_name
    FROM proposals, unnest(target_tables) u(t))
    SELECT proposal_token, role, string_agg(table_name, ',' ORDER BY table_name) AS denied FROM touched x
    WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.role = x.role AND g.table_name = x.table_name
                      AND g.privilege = 'write') GROUP BY 1, 2""")
def denied_writes(spark, root):
    grants = P.grants_table(I.policy(spark, root))
    asked = I.proposals(spark, root).withColumn("role", F.concat(F.lit("r"), F.col("o_custkey").cast("string")))
    denied = P.denied_tables(asked, grants, "write", "proposal_token", "target_tables")
    return denied.withColumn("denied", F.concat_ws(",", "denied"))


_VIEW_COUNTS = " UNION ALL ".join(
    f"SELECT '{r}' AS role, '{t}' AS table_name, count(*) AS n_rows, "
    f"{'count(*)' if t == 'customer' else 'CAST(0 AS BIGINT)'} AS n_masked FROM {t}"
    for r in I.ROLES for t in I.OPEN_TABLES
)


@query("governed_views", _VIEW_COUNTS)
def governed_views(spark, root):
    """Per role, the views it sees: their rows, and how many show a masked email."""
    parts = []
    for role in I.ROLES:
        governed = role_session(spark, root, role)
        for name in sorted(governed.visible):
            view = governed.table(name)
            masked = F.count_if(F.col("email").contains("***")) if "email" in view.columns else F.lit(0)
            counted = view.agg(F.count("*").alias("n_rows"), masked.cast("bigint").alias("n_masked"))
            parts.append(counted.select(F.lit(role).alias("role"), F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query("restricted_filter", I.with_sql("audit", """
    SELECT lower(t) AS table_name, count(*) AS n FROM audit, unnest(tables_accessed) u(t)
    WHERE lower(t) <> 'supplier' GROUP BY 1"""))
def restricted_filter(spark, root):
    named = I.audit_log(spark, root).select(F.explode("tables_accessed").alias("t"))
    counted = named.groupBy(F.lower("t").alias("table_name")).agg(F.count("*").alias("n"))
    return P.restricted_filter(counted, I.as_table(spark, "table_name", I.OPEN_TABLES), "table_name")


@query("row_filter", """
    SELECT 'unset' AS mode, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer
    UNION ALL SELECT 'empty', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
    UNION ALL SELECT 'tenant', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
              WHERE CAST(c_nationkey AS VARCHAR) = '7'
    UNION ALL SELECT 'passthrough', 0, 0""")
def row_filter(spark, root):
    customers = I.table(spark, root, "customer")
    modes = {"unset": (None, False), "empty": ("", False), "tenant": ("7", False), "passthrough": ("7", True)}
    parts = [
        P.row_filter(customers, "c_nationkey", tenant, passthrough)
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("c_custkey"), F.lit(0)).alias("keys"))
        .select(F.lit(mode).alias("mode"), "n", "keys")
        for mode, (tenant, passthrough) in modes.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("capability_gate", I.with_sql("requests policy", """
    SELECT kind, verdict, count(*) AS n FROM (
        SELECT kind, CASE WHEN kind = 'propose' AND NOT coalesce(can_propose, false) THEN 'FORBIDDEN_ROLE'
                          WHEN kind = 'apply' AND NOT coalesce(can_approve, false) THEN 'FORBIDDEN_ROLE'
                          WHEN kind = 'reset' AND NOT coalesce(management, false) THEN 'FORBIDDEN_ROLE'
                          ELSE 'ALLOWED' END AS verdict
        FROM requests r LEFT JOIN policy p ON p.role = r.role) GROUP BY 1, 2"""))
def capability_gate(spark, root):
    gated = P.capability_gate(I.requests(spark, root), I.policy(spark, root))
    return gated.groupBy("kind", "verdict").agg(F.count("*").alias("n"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("grant_matrix", """
    WITH policy AS (SELECT c_mktsegment AS role, """ + I.POLICY_COLUMNS["tables_read"] + """ AS tables_read, """
       + I.POLICY_COLUMNS["tables_write"] + """ AS tables_write FROM customer), """ + _GRANTS + """,
    cells AS (SELECT DISTINCT role, table_name, p FROM (
        SELECT role, table_name, unnest(CASE WHEN privilege = 'write'
               THEN ['delete', 'insert', 'select', 'update'] ELSE ['select'] END) AS p
        FROM grants WHERE table_name <> 'region'))
    SELECT table_name, """ + ", ".join(
    f"coalesce(string_agg(CASE WHEN role = '{s}' THEN p END, ',' ORDER BY p), '') AS \"{s}\"" for s in _SEGMENTS
) + " FROM cells GROUP BY 1")
def grant_matrix(spark, root):
    by_segment = I.table(spark, root, "customer").selectExpr(
        "c_mktsegment AS role",
        *[f"{I.POLICY_COLUMNS[c]} AS {c}" for c in ("tables_read", "tables_write")],
    )
    grants = P.grants_table(by_segment).distinct()
    return P.grant_matrix(grants, I.as_table(spark, "table_name", ["region"]), _SEGMENTS)


REVENUE_TEXT = """
    WITH sold AS (
        SELECT o_custkey, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS revenue
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT n_name, count(*) AS n_customers, CAST(sum(revenue) AS DOUBLE) AS revenue,
           max(email) AS last_email, max(phone) AS last_phone
    FROM sold JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 500;
"""
REVENUE_SQL = I.with_sql("customer_pii", "").rstrip() + f""", view AS ({C.CUSTOMER_VIEW}), sold AS (
    SELECT o_custkey, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS revenue
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey), r AS (
    SELECT n_name, count(*) AS n_customers, CAST(sum(revenue) AS DOUBLE) AS revenue,
           max(email) AS last_email, max(phone) AS last_phone
    FROM sold JOIN view ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)
    SELECT n_name, n_customers, revenue, {C.mask('last_email', 'email')} AS last_email,
           {C.mask('last_phone', 'phone')} AS last_phone FROM r ORDER BY revenue DESC, n_name LIMIT 100"""


@query("governed_query", REVENUE_SQL)
def governed_read(spark, root):
    return governed_query(role_session(spark, root), REVENUE_TEXT)


_CONTACT_TEXT = """SELECT c_custkey, c_name, email, phone FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey DESC"""


@query("governed_result", I.with_sql("customer_pii", "").rstrip() + f""", view AS ({C.CUSTOMER_VIEW}),
    top AS (SELECT c_custkey, c_name, {C.mask('email', 'email')} AS email, {C.mask('phone', 'phone')} AS phone
            FROM view WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey DESC LIMIT 100),
    sized AS (SELECT CAST(sum(octet_length(encode(to_json({{c_custkey: c_custkey, c_name: c_name, email: email,
              phone: phone}})))) OVER (ORDER BY c_custkey DESC) AS BIGINT) AS upto FROM top)
    SELECT count(*) AS row_count, max(upto) AS payload_bytes, true AS truncated,
           'Result truncated: Exceeded maximum payload size (6 KB).' AS truncation_reason, 'customer,orders' AS tables
    FROM sized WHERE upto <= 6144""")
def governed_measures(spark, root):
    result = governed_result(role_session(spark, root), _CONTACT_TEXT, max_bytes=6 * 1024)
    return result.metrics_row().withColumn("tables", F.lit(",".join(result.tables)))


_FLOW = {
    "count": "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey) / count(*) AS mean_key FROM orders GROUP BY o_orderstatus",
    "top": "SELECT c_name, email FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "other_role": "SELECT count(*) AS n FROM lineitem",
    "two": "SELECT 1 AS one; SELECT 2",
    "fails": "SELECT max(1 / (o_orderkey - o_orderkey)) AS x FROM orders",
}
_SPAN = "(SELECT max(us) + 1000000 FROM audit)"


@query("governed_flow", I.with_sql("audit", f"""
    , state AS (
        SELECT role, count(*) FILTER (type = 'QUERY_ACCEPTED' OR type = 'QUERY_REJECTED' AND coalesce(stage, '') NOT IN ('RATE_LIMIT', 'CB')) AS queries,
               sum(CASE WHEN type = 'QUERY_ACCEPTED' THEN exec_ms ELSE 0 END) AS ms,
               count(*) FILTER (stage = 'AST' AND type IN ('QUERY_REJECTED', 'MUTATION_REJECTED') OR reason = 'bad operator key') AS bad
        FROM audit WHERE us > {_SPAN} - 864000000000 GROUP BY role),
    asked AS (SELECT * FROM (VALUES ('reader', 1000000000, 1000000000), ('editor', 1, 1000000000), ('admin', 1000000000, 1)) AS v(role, most, ms_most)),
    given AS (SELECT role, coalesce(queries, 0) >= most OR coalesce(ms, 0) >= ms_most AS shut, coalesce(bad, 0) AS bad FROM asked LEFT JOIN state USING (role)),
    texts AS (SELECT * FROM (VALUES (0, 'count', CAST((SELECT count(DISTINCT o_orderstatus) FROM orders) AS BIGINT), 'orders', NULL),
        (1, 'top', least(20, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey)), 'customer,orders', NULL),
        (2, 'other_role', NULL, NULL, 'ROLE'), (3, 'two', NULL, NULL, 'AST'), (4, 'fails', NULL, NULL, 'DB')) AS v(i, name, n, tables, stage)),
    reads AS (SELECT role, i, CASE WHEN shut OR stage IS NOT NULL THEN 'QUERY_REJECTED' ELSE 'QUERY_ACCEPTED' END AS type,
            CASE WHEN shut THEN 'RATE_LIMIT' ELSE stage END AS stage, CASE WHEN NOT shut THEN n END AS row_count, CASE WHEN NOT shut THEN tables END AS tables
          FROM given, texts),
    trips AS (SELECT role, 3 AS i, 'CIRCUIT_BREAKER_TRIP' AS type, NULL AS stage, NULL AS row_count, NULL AS tables FROM given WHERE NOT shut AND bad + 1 >= 3)
    SELECT role, CAST(i AS INT) AS i, type, stage, row_count, tables, (SELECT count(*) FROM audit) + (SELECT count(*) FROM reads) + (SELECT count(*) FROM trips) AS n_logged
    FROM (FROM reads UNION ALL FROM trips)""".replace("    , state", ", state", 1)).replace(") , state", "), state"))
def governed_flow(spark, root):
    """Five reads of each of three sessions, after what the log holds already; then the log itself."""
    path, entries = scratch_path(spark, "flow"), _entries(spark, root)
    A.append_audit(entries.drop("event_id", "session_id").withColumn("session_id", F.col("role")), path)
    now = entries.agg(F.max("ts")).first()[0] + 1
    wide = {"rate_window_s": 864_000, "compute_window_s": 864_000, "violation_window_s": 864_000}
    limits = {
        "reader": Limits(max_queries=10**9, max_compute_us=10**12, **wide),
        "editor": Limits(max_queries=1, max_compute_us=10**12, **wide),
        "admin": Limits(max_queries=10**9, max_compute_us=10**3, **wide),
    }
    loaders = {t: partial(I.table, root=root, name=t) for t in I.TABLES} | {"customer": partial(I.customer_pii, root=root)}
    governed = governed_session(spark, loaders, ["customer", "orders"], masked={"customer": masked_view}, restricted=I.RESTRICTED)
    for role, limit in limits.items():
        for i, text in enumerate(_FLOW.values()):
            read(Reader(governed, path, role, role, limit), text, now=now + i / 100)
    log = A.good_events(A.read_audit(spark, path))
    mine = log.filter(F.col("ts") >= now).withColumn("i", F.round((F.col("ts") - now) * 100).cast("int"))
    total = log.agg(F.count("type").alias("n_logged"))
    return mine.select("role", "i", "type", "stage", "row_count", F.array_join("tables_accessed", ",").alias("tables")).withColumn("n_logged", total.scalar())
