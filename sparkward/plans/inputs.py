"""Inputs of the registered queries, derived by Spark from the given tables.

Each has a twin in `SQL`: the same rows for the check on the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkward.operators.policy import POLICY_SCHEMA
from sparkward.sources.tables import scan_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "pages", "labels", "conversations", "benchmark", "embeddings",
)
RESTRICTED = ("supplier",)
OPEN_TABLES = tuple(t for t in TABLES if t not in RESTRICTED)
# The columns of the open tables, as their files have them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
COLUMNS = {t: [tuple(c.split(" ")) for c in s.split(", ")] for t, s in SCHEMAS.items()}
ROLES = ("reader", "editor", "admin")
_WRITABLE = ("customer", "orders", "lineitem")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return scan_table(spark, root, name)


# Expressions both engines read alike.
EMAIL = (
    "CASE WHEN c_custkey % 10 = 0 THEN NULL "
    "WHEN c_custkey % 11 = 0 THEN concat('user', CAST(c_custkey AS STRING)) "
    "WHEN c_custkey % 13 = 0 THEN concat('ab@mail', CAST(c_custkey % 7 AS STRING), '.example.com') "
    "ELSE concat(lower(replace(c_name, '#', '.')), '@mail', CAST(c_custkey % 7 AS STRING), "
    "'.example.com') END"
)
PHONE = (
    "CASE WHEN c_custkey % 10 = 5 THEN NULL "
    "WHEN c_custkey % 11 = 3 THEN concat('x', CAST(c_custkey % 1000 AS STRING)) "
    "ELSE concat('+1 (', CAST(200 + c_custkey % 700 AS STRING), ') 555-', "
    "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END"
)
PII_COLUMNS = {
    "c_custkey": "c_custkey",
    "c_name": "c_name",
    "c_nationkey": "c_nationkey",
    "c_acctbal": "c_acctbal",
    "c_mktsegment": "c_mktsegment",
    "email": EMAIL,
    "phone": PHONE,
}


def customer_pii(spark: SparkSession, root: str) -> DataFrame:
    """Customers with an email and a phone; some missing, some malformed."""
    return table(spark, root, "customer").selectExpr(
        *[f"{e} AS {c}" for c, e in PII_COLUMNS.items()]
    )


# How an event plays a part in the audit log.
EVENT_TYPE = (
    "CASE event_type WHEN 'view' THEN 'QUERY_ACCEPTED' WHEN 'click' THEN 'QUERY_ACCEPTED' "
    "WHEN 'error' THEN CASE WHEN value < 50 THEN 'QUERY_REJECTED' ELSE 'MUTATION_REJECTED' END "
    "WHEN 'purchase' THEN 'MUTATION_PROPOSED' "
    "ELSE CASE WHEN value < 150 THEN 'MUTATION_APPLIED' ELSE 'QUARANTINE_RESET' END END"
)
ROLE = "CASE user_id % 3 WHEN 0 THEN 'reader' WHEN 1 THEN 'editor' ELSE 'admin' END"
STAGE = (
    "CASE WHEN event_type = 'error' AND value < 50 THEN CASE event_id % 6 WHEN 0 THEN 'AST' "
    "WHEN 1 THEN 'ROLE' WHEN 2 THEN 'RATE_LIMIT' WHEN 3 THEN 'TIMEOUT' WHEN 4 THEN 'CB' "
    "ELSE 'DB' END WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'AST' "
    "WHEN 1 THEN 'ROLE' END END"
)
REASON = (
    "CASE WHEN event_type = 'error' AND value >= 50 AND event_id % 3 = 2 THEN 'bad operator key' END"
)
SAFE_SQL = (
    "CASE event_type "
    "WHEN 'view' THEN 'SELECT upper(c_name), count(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 LIMIT 100' "
    "WHEN 'click' THEN 'SELECT l_returnflag, round(sum (l_quantity), 2), max(l_shipdate) FROM lineitem GROUP BY 1 LIMIT 50' "
    "WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'SELECT pg_read_file(''/etc/passwd'')' "
    "WHEN 1 THEN 'SELECT pg_sleep(10), current_setting(''data_directory'')' "
    "WHEN 2 THEN 'SELECT my_func(s_name) FROM supplier' "
    "ELSE 'SELECT lo_import(''/tmp/x''), Length(c_name) FROM customer' END "
    "ELSE 'UPDATE customer SET c_name = trim(c_name) WHERE c_custkey = 1' END"
)
RAW_INPUT = (
    "CASE WHEN event_type = 'error' THEN concat(CASE event_id % 5 "
    "WHEN 0 THEN concat('connect postgresql://alice:s3cr3t', CAST(event_id AS STRING), '@h:5432/db') "
    "WHEN 1 THEN concat('try password=hunter', CAST(event_id AS STRING), '; next') "
    "WHEN 2 THEN 'ALTER ROLE x LOGIN PASSWORD ''s3cret'' VALID' "
    "WHEN 3 THEN 'set PWD = ''a b'', Secret=abc' "
    "ELSE 'hotel lobby mailer' END, ' by ', CAST(user_id AS STRING)) END"
)
TABLES_READ = (
    "CASE event_type WHEN 'view' THEN split('customer,orders', ',') "
    "WHEN 'click' THEN CASE WHEN user_id % 5 = 0 THEN split('lineitem,Supplier', ',') "
    "ELSE split('lineitem', ',') END "
    "WHEN 'error' THEN split('supplier,ORDERS,orders', ',') "
    "WHEN 'purchase' THEN split('orders,lineitem', ',') "
    "ELSE split('customer,nation', ',') END"
)
AUDIT_COLUMNS = {
    "event_id": "event_id",
    "type": EVENT_TYPE,
    "session_id": "concat('s', CAST(user_id AS STRING))",
    "role": ROLE,
    "stage": STAGE,
    "reason": REASON,
    "raw_input": RAW_INPUT,
    "safe_sql": SAFE_SQL,
    "tables_accessed": TABLES_READ,
    "row_count": "event_id % 101",
    "exec_ms": "value",
}
EVENT_COLUMNS = {
    "event_id": "event_id",
    "session_id": "CAST(user_id AS STRING)",
    "event_type": "event_type",
    "role": ROLE,
    "value": "value",
}
# Compute seconds with two decimals, as whole microseconds.
SPENT_US = "CAST(round(value * 100) AS BIGINT) * 10000"


def events(spark: SparkSession, root: str) -> DataFrame:
    """The events as a request log: session, type, time in microseconds, compute spent."""
    return table(spark, root, "events").selectExpr(
        *[f"{e} AS {c}" for c, e in EVENT_COLUMNS.items()],
        f"{SPENT_US} AS spent_us",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS us",
    )


def audit_log(spark: SparkSession, root: str) -> DataFrame:
    """The events as audit entries."""
    return table(spark, root, "events").selectExpr(
        *[f"{e} AS {c}" for c, e in AUDIT_COLUMNS.items()],
        "unix_micros(CAST(ts AS TIMESTAMP)) AS us",
        "CAST(ts AS TIMESTAMP) AS at",
    )


# One proposal per order; its status says what came of it.
PROPOSED_S = "o_orderkey * 7 % 86400"
OUTCOME_S = "10 + o_orderkey * 7 % 590"


def proposals(spark: SparkSession, root: str) -> DataFrame:
    """One proposal per order, at a second of the order's day."""
    return table(spark, root, "orders").selectExpr(
        "concat('p', CAST(o_orderkey AS STRING)) AS proposal_token",
        "CAST(o_custkey AS STRING) AS session_id",
        f"unix_micros(CAST(o_orderdate AS TIMESTAMP)) + ({PROPOSED_S}) * 1000000 AS us",
        "CASE o_orderstatus WHEN 'O' THEN 'INSERT' WHEN 'F' THEN 'UPDATE' ELSE 'DELETE' END "
        "AS statement_type",
        "CASE WHEN o_custkey % 4 = 0 THEN split('supplier,orders', ',') "
        "ELSE split('orders,Customer', ',') END AS target_tables",
        "o_custkey",
    )


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Applied (F) and rejected (P) proposals, 10 to 599 seconds later."""
    return table(spark, root, "orders").filter("o_orderstatus <> 'O'").selectExpr(
        "concat('p', CAST(o_orderkey AS STRING)) AS proposal_token",
        "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS STRING) "
        "ELSE CAST(o_custkey + 1 AS STRING) END AS session_id",
        "CASE o_orderstatus WHEN 'F' THEN 'MUTATION_APPLIED' ELSE 'MUTATION_REJECTED' END AS type",
        f"unix_micros(CAST(o_orderdate AS TIMESTAMP)) + ({PROPOSED_S} + {OUTCOME_S}) * 1000000 "
        "AS us",
    )


POLICY_COLUMNS = {
    "role": "concat('r', CAST(c_custkey AS STRING))",
    "description": "c_name",
    "tables_read": (
        "CASE c_mktsegment WHEN 'BUILDING' THEN split('customer,ORDERS,nation', ',') "
        "WHEN 'MACHINERY' THEN split('Orders,lineitem,customer,orders', ',') "
        "WHEN 'HOUSEHOLD' THEN split('customer,nation,region', ',') "
        "WHEN 'FURNITURE' THEN split('lineitem', ',') END"
    ),
    "tables_write": (
        "CASE WHEN c_acctbal > 5000 THEN split('orders,Customer', ',') "
        "WHEN c_acctbal > 2000 THEN split('orders', ',') END"
    ),
    "can_propose": "CASE WHEN c_acctbal > 2000 THEN true WHEN c_acctbal > 0 THEN false END",
    "can_approve": "CASE WHEN c_acctbal > 5000 THEN true END",
    "management": "CASE WHEN c_acctbal > 8000 THEN true END",
}


def policy(spark: SparkSession, root: str) -> DataFrame:
    """One role per customer: tables by segment, powers by balance."""
    return table(spark, root, "customer").selectExpr(
        *[f"{e} AS {c}" for c, e in POLICY_COLUMNS.items()]
    )


REQUEST_COLUMNS = {
    "request_id": "event_id",
    "role": "concat(CASE WHEN event_type = 'error' THEN 'R' ELSE 'r' END, "
            "CAST(CASE WHEN event_type = 'signup' THEN -1 - user_id ELSE user_id END AS STRING))",
    "kind": "CASE event_type WHEN 'purchase' THEN 'apply' WHEN 'view' THEN 'propose' "
            "WHEN 'click' THEN 'reset' ELSE 'read' END",
    "tables_accessed": TABLES_READ,
}


def requests(spark: SparkSession, root: str) -> DataFrame:
    """One request per event; some of them under a role nobody has."""
    return table(spark, root, "events").selectExpr(
        *[f"{e} AS {c}" for c, e in REQUEST_COLUMNS.items()]
    )


def role_policy(spark: SparkSession) -> DataFrame:
    """The three shipped roles over the given tables."""
    readable = [t.upper() if t == "nation" else t for t in OPEN_TABLES]
    rows = [
        ("reader", "Queries the open tables.", readable, [], False, False, False),
        ("editor", "Queries, and drafts changes to some tables.", readable, list(_WRITABLE), True, False, False),
        ("admin", "Queries, reviews changes and administers.", readable, list(_WRITABLE), True, True, True),
    ]
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def as_table(spark: SparkSession, column: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _select(columns: dict[str, str], source: str, *more: str) -> str:
    cells = [f"{e} AS {c}" for c, e in columns.items()]
    return f"SELECT {', '.join([*cells, *more])} FROM {source}"


_ORDER_US = "epoch_us(o_orderdate)"
SQL = {
    "customer_pii": _select(PII_COLUMNS, "customer"),
    "ev": _select(EVENT_COLUMNS, "events", f"{SPENT_US} AS spent_us", "epoch_us(ts) AS us"),
    "audit": _select(AUDIT_COLUMNS, "events", "epoch_us(ts) AS us"),
    "policy": _select(POLICY_COLUMNS, "customer"),
    "requests": _select(REQUEST_COLUMNS, "events"),
    "proposals": (
        "SELECT concat('p', CAST(o_orderkey AS STRING)) AS proposal_token, "
        "CAST(o_custkey AS STRING) AS session_id, "
        f"{_ORDER_US} + ({PROPOSED_S}) * 1000000 AS us, "
        "CASE o_orderstatus WHEN 'O' THEN 'INSERT' WHEN 'F' THEN 'UPDATE' ELSE 'DELETE' END "
        "AS statement_type, CASE WHEN o_custkey % 4 = 0 THEN split('supplier,orders', ',') "
        "ELSE split('orders,Customer', ',') END AS target_tables, o_custkey FROM orders"
    ),
    "outcomes": (
        "SELECT concat('p', CAST(o_orderkey AS STRING)) AS proposal_token, "
        "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS STRING) "
        "ELSE CAST(o_custkey + 1 AS STRING) END AS session_id, "
        "CASE o_orderstatus WHEN 'F' THEN 'MUTATION_APPLIED' ELSE 'MUTATION_REJECTED' END AS type, "
        f"{_ORDER_US} + ({PROPOSED_S} + {OUTCOME_S}) * 1000000 AS us "
        "FROM orders WHERE o_orderstatus <> 'O'"
    ),
}


def with_sql(names: str, body: str) -> str:
    """`body` with the named inputs in front as common table expressions."""
    parts = [f"{n} AS ({SQL[n]})" for n in names.split()]
    return f"WITH {', '.join(parts)} {body}"
