"""Queries on reviewed mutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.operators import mutate as U
from sparkward.operators import policy as P
from sparkward.plans import inputs as I
from sparkward.plans.registry import query
from sparkward.session import scratch_path

_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _orders(spark, root) -> DataFrame:
    return I.table(spark, root, "orders").select(*_COLUMNS.split(", "))


# New orders: one for each customer, under keys no order has.
_NEW = (
    "SELECT -1 - c_custkey AS o_orderkey, c_custkey AS o_custkey, 'O' AS o_orderstatus, "
    "c_acctbal AS o_totalprice, '5-LOW' AS o_orderpriority FROM customer"
)


def _insert(spark, root) -> U.Mutation:
    rows = I.table(spark, root, "customer").selectExpr(
        "-1 - c_custkey AS o_orderkey", "c_custkey AS o_custkey", "'O' AS o_orderstatus",
        "c_acctbal AS o_totalprice", "'5-LOW' AS o_orderpriority",
    )
    return U.Mutation(U.INSERT, rows=rows)


def _update() -> U.Mutation:
    # NULL where the balance is not over 1000 among urgent orders: not TRUE, not touched.
    where = F.expr("CASE WHEN o_totalprice > 1000 THEN o_orderpriority = '1-URGENT' END")
    values = {"o_orderstatus": F.lit("U"), "o_totalprice": F.round(F.col("o_totalprice") / 2, 1)}
    return U.Mutation(U.UPDATE, where, values)


_HIT = "coalesce(CASE WHEN o_totalprice > 1000 THEN o_orderpriority = '1-URGENT' END, false)"
_HALF = "round(o_totalprice / 2, 1)"


def _delete() -> U.Mutation:
    return U.Mutation(U.DELETE, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100_000))


_GONE = "(o_orderstatus = 'F' AND o_totalprice > 100000)"


@query("mutation_insert", f"SELECT {_COLUMNS} FROM orders UNION ALL {_NEW}")
def mutation_insert(spark, root):
    return U.transformed(_orders(spark, root), _insert(spark, root))


_UPDATED = (
    f"SELECT o_orderkey, o_custkey, CASE WHEN {_HIT} THEN 'U' ELSE o_orderstatus END AS o_orderstatus, "
    f"CASE WHEN {_HIT} THEN {_HALF} ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders"
)


@query("mutation_update", _UPDATED)
def mutation_update(spark, root):
    return U.transformed(_orders(spark, root), _update())


@query("mutation_delete", f"SELECT {_COLUMNS} FROM orders WHERE NOT {_GONE}")
def mutation_delete(spark, root):
    return U.transformed(_orders(spark, root), _delete())


@query("mutation_affected", f"""
    SELECT 'INSERT' AS kind, count(*) AS affected_rows FROM customer
    UNION ALL SELECT 'UPDATE', count(*) FROM orders WHERE {_HIT}
    UNION ALL SELECT 'DELETE', count(*) FROM orders WHERE {_GONE}""")
def mutation_affected(spark, root):
    orders = _orders(spark, root)
    changes = [_insert(spark, root), _update(), _delete()]
    parts = [U.affected(orders, c).select(F.lit(c.kind).alias("kind"), "affected_rows") for c in changes]
    return reduce(DataFrame.unionByName, parts)


@query("mutation_preview", f"""
    SELECT 'UPDATE' AS kind, 'before' AS side, {_COLUMNS} FROM orders WHERE {_HIT}
    UNION ALL SELECT 'UPDATE', 'after', o_orderkey, o_custkey, 'U', {_HALF}, o_orderpriority FROM orders WHERE {_HIT}
    UNION ALL SELECT 'DELETE', 'before', {_COLUMNS} FROM orders WHERE {_GONE}
    UNION ALL SELECT 'INSERT', 'after', * FROM ({_NEW})""")
def mutation_preview(spark, root):
    orders = _orders(spark, root)
    changes = [_update(), _delete(), _insert(spark, root)]
    parts = [U.preview(orders, c).select(F.lit(c.kind).alias("kind"), "*") for c in changes]
    return reduce(DataFrame.unionByName, parts)


@query("mutation_require_where", """
    SELECT k AS kind, true AS refused, count(*) AS rows_kept FROM orders, (VALUES ('UPDATE'), ('DELETE')) t(k)
    GROUP BY 1
    UNION ALL SELECT 'DELETE WHERE true', false, 0""")
def mutation_require_where(spark, root):
    orders = _orders(spark, root)

    def outcome(label: str, kind: str, where) -> DataFrame:
        try:
            left, refused = U.transformed(orders, U.Mutation(kind, where)), False
        except ValueError:
            left, refused = orders, True
        kept = left.agg(F.count("*").alias("rows_kept"))
        return kept.select(F.lit(label).alias("kind"), F.lit(refused).alias("refused"), "rows_kept")

    parts = [
        outcome(U.UPDATE, U.UPDATE, None), outcome(U.DELETE, U.DELETE, None),
        outcome("DELETE WHERE true", U.DELETE, F.lit(True)),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("mutation_allowlist", I.with_sql("proposals", """
    SELECT proposal_token, string_agg(DISTINCT lower(t), ',') AS unauthorized
    FROM proposals, unnest(target_tables) u(t) WHERE lower(t) = 'supplier' GROUP BY 1"""))
def mutation_allowlist(spark, root):
    """Tables a mutation names anywhere that are outside the allowlist of every role."""
    denied = P.unlisted_tables(
        I.proposals(spark, root), I.OPEN_TABLES, "proposal_token", "target_tables"
    )
    return denied.select("proposal_token", F.concat_ws(",", "denied").alias("unauthorized"))


@query("proposal_ledger", I.with_sql("proposals", """
    SELECT statement_type, status, count(*) AS n, CAST(sum(n_targets) AS BIGINT) AS n_targets,
           CAST(sum(us // 1000000) AS BIGINT) AS s_sum, CAST(count(*) AS BIGINT) AS n_plans FROM (
        SELECT statement_type, 'AWAITING_OPERATOR_APPROVAL' AS status, us, len(target_tables) AS n_targets
        FROM proposals) GROUP BY 1, 2"""))
def proposal_ledger(spark, root):
    ledger = scratch_path(spark, "ledger")
    orders, tokens = _orders(spark, root), I.proposals(spark, root)
    named = tokens.select(
        "proposal_token", "us", "statement_type", F.array_sort(F.transform("target_tables", F.lower)).alias("target_tables")
    )
    for change in (_update(), _delete(), _insert(spark, root)):
        text = U.propose(orders, change, "", 0, ["orders"]).select("normalized_sql", "query_plan", "status").first()
        pending = named.filter(F.col("statement_type") == change.kind).select(
            "*", F.lit(text["normalized_sql"]).alias("normalized_sql"),
            F.array(*map(F.lit, text["query_plan"])).alias("query_plan"), F.lit(text["status"]).alias("status"),
        )
        U.record(pending, ledger)
    return spark.read.schema(pending.schema).parquet(ledger).groupBy("statement_type", "status").agg(
        F.count("*").alias("n"), F.sum(F.size("target_tables")).alias("n_targets"),
        F.sum(F.expr("us div 1000000")).alias("s_sum"),
        F.count_if(
            F.col("normalized_sql").startswith(F.col("statement_type")) & (F.size("query_plan") > 0)
        ).alias("n_plans"),
    )


# A moment with proposals old, young and yet to come.
_NOW_US = 915_148_800_000_000


@query("proposal_status", I.with_sql("proposals outcomes", f"""
    SELECT p.proposal_token, CASE WHEN o.proposal_token IS NOT NULL THEN 'APPLIED'
           WHEN {_NOW_US} - p.us > 300000000 THEN 'EXPIRED' ELSE 'PENDING' END AS state
    FROM proposals p LEFT JOIN (SELECT DISTINCT proposal_token FROM outcomes WHERE type = 'MUTATION_APPLIED') o
    ON p.proposal_token = o.proposal_token"""))
def proposal_status(spark, root):
    applied = I.outcomes(spark, root).filter("type = 'MUTATION_APPLIED'")
    return U.proposal_status(I.proposals(spark, root), applied, _NOW_US).select("proposal_token", "state")


@query("mutation_lifecycle", I.with_sql("proposals outcomes", """
    SELECT p.proposal_token, p.session_id, coalesce(o.type, 'OPEN') AS outcome,
           coalesce(o.us - p.us, -1) AS latency_us, coalesce(o.us - p.us > 300000000, false) AS ttl_breach,
           coalesce(o.session_id = p.session_id, false) AS same_session
    FROM proposals p LEFT JOIN outcomes o ON o.proposal_token = p.proposal_token"""))
def mutation_lifecycle(spark, root):
    return U.mutation_lifecycle(I.proposals(spark, root), I.outcomes(spark, root))


@query("mutation_apply", f"""
    WITH v2 AS ({_UPDATED}), v3 AS (SELECT * FROM v2 WHERE NOT {_GONE}), v4 AS (SELECT * FROM v3 UNION ALL {_NEW})
    SELECT 1 AS version, {_COLUMNS} FROM orders UNION ALL SELECT 2, * FROM v2
    UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4""")
def mutation_apply(spark, root):
    place = scratch_path(spark, "orders-versions")
    first = U.write_version(_orders(spark, root), place)
    numbers = [first, *(U.apply(spark, place, c) for c in (_update(), _delete(), _insert(spark, root)))]
    parts = [U.read_version(spark, place, n).select(F.lit(n).alias("version"), "*") for n in numbers]
    return reduce(DataFrame.unionByName, parts)
