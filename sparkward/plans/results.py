"""Queries on bounded results and table discovery."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.operators import bounded as B
from sparkward.operators import discover as D
from sparkward.operators import policy as P
from sparkward.plans import check_sql as C
from sparkward.plans import inputs as I
from sparkward.plans.registry import query

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"
_BY_PRICE = "ORDER BY o_totalprice DESC, o_orderkey"
# Limits as users ask for them, and what holds.
_ASKED = {"none": (None, 100), "zero": (0, 100), "below": (-5, 100), "above": (50_000, 100),
          "text": ("all", 100), "within": (50, 50)}


def _by_price():
    return [F.col("o_totalprice").desc(), F.col("o_orderkey")]


@query("limit_clamp", " UNION ALL ".join(
    f"(SELECT '{name}' AS asked, {_ORDERS} FROM orders {_BY_PRICE} LIMIT {holds})"
    for name, (_, holds) in _ASKED.items()))
def limit_clamp(spark, root):
    ranked = I.table(spark, root, "orders").orderBy(*_by_price())
    parts = [
        B.limit_clamp(ranked, asked).selectExpr(f"'{name}' AS asked", *_ORDERS.split(", "))
        for name, (asked, _) in _ASKED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("row_cap", f"""
    SELECT * FROM (SELECT {_ORDERS}, true AS truncated,
    'Result truncated: Reached maximum row limit (100).' AS truncation_reason FROM orders {_BY_PRICE} LIMIT 100)""")
def row_cap(spark, root):
    capped = B.row_cap(I.table(spark, root, "orders"), _by_price())
    return capped.select(*_ORDERS.split(", "), "truncated", "truncation_reason")


def _json(columns: str) -> str:
    return f"octet_length(encode(to_json({{{', '.join(f'{c}: {c}' for c in columns.split(', '))}}})))"


def _sized(most: int) -> str:
    return f"""
    WITH capped AS (SELECT {_ORDERS}, row_number() OVER (ORDER BY o_orderkey DESC) AS place
                    FROM orders QUALIFY place <= {most}),
    sized AS (SELECT {_ORDERS}, place, CAST(sum({_json(_ORDERS)}) OVER (ORDER BY place) AS BIGINT) AS running_bytes
              FROM capped)"""


@query("byte_budget", _sized(100) + f"""
    SELECT {_ORDERS}, running_bytes, true AS truncated,
           'Result truncated: Exceeded maximum payload size (4 KB).' AS truncation_reason
    FROM sized WHERE running_bytes <= 4096""")
def byte_budget(spark, root):
    orders = I.table(spark, root, "orders").select(*_ORDERS.split(", "))
    return B.byte_budget(orders, [F.col("o_orderkey").desc()], max_bytes=4096)


@query("result_metrics", _sized(101) + """
    SELECT 'rows' AS cap, count(*) AS row_count, max(running_bytes) AS payload_bytes, true AS truncated,
           'Result truncated: Reached maximum row limit (100).' AS truncation_reason
    FROM sized WHERE place <= 100
    UNION ALL
    SELECT 'bytes', count(*), max(running_bytes), true,
           'Result truncated: Exceeded maximum payload size (2 KB).' FROM sized WHERE running_bytes <= 2048""")
def result_metrics(spark, root):
    orders = I.table(spark, root, "orders").select(*_ORDERS.split(", "))
    order = [F.col("o_orderkey").desc()]
    by_rows = B.result_metrics(orders, order).select(F.lit("rows").alias("cap"), "*")
    by_bytes = B.result_metrics(orders, order, max_bytes=2048).select(F.lit("bytes").alias("cap"), "*")
    return by_rows.unionByName(by_bytes)


@query("sample_rows", I.with_sql("customer_pii", f"""
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, {C.mask('email', 'email')} AS email,
           {C.mask('phone', 'phone')} AS phone FROM customer_pii ORDER BY c_custkey LIMIT 3"""))
def sample_rows(spark, root):
    return B.sample_rows(I.customer_pii(spark, root), [F.col("c_custkey")])


@query("top_k", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""")
def top_k(spark, root):
    lines = I.table(spark, root, "lineitem")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"]
    best = B.top_k(lines, [F.col(c) if isinstance(c, str) else c for c in order], 25)
    return best.select("l_orderkey", "l_linenumber", "l_extendedprice")


# What a reader is told about each table.
DESCRIPTIONS = {
    "customer": "Customer profiles (PII masked: email, phone).",
    "orders": "Orders with customer, status, price, date.",
    "lineitem": "Order lines with part, quantity, price.",
    "nation": "Nations.",
    "region": "Regions.",
}


@query("list_tables", I.with_sql("policy", " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{DESCRIPTIONS.get(t, "")}' AS description,
        (SELECT count(DISTINCT role) FROM policy, unnest(tables_read) u(x) WHERE lower(x) = '{t}') AS n_readers,
        (SELECT count(*) FROM {t}) AS n_rows""" for t in I.OPEN_TABLES)))
def list_tables(spark, root):
    tables = {t: I.table(spark, root, t) for t in I.OPEN_TABLES}
    return D.list_tables(tables, DESCRIPTIONS, P.grants_table(I.policy(spark, root)))


@query("table_row_estimates", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in I.OPEN_TABLES))
def table_row_estimates(spark, root):
    return D.table_rows({t: I.table(spark, root, t) for t in I.OPEN_TABLES})


def _unique(columns: str) -> str:
    return f"count(*) = count({columns}) AND count(DISTINCT {columns}) = count(*)"


def _parts(table: str) -> list[tuple[str, str]]:
    """The pairs of columns that may be a composite key."""
    return list(combinations([c for c, kind in I.COLUMNS[table] if not kind.startswith(D._NO_PART)], 2))


_SINGLE = " UNION ALL ".join(
    f"SELECT '{t}' AS t, {i} AS i, '{c}' AS c, '{kind}' AS kind, count(*) AS n, count({c}) AS n_full, {_unique(c)} AS is_key FROM {t}"
    for t, cs in I.COLUMNS.items() for i, (c, kind) in enumerate(cs, 1))
_PAIRS = " UNION ALL ".join(
    f"SELECT '{t}' AS t, {i} AS i, '{a}' AS a, '{b}' AS b, count(*) AS n FROM {t} HAVING count(*) = count(CASE WHEN {a} IS NOT NULL THEN {b} END) "
    f"AND count(*) = count(DISTINCT ({a}, {b}))" for t in I.COLUMNS for i, (a, b) in enumerate(_parts(t)))
_KEYS_SQL = f"""WITH s AS ({_SINGLE}), p AS (SELECT * FROM ({_PAIRS}) WHERE (t, a) NOT IN (SELECT t, c FROM s WHERE is_key)
    AND (t, b) NOT IN (SELECT t, c FROM s WHERE is_key))"""


@query("describe_table", f"""{_KEYS_SQL}, first AS (SELECT t, arg_min([a, b], i) AS cs FROM p WHERE t NOT IN (SELECT t FROM s WHERE is_key) GROUP BY t)
    SELECT t AS table_name, i AS cid, c AS name, kind AS type, n = n_full AS notnull, '' AS default_value,
           is_key OR coalesce(list_contains(cs, c), false) AS is_primary_key FROM s LEFT JOIN first USING (t)""")
def describe_table(spark, root):
    return D.describe_tables({t: I.scan_table(spark, root, f" {t.upper()} ", I.OPEN_TABLES) for t in I.OPEN_TABLES})


@query("composite_keys", f"{_KEYS_SQL} SELECT t AS table_name, concat(a, ',', b) AS columns, n AS n_rows FROM p")
def composite_keys(spark, root):
    return D.composite_keys({t: I.table(spark, root, t) for t in I.OPEN_TABLES})


@query("key_profile", f"""SELECT t AS table_name, c AS column_name, n AS n_rows, n - n_full AS n_nulls, d AS n_distinct, is_key FROM ({" UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count({c}) AS n_full, count(DISTINCT {c}) AS d, {_unique(c)} AS is_key FROM {t}"
    for t, cs in I.COLUMNS.items() for c, _ in cs)})""")
def key_profile(spark, root):
    return D.key_profiles({t: I.table(spark, root, t) for t in I.OPEN_TABLES})


_NAMED = D.candidate_references(I.COLUMNS)


def _loose(columns, named) -> list[tuple[str, str]]:
    """Columns that are named like references but like no other table's column."""
    told = {(t, c) for t, c, _, _ in named}
    return [(t, c) for t, cs in columns.items() for c, _ in cs if c.endswith(("key", "id")) and (t, c) not in told]


def _orphans(a: str, b: str, c: str, d: str) -> str:
    return (f"SELECT '{a}' AS table_name, '{b}' AS column_name, '{c}' AS references_table, '{d}' AS references_column, "
            f"count(*) AS n_orphans, count(*) = 0 AS is_foreign_key FROM (SELECT {b} AS v FROM {a} WHERE {b} IS NOT NULL EXCEPT SELECT {d} FROM {c})")


_KIND = {(t, c): D._family(kind) for t, cs in I.COLUMNS.items() for c, kind in cs}
_BY_VALUE = " UNION ALL ".join(
    f"{_orphans(a, b, c, d)} WHERE (SELECT count({b}) FROM {a}) > 0 AND (SELECT {_unique(d)} FROM {c}) HAVING count(*) = 0 AND (SELECT {_unique(d)} FROM {c}) AND (SELECT count({b}) FROM {a}) > 0"
    for a, b in _loose(I.COLUMNS, _NAMED) if a not in I.RESTRICTED and _KIND[a, b]
    for c, cs in I.COLUMNS.items() if c != a and c not in I.RESTRICTED for d, _ in cs if _KIND[c, d] == _KIND[a, b])


@query("fk_profile", " UNION ALL ".join([*(_orphans(*x) for x in _NAMED if x[2] not in I.RESTRICTED and x[0] not in I.RESTRICTED), _BY_VALUE]))
def fk_profile(spark, root):
    """References that names suggest, whether they hold or not; of columns whose names suggest none, those that values allow."""
    tables = {t: I.table(spark, root, t) for t in I.OPEN_TABLES}
    columns = {t: [(f.name, f.dataType.simpleString()) for f in df.schema] for t, df in tables.items()}
    named = D.candidate_references(columns)
    _, keys = D.unique_sets(tables, most=1)
    by_value = D.value_references(tables, _loose(columns, named), [(t, k[0]) for t, k in keys if len(k) == 1])
    asked = D.fk_profile(tables, named, I.OPEN_TABLES)
    if not by_value:
        return asked
    return asked.unionByName(D.fk_profile(tables, by_value, I.OPEN_TABLES).filter("is_foreign_key"))
