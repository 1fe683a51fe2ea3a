"""The query shapes open to a governed reader, as SQL over the reader's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkward.operators.ranges import range_join
from sparkward.plans import check_sql as C
from sparkward.plans import inputs as I
from sparkward.plans.access import role_session
from sparkward.plans.registry import query

# What `customer` stands for in a reader's SQL.
_CUSTOMER = I.with_sql("customer_pii", "").rstrip() + f", customer_view AS ({C.CUSTOMER_VIEW})"


def reader_query(name: str, text: str, check: str | None = None) -> None:
    """Register a reader's SQL text; the check runs the same text, or its twin.

    On the checking side `customer` is spelled out as the masked view.
    """
    other = check or text
    if "customer" in other and check is None:
        other = f"{_CUSTOMER} SELECT * FROM ({other.replace('FROM customer', 'FROM customer_view').replace('JOIN customer', 'JOIN customer_view')})"

    @query(name, other)
    def run(spark, root):
        return role_session(spark, root).sql(text)

    run.__module__ = __name__


reader_query("q_project", """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
           CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END AS lot,
           concat(l_returnflag, '-', l_linestatus) AS flags FROM lineitem""")

reader_query("q_filter", """
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
    WHERE o_totalprice BETWEEN 50000 AND 250000 AND o_orderstatus IN ('F', 'P')
      AND NOT (o_orderpriority LIKE '5-%') AND o_custkey IS NOT NULL
      AND (o_orderkey < 9000 OR o_orderpriority = '1-URGENT')""")

reader_query("q_join_inner", """
    SELECT n_name, r_name, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY n_name, r_name""")

reader_query("q_join_outer", """
    SELECT 'left' AS kind, c_mktsegment AS grp, count(o_orderkey) AS n_orders, count(*) AS n_rows
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'
    GROUP BY c_mktsegment
    UNION ALL
    SELECT 'right', o_orderstatus, count(o_orderkey), count(*)
    FROM (SELECT doc_id FROM labels WHERE toxic = 1) t RIGHT JOIN orders ON doc_id = o_orderkey
    GROUP BY o_orderstatus
    UNION ALL
    SELECT 'full', coalesce(lang, 'none'), count(l.doc_id), count(*)
    FROM documents d FULL JOIN (SELECT doc_id + 100 AS doc_id FROM labels) l ON d.doc_id = l.doc_id
    GROUP BY coalesce(lang, 'none')""")

# The joined side is an aggregate without keys: one row.
reader_query("q_join_cross", """
    SELECT o_orderkey, o_totalprice / t.top AS share_of_top, o_totalprice > t.floor_price AS above
    FROM orders CROSS JOIN (SELECT max(o_totalprice) AS top, min(o_totalprice) * 2 AS floor_price FROM orders) t""")


_SURGE = """surges AS (SELECT min(us) AS low, min(us) + 7200000000 AS high, us // 86400000000 AS day
             FROM ev WHERE event_type = 'error' GROUP BY us // 86400000000)"""


@query("q_join_theta", I.with_sql("ev", "").rstrip() + f""", {_SURGE}
    SELECT event_id, day, us - low AS after_us FROM ev JOIN surges ON us >= low AND us < high""")
def q_join_theta(spark, root):
    """Events within two hours of the first error of a day: a range join."""
    events = I.events(spark, root)
    day = F.expr("us div 86400000000").alias("day")
    surges = events.filter("event_type = 'error'").groupBy(day).agg(F.min("us").alias("low"))
    surges = surges.withColumn("high", F.col("low") + 7_200_000_000)
    found = range_join(events.select("event_id", "us"), surges, "us", "low", "high", 7_200_000_000)
    return found.select("event_id", "day", (F.col("us") - F.col("low")).alias("after_us"))


reader_query("q_semi_anti", """
    SELECT 'exists' AS kind, c_custkey FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
    UNION ALL
    SELECT 'not exists', c_custkey FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL
    SELECT 'in', c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')""")

reader_query("q_derived", """
    SELECT bucket, count(*) AS n, max(total) AS largest
    FROM (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
                 count(*) AS bucket FROM lineitem GROUP BY l_orderkey) t GROUP BY bucket""")

reader_query("q_scalar_subquery", """
    SELECT o.o_orderkey, o.o_totalprice FROM orders o
    WHERE o.o_totalprice > (SELECT max(i.o_totalprice) * 0.9 FROM orders i WHERE i.o_custkey = o.o_custkey
                            AND i.o_orderstatus = 'F')
      AND o.o_totalprice > (SELECT min(o_totalprice) + 1000 FROM orders)""")

reader_query("q_cte", """
    WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey),
         ranked AS (SELECT n, count(*) AS n_customers FROM big GROUP BY n)
    SELECT b.n, r.n_customers, min(b.o_custkey) AS first_customer
    FROM big b JOIN ranked r ON b.n = r.n GROUP BY b.n, r.n_customers""")

reader_query("q_group_by", """
    SELECT l_returnflag, l_linestatus, count(*) AS n,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS base_price,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS avg_cents,
           max(l_discount) AS max_discount
    FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")

reader_query("q_distinct", """
    SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers,
           count(DISTINCT o_orderpriority) AS n_priorities, count(*) AS n
    FROM (SELECT DISTINCT o_orderstatus, o_custkey, o_orderpriority FROM orders) t GROUP BY o_orderstatus""")

reader_query("q_grouping_sets", """
    SELECT 'sets' AS kind, coalesce(o_orderstatus, 'all') AS a, coalesce(o_orderpriority, 'all') AS b, count(*) AS n
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())
    UNION ALL
    SELECT 'rollup', coalesce(o_orderstatus, 'all'), coalesce(o_orderpriority, 'all'), count(*)
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
    UNION ALL
    SELECT 'cube', coalesce(o_orderstatus, 'all'), coalesce(o_orderpriority, 'all'), count(*)
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")

# Frames over the lines of one order, of which there are few.
reader_query("q_window", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
                          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rows_frame,
           max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber
                                 RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS range_frame,
           CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT)
               AS running_quantity
    FROM lineitem""")

reader_query("q_order_limit", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 20""")

reader_query("q_set_ops", """
    SELECT 'union' AS op, count(*) AS n, min(k) AS least FROM
        (SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events) a
    UNION ALL SELECT 'union all', count(*), min(k) FROM
        (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events) a
    UNION ALL SELECT 'intersect', count(*), min(k) FROM
        (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events) a
    UNION ALL SELECT 'except', count(*), min(k) FROM
        (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) a
    UNION ALL SELECT 'except all', count(*), min(k) FROM
        (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) a""")

reader_query("q_unnest", """
    SELECT doc_id, count(*) AS n_sentences, CAST(max(length(part)) AS INT) AS longest
    FROM documents LATERAL VIEW explode(split(text, '[.]')) s AS part GROUP BY doc_id""", """
    SELECT doc_id, count(*) AS n_sentences, CAST(max(length(part)) AS INT) AS longest
    FROM documents, unnest(string_split(text, '.')) s(part) GROUP BY doc_id""")

reader_query("q_series", """
    SELECT l_shipmode, count(*) AS n FROM (
        SELECT explode(sequence(1, CAST(l_quantity AS INT), 5)) AS l_shipmode FROM lineitem) s
    GROUP BY l_shipmode""", """
    SELECT l_shipmode, count(*) AS n FROM (
        SELECT CAST(unnest(generate_series(1, CAST(l_quantity AS INT), 5)) AS INT) AS l_shipmode FROM lineitem) s
    GROUP BY l_shipmode""")
