"""The allowlisted scalar, aggregate and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkward.operators.ranking import neighbours, ranks
from sparkward.operators.running import Cut
from sparkward.plans import inputs as I
from sparkward.plans.registry import query
from sparkward.plans.relational import reader_query

# A column with gaps, for what functions make of NULL.
_GAP = "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END"


reader_query("fn_agg", f"""
    SELECT l_orderkey, count(*) AS n, count(g) AS n_g, sum(g) AS sum_g, min(l_quantity) AS min_q, max(l_quantity) AS max_q,
           avg(l_quantity) AS avg_q, sum(g) / nullif(count(g), 0) AS whole_avg,
           array_join(array_sort(array_agg(CAST(g AS STRING))), ',', 'NULL') AS collected,
           string_agg(l_returnflag, ',' ORDER BY l_returnflag DESC) AS flags
    FROM (SELECT *, {_GAP} AS g FROM lineitem) q GROUP BY l_orderkey""", f"""
    SELECT l_orderkey, count(*) AS n, count(g) AS n_g, CAST(sum(g) AS BIGINT) AS sum_g, min(l_quantity) AS min_q,
           max(l_quantity) AS max_q, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_q,
           CAST(sum(g) AS BIGINT) // nullif(count(g), 0) AS whole_avg,
           array_to_string(list_transform(list_sort(array_agg(CAST(g AS VARCHAR)), 'ASC', 'NULLS LAST'), lambda x: coalesce(x, 'NULL')), ',') AS collected,
           string_agg(l_returnflag, ',' ORDER BY l_returnflag DESC) AS flags
    FROM (SELECT *, {_GAP} AS g FROM lineitem) GROUP BY l_orderkey""")

reader_query("fn_bool_agg", """
    SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_big, bool_or(o_orderstatus = 'P') AS any_p,
           every(o_orderkey >= 0) AS every_key FROM orders GROUP BY o_custkey""", """
    SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_big, bool_or(o_orderstatus = 'P') AS any_p,
           bool_and(o_orderkey >= 0) AS every_key FROM orders GROUP BY o_custkey""")

reader_query("fn_case_trim", """
    SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, trim(concat('  ', p_name, ' ')) AS t,
           ltrim(concat('  ', p_name)) AS lt, rtrim(concat(p_name, '  ')) AS rt, CAST(length(p_name) AS INT) AS len,
           CAST(char_length(p_brand) AS INT) AS chars, initcap(replace(p_name, ' ', '-')) AS cap FROM part""", """
    SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, trim(concat('  ', p_name, ' ')) AS t,
           ltrim(concat('  ', p_name)) AS lt, rtrim(concat(p_name, '  ')) AS rt, CAST(length(p_name) AS INT) AS len,
           CAST(length(p_brand) AS INT) AS chars,
           array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), '-')
               AS cap FROM part""")


_JOINED = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(g, -1) AS filled,
           coalesce(nullif(l_returnflag, 'A'), 'was A') AS no_a, greatest(g, 2) AS most, least(g, 2) AS least,
           concat('x', CAST(g AS VARCHAR(9)), 'y') AS joined, coalesce('x' || CAST(g AS VARCHAR(9)), 'none') AS piped
    FROM (SELECT *, {_GAP} AS g FROM lineitem) q"""
reader_query("fn_concat_null", _JOINED.replace("VARCHAR(9)", "STRING"), _JOINED)

_CUT = """
    SELECT p_partkey, replace(p_name, 'e', '_') AS rep, substring(p_name, 0, 4) AS from0, substring(p_name, 2, 3) AS from2,
           substring(p_name FROM 3) AS from3, split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', -1) AS last,
           left(p_name, 3) AS l3, left(p_name, -3) AS lm3, right(p_name, 3) AS r3, right(p_name, -3) AS rm3,
           left(p_name, 4 - length(p_name)) AS front, CAST(position('r' IN p_name) AS INT) AS pos, CAST(strpos(p_name, 'i') AS INT) AS at_i
    FROM part ORDER BY right(p_name, -3), p_partkey"""
reader_query("fn_substr", _CUT)

reader_query("fn_pad", """
    SELECT n_nationkey, c_custkey, lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, rpad(n_name, 12, '.') AS dotted,
           repeat(left(n_name, 1), 3) AS thrice, reverse(n_name) AS backwards
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")


reader_query("fn_format", """
    SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS stamp, to_char(o_orderdate, 'DD/MM/YYYY') AS day,
           encode(o_orderpriority, 'base64') AS b64, encode(o_orderstatus, 'hex') AS hexed,
           to_char(o_orderkey, '0000000') AS zeros, to_char(o_totalprice, 'FM999,999,990.00') AS price,
           to_char(-o_orderkey, '9999999') AS minus FROM orders""", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(o_orderdate, '%d/%m/%Y') AS day,
           base64(encode(o_orderpriority)) AS b64, lower(hex(encode(o_orderstatus))) AS hexed,
           printf(' %07d', o_orderkey) AS zeros, format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2))) AS price,
           lpad(CASE WHEN o_orderkey > 0 THEN printf('%d', -o_orderkey) ELSE '0' END, 8, ' ') AS minus FROM orders""")


_V = "(CAST(c_custkey AS DOUBLE) - 500) / 4"


reader_query("fn_math", f"""
    SELECT c_custkey, round(CAST(v AS DECIMAL(12,2)), 1) AS r1, round(v * 2) AS even, ceil(v) AS up, floor(v) AS down, abs(v) AS mag,
           mod(c_custkey, 7) AS m7, power(v, 2) AS sq, round(sqrt(abs(v)), 6) AS root, sign(v) AS sgn, trunc(v) + 0 AS cut,
           CAST(trunc(v * 1.01, 1) AS DOUBLE) AS cut1, round(log(abs(v) + 1), 6) AS lg, round(ln(abs(v) + 1), 6) AS nat, round(exp(v / 1000), 6) AS ex,
           round(log(2, abs(v) + 1), 6) AS lg2, c_custkey / 7 AS whole, c_custkey / 7 / 3 AS less
    FROM (SELECT c_custkey, {_V} AS v FROM (SELECT c_custkey FROM customer) c) q""", f"""
    SELECT c_custkey, round(CAST(v AS DECIMAL(12,2)), 1) AS r1, round_even(v * 2, 0) AS even, CAST(ceil(v) AS BIGINT) AS up, CAST(floor(v) AS BIGINT) AS down, abs(v) AS mag,
           c_custkey % 7 AS m7, power(v, 2) AS sq, round(sqrt(abs(v)), 6) AS root, CAST(sign(v) AS DOUBLE) AS sgn, trunc(v) + 0 AS cut,
           CAST(trunc(CAST(v * 1.01 AS DECIMAL(38,12)) * 10) / 10 AS DOUBLE) AS cut1, round(log10(abs(v) + 1), 6) AS lg, round(ln(abs(v) + 1), 6) AS nat, round(exp(v / 1000), 6) AS ex,
           round(log(2, abs(v) + 1), 6) AS lg2, c_custkey // 7 AS whole, c_custkey // 7 // 3 AS less
    FROM (SELECT c_custkey, {_V} AS v FROM (SELECT c_custkey FROM customer) c)""")


@query("fn_now", """
    SELECT event_type, count(*) AS before_now, count(*) AS before_today, count(*) AS before_moment, count(*) AS with_time
    FROM events GROUP BY event_type""")
def fn_now(spark, root):
    """Every event lies in the past, whenever this runs."""
    return I.table(spark, root, "events").groupBy("event_type").agg(
        F.count_if(F.col("ts").cast("timestamp") < F.now()).alias("before_now"),
        F.count_if(F.col("ts").cast("date") < F.current_date()).alias("before_today"),
        F.count_if(F.col("ts").cast("timestamp") < F.current_timestamp()).alias("before_moment"),
        F.count_if(F.current_time().isNotNull()).alias("with_time"),
    )


_MONTHS_BACK = "CASE WHEN extract(day FROM ts) < 29 THEN 1 ELSE 0 END"
reader_query("fn_date", """
    SELECT event_id, date_part('year', ts) AS y, extract(month FROM ts) AS m, extract(day FROM ts) AS d, date_part('dow', ts) AS dow,
           extract(isodow FROM ts) AS isodow, extract(epoch FROM ts) AS epoch, to_char(date_trunc('hour', ts), 'YYYY-MM-DD HH24:MI:SS') AS hour,
           extract(year FROM age(CAST(ts AS DATE), DATE '2020-02-29')) AS age_years,
           extract(month FROM age(CAST(ts AS DATE), DATE '2020-02-29')) AS age_months,
           extract(day FROM age(CAST(ts AS DATE), DATE '2020-02-29')) AS age_days FROM events""", f"""
    SELECT *, months // 12 AS age_years, months % 12 AS age_months FROM (
    SELECT event_id, CAST(date_part('year', ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS m,
           CAST(extract(day FROM ts) AS INT) AS d, CAST(date_part('dow', ts) AS INT) AS dow, CAST(extract(isodow FROM ts) AS INT) AS isodow,
           epoch_us(ts) / 1000000 AS epoch, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour,
           date_diff('month', DATE '2020-02-29', CAST(ts AS DATE)) - {_MONTHS_BACK} AS months,
           CAST(extract(day FROM ts) - 29 + 29 * {_MONTHS_BACK} AS INT) AS age_days FROM events)""".replace("SELECT *,", "SELECT * EXCLUDE (months),", 1))

reader_query("fn_make_date", """
    SELECT event_id, to_char(make_date(2024, 1 + CAST(event_id % 12 AS INT), 15), 'YYYY-MM-DD') AS made,
           to_char(to_date(to_char(ts, 'DD/MM/YYYY'), 'DD/MM/YYYY'), 'YYYY-MM-DD') AS parsed,
           CAST(extract(epoch FROM to_timestamp(CAST(extract(epoch FROM ts) AS DOUBLE))) AS BIGINT) AS from_epoch,
           to_char(to_timestamp(to_char(ts, 'YYYY-MM-DD HH24'), 'YYYY-MM-DD HH24'), 'YYYY-MM-DD HH24:MI:SS') AS from_text,
           to_char(ts + make_interval(days => 1, hours => 12), 'YYYY-MM-DD HH24:MI:SS') AS later FROM events""", """
    SELECT event_id, strftime(make_date(2024, 1 + CAST(event_id % 12 AS INT), 15), '%Y-%m-%d') AS made,
           strftime(ts, '%Y-%m-%d') AS parsed, epoch_us(ts) // 1000000 AS from_epoch,
           strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS from_text,
           strftime(ts + to_hours(36), '%Y-%m-%d %H:%M:%S') AS later FROM events""")


reader_query("fn_cast", """
    SELECT o_orderkey, CAST(o_totalprice AS INT) AS whole, CAST(o_orderkey AS STRING) AS txt,
           CAST(concat(CAST(o_orderkey AS STRING), '.5') AS DOUBLE) AS num, CAST(o_orderstatus = 'F' AS INT) AS flag,
           CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS DOUBLE) AS tenths,
           coalesce(try_cast(o_orderpriority AS INT), -1) AS bad FROM orders""", """
    SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS whole, CAST(o_orderkey AS STRING) AS txt,
           CAST(concat(CAST(o_orderkey AS STRING), '.5') AS DOUBLE) AS num, CAST(o_orderstatus = 'F' AS INT) AS flag,
           CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS DOUBLE) AS tenths,
           coalesce(try_cast(o_orderpriority AS INT), -1) AS bad FROM orders""")


reader_query("fn_json", """
    SELECT event_id, json_extract_path_text(props, 'k') AS k,
           jsonb_extract_path_text(concat('{"a":{"b c":["', event_type, '",1]}}'), 'a', 'b c', '0') AS deep,
           jsonb_array_length(concat('[', event_id, ',', user_id, ']')) AS n, json_array_length('[]') AS none FROM events""", """
    SELECT event_id, props ->> '$.k' AS k, concat('{"a":{"b c":["', event_type, '",1]}}') ->> '$.a."b c"[0]' AS deep,
           CAST(json_array_length(concat('[', event_id, ',', user_id, ']')) AS INT) AS n, 0 AS none FROM events""")


_PLACE = "l_quantity, l_partkey, l_suppkey, l_linenumber, l_extendedprice"
reader_query("fn_rank", f"""
    SELECT l_orderkey, {_PLACE},
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) AS INT) AS rn,
           CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS INT) AS rk,
           CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS INT) AS drk,
           CAST(ntile(2) OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) AS INT) AS half,
           percent_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS pct,
           cume_dist() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS cume FROM lineitem""")

reader_query("fn_offset", f"""
    SELECT l_orderkey, {_PLACE},
           lag(l_partkey, 1, -1) OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) AS before,
           lead(l_partkey, 1, -1) OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) AS after,
           first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}) AS first,
           last_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
           coalesce(nth_value(l_partkey, 2) OVER (PARTITION BY l_orderkey ORDER BY {_PLACE}
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1) AS second FROM lineitem""")


# The same functions over five keys that each hold a fifth of the rows.
_BY_TYPE = "PARTITION BY event_type ORDER BY us"


@query("fn_rank_skewed", I.with_sql("ev", f"""
    SELECT event_id, event_type, row_number() OVER ({_BY_TYPE}, event_id) AS row_number,
           rank() OVER ({_BY_TYPE}) AS rank, dense_rank() OVER ({_BY_TYPE}) AS dense_rank,
           percent_rank() OVER ({_BY_TYPE}) AS percent_rank, cume_dist() OVER ({_BY_TYPE}) AS cume_dist,
           ntile(4) OVER ({_BY_TYPE}, event_id) AS ntile
    FROM (SELECT * REPLACE (us // 60000000 AS us) FROM ev)"""))
def fn_rank_skewed(spark, root):
    events = I.events(spark, root).select("event_id", "event_type", F.expr("us div 60000000").alias("us"))
    return ranks(events, ["event_type"], "us", ["event_id"], Cut(5)).drop("us")


@query("fn_offset_skewed", I.with_sql("ev", f"""
    SELECT event_id, event_type, coalesce(lag(event_id) OVER ({_BY_TYPE}, event_id), -1) AS lag,
           coalesce(lead(event_id) OVER ({_BY_TYPE}, event_id), -1) AS lead,
           first_value(event_id) OVER ({_BY_TYPE}, event_id) AS first_value,
           last_value(event_id) OVER ({_BY_TYPE}, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value
    FROM (SELECT * REPLACE (us // 60000000 AS us) FROM ev)"""))
def fn_offset_skewed(spark, root):
    events = I.events(spark, root).select("event_id", "event_type", F.expr("us div 60000000").alias("us"))
    near = neighbours(events, ["event_type"], "us", ["event_id"], "event_id", Cut(5))
    absent = F.lit(-1)
    return near.drop("us").withColumns({"lag": F.coalesce("lag", absent), "lead": F.coalesce("lead", absent)})


reader_query("fn_typeof", """
    SELECT pg_typeof(o_orderkey) AS key_type, pg_typeof(o_totalprice) AS price_type, pg_typeof(o_orderstatus) AS status_type,
           pg_typeof(o_orderdate) AS date_type, pg_typeof(o_orderkey / 2) AS half_type, count(*) AS n
    FROM orders GROUP BY ALL""", """
    SELECT 'bigint' AS key_type, 'double precision' AS price_type, 'text' AS status_type, 'timestamp without time zone' AS date_type,
           'bigint' AS half_type, count(*) AS n FROM orders""")


reader_query("fn_setret", """
    SELECT conv_id, n, word, back FROM (
        SELECT conv_id, turn, generate_series(0, turn) AS n, role FROM conversations) s, LATERAL unnest(split(role, 's')) w(word),
        LATERAL generate_series(turn, n, -2) AS g(back)""", """
    SELECT conv_id, n, word, unnest(generate_series(turn, n, CAST(-2 AS BIGINT))) AS back FROM (
        SELECT conv_id, turn, unnest(generate_series(CAST(0 AS BIGINT), turn)) AS n, role FROM conversations) s,
    unnest(string_split(role, 's')) w(word)""")
