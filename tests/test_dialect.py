"""Governed SQL gives the functions of the allowlist the meaning Postgres gives them."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from sparkward.plans.dialect import as_spark
from sparkward.plans.views import Refused, governed_query, governed_session


def rows_of(session):
    return session.sql(
        """SELECT * FROM VALUES (1, 'abcdef', 2.5D, TIMESTAMP_NTZ '2024-01-07 10:30:15.25', 'A', 10), (2, 'Foo-bar baz', 3.5D, TIMESTAMP_NTZ '2020-02-29 00:00:00', NULL, 7),
           (3, '', -2.5D, NULL, 'B', -7) AS t(id, s, x, ts, gap, n)"""
    )


@pytest.fixture(scope="module")
def reader(spark):
    return governed_session(spark, {"t": rows_of}, ["t"])


def one(reader, expression, tail=""):
    rows = governed_query(reader, f"SELECT {expression} AS v {tail}").collect()
    assert len(rows) == 1
    return rows[0]["v"]


VALUES = [
    ("left('abcdef', -2)", "abcd"), ("left('ab', -5)", ""), ("left('abc', 2)", "ab"), ("left('abc', 1 + 1)", "ab"), ("LEFT('abcdef', - 2)", "abcd"),
    ("right('abcdef', -2)", "cdef"), ("right('abc', 2)", "bc"), ("right('ab', -5)", ""), ("right(left('abcdef', -1), -1)", "bcde"),
    ("concat('x', NULL)", "x"), ("concat('a', 1, NULL, 'b')", "a1b"), ("'x' || NULL", None),
    ("substring('abcdef', 0, 3)", "ab"), ("substring('abcdef' FROM 0 FOR 3)", "ab"), ("substring('abcdef' from 3)", "cdef"), ("substr('abcdef', -1)", "abcdef"),
    ("substring('abc', 2, NULL)", None), ("substring('abcdef' FROM (2) FOR (1 + 1))", "bc"), ("strpos('abc', 'c')", 3), ("position('c' IN 'abc')", 3),
    ("initcap('foo-bar BAZ 1st')", "Foo-Bar Baz 1st"),
    ("7/2", 3), ("-7/2", -3), ("7/2/2", 1), ("7/2*2", 6), ("7.0/2", Decimal("3.5")), ("CAST(7 AS DOUBLE)/2", 3.5), ("(7) / (2)", 3), ("7 /* a / b */ / 2", 3),
    ("(1 + 6)/(3 - 1)", 3), ("2 * 7 / CASE WHEN 8/4 = 2 THEN 4 END", 3), ("count(*)/2", 1, "FROM t"), ("sum(n)/4", 2, "FROM t"), ("max(7/2)", 3, "FROM t"), ("(SELECT max(n/4) FROM t)", 2),
    ("log(100)", 2.0), ("log(2, 8)", 3.0), ("ln(1)", 0.0), ("round(2.5D)", 2.0), ("round(3.5D)", 4.0), ("round(2.5)", Decimal("3")), ("round(-2.5D)", -2.0),
    ("sqrt(4)", 2.0), ("sqrt(NULL)", None), ("ln(NULL)", None),
    ("trunc(2.567, 1)", Decimal("2.5")), ("trunc(-2.567, 1)", Decimal("-2.5")), ("trunc(-2.5D)", -2.0), ("trunc(1234.5, -2)", Decimal("1200")), ("trunc(2.3D, 2)", Decimal("2.3")),
    ("date_part('dow', DATE '2024-01-07')", 0), ("extract(dow FROM DATE '2024-01-06')", 6), ("extract(isodow from DATE '2024-01-07')", 7),
    ("date_part('epoch', TIMESTAMP_NTZ '1970-01-01 00:00:01.5')", 1.5), ("extract(year FROM DATE '2024-01-07')", 2024), ("extract(century FROM DATE '2000-01-01')", 20),
    ("extract(decade FROM DATE '1999-01-01')", 199), ("extract(milliseconds FROM TIMESTAMP '2024-01-01 00:00:01.5')", Decimal("1500")),
    ("to_char(DATE '2024-03-05', 'YYYY-MM')", "2024-03"), ("to_char(TIMESTAMP_NTZ '2024-03-05 14:05:06', 'HH24:MI:SS')", "14:05:06"),
    ("to_char(1234.5, '9,999.99')", " 1,234.50"), ("to_char(-1234.5, '9,999.99')", "-1,234.50"), ("to_char(-12, '9999')", "  -12"), ("to_char(0, '999')", "   0"),
    ("to_char(0.5, '99.99')", "   .50"), ("to_char(0.5, '0.99')", " 0.50"), ("to_char(12, '0000')", " 0012"), ("to_char(1234.5, 'FM9,999.99')", "1,234.5"),
    ("to_char(1.5, 'FM9.00')", "1.50"), ("to_char(12.345D, '99.99')", " 12.35"), ("to_char(-7, 'FM000')", "-007"),
    ("encode('x', 'hex')", "78"), ("encode(CAST('hi' AS BINARY), 'base64')", "aGk="),
    ("to_date('05/03/2024', 'DD/MM/YYYY')", date(2024, 3, 5)), ("to_timestamp('2024-03-05 14', 'YYYY-MM-DD HH24')", datetime(2024, 3, 5, 14)),
    ("to_timestamp(1.5)", datetime(1970, 1, 1, 0, 0, 1, 500000)), ("make_date(2024, 2, 29)", date(2024, 2, 29)),
    ("age(DATE '2024-03-01', DATE '2020-02-29')", "4 years 1 day"), ("age(DATE '2020-02-29', DATE '2024-03-01')", "-4 years -1 days"),
    ("age(TIMESTAMP '2001-04-10', TIMESTAMP '1957-06-13')", "43 years 9 mons 27 days"), ("age(TIMESTAMP '2024-01-01 01:02:03.5', TIMESTAMP '2024-01-01')", "01:02:03.5"),
    ("age(DATE '2024-01-01', DATE '2024-01-01')", "00:00:00"), ("age(DATE '2024-01-01', NULL)", None), ("extract(year FROM age(DATE '2024-03-01', DATE '2020-02-29'))", 4),
    ("TIMESTAMP_NTZ '2024-01-01' + make_interval(days => 10, hours => 2)", datetime(2024, 1, 11, 2)), ("make_interval(1, 2, 1)", "1 year 2 mons 7 days"),
    ("make_interval(secs => 3.25)", "00:00:03.25"), ("age(current_date()) IS NULL", False),
    ("json_extract_path_text('{\"a\":{\"b c\":[5,6]}}', 'a', 'b c', '1')", "6"), ("jsonb_extract_path_text('{\"a\":null}', 'a')", None),
    ("jsonb_array_length('[1,2,3]')", 3), ("json_array_length('[]')", 0),
    ("pg_typeof(1)", "integer"), ("pg_typeof(2.5)", "numeric"), ("pg_typeof(2.5D)", "double precision"), ("pg_typeof('a')", "text"), ("pg_typeof(array(1))", "integer[]"),
    ("pg_typeof(now())", "timestamp with time zone"), ("pg_typeof(true)", "boolean"), ("pg_typeof(DATE '2024-01-01')", "date"),
    ("string_agg(s, ',' ORDER BY id DESC)", ",Foo-bar baz,abcdef", "FROM t"), ("string_agg(left(s, -3), '/' ORDER BY left(s, -1))", "/Foo-bar /abc", "FROM t WHERE id < 4"),
    ("array_agg(gap)", ["A", "B", None], "FROM t"), ("array_agg(gap) FILTER (WHERE id > 1)", ["B", None], "FROM t"), ("array_agg(DISTINCT gap)", ["A", "B", None], "FROM t"),
    ("mod(-7, 3)", -1), ("split_part('a,b', ',', -1)", "b"), ("greatest(NULL, 1)", 1), ("left('it''s', -1)", "it'"), ("'left(a, -1)'", "left(a, -1)"),
]


@pytest.mark.parametrize("case", VALUES, ids=lambda c: c[0])
def test_value(reader, case):
    expression, want, *tail = case
    got = one(reader, expression, *tail)
    if isinstance(want, list):
        got, want = sorted(got, key=str), sorted(want, key=str)
    assert got == want and isinstance(got, bool) == isinstance(want, bool)


ERRORS = ["sqrt(-1)", "ln(0)", "log(-1)", "log(2, 0)", "1/0", "substring('abc', 1, -1)"]


@pytest.mark.parametrize("expression", ERRORS)
def test_error_when_run(reader, expression):
    with pytest.raises(Exception, match="square root|logarithm|zero|negative"):
        one(reader, expression)


REFUSED = ["to_char(ts, s) FROM t", "to_char(1, '9PR')", "to_char(ts, 'J') FROM t", "encode('x', 'rot13')", "json_extract_path_text(s, gap) FROM t", "make_interval(moons => 1)",
           "generate_series(1)", "left('a')", "age()", "array_agg(s, 1) FROM t"]


@pytest.mark.parametrize("expression", REFUSED)
def test_refused(reader, expression):
    with pytest.raises(Refused):
        governed_query(reader, f"SELECT {expression}")


def column(reader, text):
    return [r[0] for r in governed_query(reader, text).collect()]


def test_series(reader):
    assert column(reader, "SELECT generate_series(1, 3)") == [1, 2, 3]
    assert column(reader, "SELECT generate_series(3, 1)") == []
    assert column(reader, "SELECT generate_series(3, 1, -1) AS n ORDER BY n") == [1, 2, 3]
    assert column(reader, "SELECT n FROM generate_series(1, 10, 4) AS g(n)") == [1, 5, 9]
    assert column(reader, "SELECT * FROM generate_series(DATE '2024-01-01', DATE '2024-01-02', INTERVAL '1 day') g") == [date(2024, 1, 1), date(2024, 1, 2)]
    assert column(reader, "SELECT * FROM generate_series(DATE '2024-01-02', DATE '2024-01-01', INTERVAL '1' DAY) g") == []
    assert sorted(column(reader, "SELECT id * 10 + m FROM t, LATERAL generate_series(1, id) AS g(m)")) == [11, 21, 22, 31, 32, 33]
    assert sorted(column(reader, "SELECT w FROM t, LATERAL unnest(split(s, '-')) AS u(w)")) == ["", "Foo", "abcdef", "bar baz"]
    with pytest.raises(Exception, match="zero"):
        column(reader, "SELECT generate_series(1, 3, id - 1) FROM t WHERE id = 1")


def test_everywhere_in_a_query(reader):
    text = """WITH c AS (SELECT id, left(s, -1) AS l, n/2 AS half FROM t) -- left(s, -9)
        SELECT l, half, row_number() OVER (PARTITION BY left(l, -2) ORDER BY half/2, l) AS r,
               (SELECT max(left(s, -4)) FROM t) AS deep, transform(array(l), y -> left(y, -1))[0] AS inner_call
        FROM c WHERE left(l, -1) <> '?' AND EXISTS (SELECT 1 FROM t u WHERE left(u.s, -1) = c.l)
        ORDER BY left(l, -3) DESC, half LIMIT 2"""
    rows = governed_query(reader, text).collect()
    assert [(r["l"], r["half"], r["deep"], r["inner_call"]) for r in rows] == [("abcde", 5, "ab", "abcd"), ("Foo-bar ba", 3, "ab", "Foo-bar b")]
    grouped = governed_query(reader, "SELECT left(s, -5) AS k, count(*) AS c FROM t GROUP BY left(s, -5) HAVING max(n/2) > 0 ORDER BY 1").collect()
    assert [tuple(r) for r in grouped] == [("Foo-ba", 1), ("a", 1)]


def test_unnamed_columns_keep_their_text(reader):
    assert governed_query(reader, "SELECT left(s,  -2), upper(s), 1 + trunc(x) FROM t").columns == ["left(s, -2)", "upper(s)", "1 + trunc(x)"]
    assert governed_query(reader, "SELECT `left(s, -2)` FROM (SELECT left(s, -2) FROM t) q").columns == ["left(s, -2)"]
    assert governed_query(reader, "SELECT (left(s, -2)) FROM t").count() == 3


def test_other_text_stays(reader):
    for text in ("SELECT upper(s) FROM t", "SELECT 'generate_series(1, 2)', \"left(a, -1)\" /* log(1) */", "SELECT s AS left FROM t", "SELECT (SELECT min(id) FROM t)"):
        assert as_spark(reader.session, text) == text


def test_calls_within_calls_are_bounded(reader):
    deep = "s"
    for _ in range(40):
        deep = f"left({deep}, n - 1)"
    with pytest.raises(Refused, match="within each other"):
        governed_query(reader, f"SELECT {deep} FROM t")


def test_still_governed(reader):
    for text in ("SELECT left(s, -1) FROM hidden", "SELECT left(input_file_name(), -1) FROM t", "SELECT left('a', -1); DROP TABLE t", "SELECT reflect('java.lang.Math', 'abs', 7/2)"):
        with pytest.raises(Refused):
            governed_query(reader, text)


def test_one_plan_without_python(reader):
    plan = governed_query(reader, "SELECT left(s, -2) AS a, n/2 AS b, substring(s, 0, 3) AS c, concat(gap, s) AS d, trunc(x) AS e FROM t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Generate" not in plan
