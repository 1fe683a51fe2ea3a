"""Every registered query against the same SQL on DuckDB, over the whole smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

FNS, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(root):
    return oracle.connect(root)


@pytest.mark.parametrize("name", list(FNS))
def test_query(spark, duck, root, name):
    assert oracle.compare(spark, duck, name, FNS[name], SQLS.get(name), root) in ("", "agree but no rows")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 100
    assert [r["revenue"] for r in rows] == sorted((r["revenue"] for r in rows), reverse=True)
    assert all("***" in r["last_email"] for r in rows)


def test_every_query_of_the_library_has_a_check():
    assert {n for n in set(FNS) - set(SQLS) if n != "pipeline" and not n.startswith("op")} == set()
