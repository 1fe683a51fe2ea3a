"""Composite keys and references found by value, against counts by hand."""

import pytest

from sparkward.operators import discover as D


@pytest.fixture(scope="module")
def tables(spark):
    lines = [(o, n, o * 10 % 7, f"t{o}{n}" if o % 2 else None, float(o * 100 + n)) for o in range(300) for n in range(4)]
    heads = [(o, n, o + n) for o in range(300) for n in range(4)]
    return {
        "lines": spark.createDataFrame(lines, "o int, n int, part int, note string, price double"),
        "heads": spark.createDataFrame(heads, "head_o bigint, head_n int, total int"),
        "parts": spark.createDataFrame([(i, [i], f"p{i}") for i in range(50)], "partkey bigint, xs array<int>, name string"),
        "empty": spark.createDataFrame([], "a int, b string"),
    }


def test_composite_keys(tables):
    got = {(r["table_name"], r["columns"]): r["n_rows"] for r in D.composite_keys(tables).collect()}
    # Any two of the three columns of `heads` tell the third.
    assert got == {("lines", "o,n"): 1200, ("heads", "head_o,head_n"): 1200, ("heads", "head_o,total"): 1200, ("heads", "head_n,total"): 1200}
    flags = {(r["table_name"], r["name"]): (r["is_primary_key"], r["notnull"]) for r in D.describe_tables(tables).collect()}
    assert [flags["lines", c] for c in ("o", "n", "part", "note", "price")] == [(False, True)] * 3 + [(False, False), (True, True)]
    assert flags["heads", "head_o"][0] and flags["heads", "head_n"][0] and not flags["heads", "total"][0]
    assert flags["parts", "partkey"] == (True, True) and flags["parts", "xs"] == (True, True)
    assert flags["empty", "a"][1] and len(flags) == 5 + 3 + 3 + 2


def test_no_key_at_all(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    assert D.composite_keys({"t": twice}).count() == 0
    assert not any(r["is_primary_key"] for r in D.describe_table(twice, "t").collect())


def test_what_a_slice_of_the_values_shows_to_repeat_is_not_shuffled_whole(spark, monkeypatch):
    """`b` repeats often, `c` and (d, e) once in the whole table, (d, f) never."""
    n = 4000
    rows = [(i, i % 3600, max(i, 1), i // 2, i % 2 if i > 1 else 0, i % 2) for i in range(n)]
    tables = {"t": spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int").select("b", "c", "d", "e", "f")}
    asked = []
    exact = D._exact
    monkeypatch.setattr(D, "_exact", lambda tables, sets, *share: asked.append((share, dict(sets))) or exact(tables, sets, *share))

    def found():
        asked.clear()
        facts, keys = D.unique_sets(tables)
        return {k: facts[k][0] for k in keys}, [k for share, sets in asked if share in ((), (1,)) for k in sets.get("t", [])]

    wanted, every = found()
    monkeypatch.setattr(D, "_SLICED", 0)
    got, whole = found()
    assert got == wanted and wanted[("t", ("d", "f"))] == n and ("t", ("d", "e")) not in wanted
    assert ("b",) in every and ("b",) not in whole and {("c",), ("d", "e"), ("d", "f")} <= set(whole)
    alone = D._exact(tables, {"t": [("b",)]}, 8).first()
    assert alone["n_nulls"] == 0 and 0 < alone["n_rows"] < n / 4 and alone["n_distinct"] < alone["n_rows"]


def test_profile_counts(tables, spark):
    got = {(r["table_name"], r["column_name"]): tuple(r)[2:] for r in D.key_profiles(tables).collect()}
    assert got["lines", "note"] == (1200, 600, 600, False) and got["lines", "price"] == (1200, 0, 1200, True)
    assert got["lines", "part"] == (1200, 0, 7, False) and got["parts", "xs"] == (50, 0, 50, True)
    assert got["empty", "a"] == (0, 0, 0, True)
    plan = D.key_profiles({"lines": tables["lines"]})._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning(at" in line]
    assert keys and not any("note" in line for line in keys)


def test_references_by_value(tables):
    children = [("lines", "o"), ("lines", "part"), ("lines", "note"), ("heads", "total")]
    keys = [("parts", "partkey"), ("parts", "name")]
    assert D.value_references(tables, children, keys) == [("lines", "part", "parts", "partkey")]
    assert D.value_references(tables, [("empty", "a")], keys) == []
    held = D.fk_profile(tables, [("lines", "part", "parts", "partkey")], ["parts"]).first()
    assert held["n_orphans"] == 0 and held["is_foreign_key"]


def test_a_sketch_drops_no_reference_that_holds(spark):
    """Both sides far larger than a sketch."""
    parent, child = spark.range(200_000).toDF("k"), spark.range(0, 200_000, 7).toDF("c")
    tables = {"p": parent, "c": child, "more": spark.range(100, 200_100).toDF("c")}
    assert D.value_references(tables, [("c", "c"), ("more", "c")], [("p", "k")])[:1] == [("c", "c", "p", "k")]
    far = {"p": parent, "c": spark.range(1_000_000, 1_100_000).toDF("c")}
    assert D.value_references(far, [("c", "c")], [("p", "k")]) == []


def test_composite_references(tables, spark):
    extra = {"odd": spark.createDataFrame([(1, 2), (1, 9), (None, 9), (1, 9)], "a int, b int")}
    asked = [("lines", ("o", "n"), "heads", ("head_o", "head_n")), ("odd", ("a", "b"), "heads", ("head_o", "head_n"))]
    got = [tuple(r) for r in D.composite_references(tables | extra, asked).collect()]
    assert got == [("lines", "o,n", "heads", "head_o,head_n", 0, True), ("odd", "a,b", "heads", "head_o,head_n", 1, False)]
