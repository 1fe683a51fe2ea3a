"""Policy, bounded results, discovery, mutations, audit log and compat functions."""

import pytest
from pyspark.sql import functions as F

from sparkward.functions import compat as X
from sparkward.operators import audit as L
from sparkward.operators import bounded as B
from sparkward.operators import discover as D
from sparkward.operators import mutate as U
from sparkward.operators import policy as P
from sparkward.operators.ranges import range_join
from sparkward.session import scratch_path
from sparkward.sources import audit_log as A
from sparkward.sources.tables import scan_table


def one(spark, *cells):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first())


@pytest.mark.parametrize("asked,holds", [(None, 100), (0, 100), (-5, 100), (50_000, 100), (50, 50), (1, 1), (100, 100), ("x", 100), ("7", 7)])
def test_clamp(asked, holds):
    assert B.clamp(asked) == holds


def test_row_cap_and_metrics(spark):
    df = spark.range(150)
    capped = B.row_cap(df, [F.col("id")], 100).collect()
    assert len(capped) == 100 and all(r["truncated"] for r in capped)
    whole = B.row_cap(df, [F.col("id")], 150).collect()
    assert len(whole) == 150 and not any(r["truncated"] for r in whole)
    m = B.result_metrics(df, [F.col("id")]).first()
    assert (m["row_count"], m["truncated"]) == (100, True) and "row limit" in m["truncation_reason"]
    m = B.result_metrics(spark.range(5), [F.col("id")]).first()
    assert (m["row_count"], m["payload_bytes"], m["truncated"], m["truncation_reason"]) == (5, 40, False, "")
    assert B.result_metrics(spark.range(0), [F.col("id")]).first()["row_count"] == 0


def test_byte_budget_stops_at_the_first_row_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b" * 50), (3, "c")], "id int, v string")
    kept = B.byte_budget(df, [F.col("id")], max_bytes=45).collect()
    assert [r["id"] for r in kept] == [1] and kept[0]["truncated"]
    assert len(B.byte_budget(df, [F.col("id")], max_bytes=1000).collect()) == 3


def test_policy(spark):
    rows = [("reader", "", ["Orders", "orders"], None, None, None, None), ("admin", "", ["orders", "nation"], ["orders"], True, True, True)]
    policy = spark.createDataFrame(rows, P.POLICY_SCHEMA)
    grants = {tuple(r) for r in P.grants_table(policy).collect()}
    assert grants == {("reader", "orders", "read"), ("admin", "orders", "read"), ("admin", "nation", "read"), ("admin", "orders", "write")}
    asked = spark.createDataFrame([(1, " Admin ", ["ORDERS", "secret"]), (2, "superhacker", ["orders"]), (3, "reader", ["orders"])], "request_id int, role string, tables_accessed array<string>")
    assert {r["request_id"]: r["active_role"] for r in P.resolve_role(asked, policy, "reader").collect()} == {1: "admin", 2: "reader", 3: "reader"}
    denied = P.denied_tables(asked, P.grants_table(policy), "read").collect()
    assert {r["request_id"]: r["denied"] for r in denied} == {1: ["orders", "secret"], 2: ["orders"]}
    listed = P.unlisted_tables(asked, ["orders"], "request_id", "tables_accessed").collect()
    assert [(r["request_id"], r["denied"]) for r in listed] == [(1, ["secret"])]
    spec = {r["request_id"]: r["tables_read"] for r in P.role_spec(asked, policy, ["album"]).collect()}
    assert spec == {1: ["album"], 2: ["album"], 3: ["orders", "orders"]}


@pytest.mark.parametrize("rows,default,reason", [
    ([], "reader", "no roles defined"), ([("admin",)], "reader", "default role not in roles"),
    ([("reader",), (None,)], "reader", "role without a name"), ([("reader",)], "reader", "ok"),
])
def test_policy_fails_closed(spark, rows, default, reason):
    full = [(r[0], "", ["a"], [], True, True, True) for r in rows]
    policy = spark.createDataFrame(full, P.POLICY_SCHEMA)
    problems = P.policy_problems(policy, default).first()
    assert (problems["reason"], problems["degraded"]) == (reason, reason != "ok")
    held = P.validated_policy(policy, default, ["Album"]).first()
    assert held["can_approve"] == (reason == "ok") and held["tables_read"] == (["a"] if reason == "ok" else ["album"])


def test_capabilities(spark):
    policy = spark.createDataFrame([("editor", "", [], [], True, None, False)], P.POLICY_SCHEMA)
    asked = spark.createDataFrame([(1, "editor", "propose"), (2, "editor", "apply"), (3, "editor", "reset"), (4, "nobody", "propose"), (5, "nobody", "read")], "id int, role string, kind string")
    got = {r["id"]: r["verdict"] for r in P.capability_gate(asked, policy).collect()}
    assert got == {1: "ALLOWED", 2: "FORBIDDEN_ROLE", 3: "FORBIDDEN_ROLE", 4: "FORBIDDEN_ROLE", 5: "ALLOWED"}


def test_scan_is_allowlisted(spark, root):
    assert scan_table(spark, root, "  NATION ", ["nation"]).count() == 25
    with pytest.raises(PermissionError):
        scan_table(spark, root, "supplier", ["nation"])


def test_discovery(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, None, 5)], "id int, name string, ref int")
    keys = {r["column_name"]: r for r in D.key_profile(t, ["id", "name", "ref"], "t").collect()}
    assert [keys[c]["is_key"] for c in ("id", "name", "ref")] == [True, False, False]
    assert (keys["name"]["n_nulls"], keys["name"]["n_distinct"]) == (1, 1)
    cols = D.describe_table(t, "t").orderBy("cid").collect()
    assert [(r["name"], r["type"], r["notnull"], r["is_primary_key"]) for r in cols] == [("id", "int", True, True), ("name", "string", False, False), ("ref", "int", False, False)]
    parent = spark.createDataFrame([(5,), (6,)], "k int")
    refs = D.fk_profile({"t": t, "p": parent, "hidden": parent}, [("t", "ref", "p", "k"), ("t", "id", "p", "k"), ("t", "ref", "hidden", "k")], {"p"})
    assert {(r["column_name"], r["references_table"]): (r["n_orphans"], r["is_foreign_key"]) for r in refs.collect()} == {("ref", "p"): (0, True), ("id", "p"): (3, False)}


def test_catalog_estimates(spark, tmp_path):
    spark.sql(f"CREATE TABLE estimated USING parquet LOCATION '{tmp_path}/e' AS SELECT id FROM range(42)")
    try:
        spark.sql("ANALYZE TABLE estimated COMPUTE STATISTICS")
        assert D.catalog_estimate(spark, "estimated") == 42
    finally:
        spark.sql("DROP TABLE estimated")


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", 7)], "id int, v string, n int")
    with pytest.raises(ValueError):
        U.Mutation(U.UPDATE, None, {"v": F.lit("x")})
    with pytest.raises(ValueError):
        U.Mutation(U.DELETE)
    with pytest.raises(ValueError):
        U.Mutation("DROP", F.lit(True))
    gone = U.Mutation(U.DELETE, F.col("v") == "a")
    assert [r["id"] for r in U.transformed(base, gone).orderBy("id").collect()] == [2, 3]
    assert U.affected(base, gone).first()[0] == 1
    up = U.Mutation(U.UPDATE, F.col("v") != "a", {"n": F.col("n") * 10})
    assert [r["n"] for r in U.transformed(base, up).orderBy("id").collect()] == [5, 6, 70]
    assert U.transformed(base, up).schema == base.schema
    assert [(r["side"], r["n"]) for r in U.preview(base, up).collect()] == [("before", 7), ("after", 70)]
    assert U.preview(base, U.Mutation(U.DELETE, F.lit(True))).count() == 3


def test_versions(spark):
    place = scratch_path(spark, "versions-test")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert U.write_version(base, place) == 1
    assert U.apply(spark, place, U.Mutation(U.DELETE, F.col("id") == 1)) == 2
    assert (U.read_version(spark, place, 1).count(), U.read_version(spark, place).count()) == (2, 1)
    # A writer died after writing some of version 3: readers do not see it, the next writer is told.
    base.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{place}/v3")
    assert U.versions(spark, place) == [1, 2] and U.read_version(spark, place).count() == 1
    with pytest.raises(FileExistsError):
        U.apply(spark, place, U.Mutation(U.INSERT, rows=base))
    assert U.clear_abandoned(spark, place) == [3]
    assert U.apply(spark, place, U.Mutation(U.INSERT, rows=base)) == 3
    assert U.apply(spark, place, U.Mutation(U.INSERT, rows=base.limit(1))) == 4
    assert [U.read_version(spark, place, n).count() for n in (2, 3, 4)] == [1, 3, 4]
    assert spark.read.parquet(f"{place}/v4a").count() == 1  # an insert writes only its rows
    assert U.apply(spark, place, U.Mutation(U.DELETE, F.lit(True))) == 5
    assert U.read_version(spark, place).count() == 0


def test_of_two_writers_one_fails(spark):
    place = scratch_path(spark, "writers-test")
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    U.write_version(base, place)
    # both read version 1 before either writes
    assert U.write_version(base.union(base), place, 1) == 2
    for added in (True, False):
        with pytest.raises(FileExistsError):
            U.write_version(base, place, 1, only_added=added)
    assert U.read_version(spark, place).count() == 2
    with pytest.raises(FileNotFoundError):
        U.read_version(spark, place + "-none")


def test_a_proposal_is_applied_once(spark):
    place, ledger, used = (scratch_path(spark, f"proposal-{x}") for x in ("table", "ledger", "used"))
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    U.write_version(base, place)
    change, other = U.Mutation(U.DELETE, F.col("id") == 1), U.Mutation(U.DELETE, F.col("id") == 2)
    for token, us in (("young", 10_000_000), ("old", 0)):
        U.record(U.propose(base, change, token, us, ["t"]), ledger)
    now = 301_000_000

    def go(token, what=change, approve=True):
        return U.apply_proposal(spark, place, ledger, used, token, what, now, approve)

    for refused in (lambda: go("young", approve=False), lambda: go("old"), lambda: go("young", other)):
        with pytest.raises(PermissionError):
            refused()
    with pytest.raises(LookupError):
        go("none")
    U.write_version(base, place, 5)  # no base for it: the newest version is 6 now
    assert go("young") == 7
    assert [r["id"] for r in U.read_version(spark, place).collect()] == [2]
    with pytest.raises(PermissionError):
        go("young")


def test_ledger(spark):
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    row = U.propose(base, U.Mutation(U.DELETE, F.lit(True)), "t1", 1_000_000, ["T", "t", "s"]).first()
    assert (row["statement_type"], row["target_tables"], row["status"]) == ("DELETE", ["s", "t"], "AWAITING_OPERATOR_APPROVAL")
    assert row["query_plan"] and row["normalized_sql"] == "DELETE FROM s WHERE true"
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(60)])
    plan = "\n".join(U.plan_lines(wide))
    assert "c59" in plan and "more fields" not in plan
    pending = spark.createDataFrame([("a", 0), ("b", 0), ("c", 200_000_000)], "proposal_token string, us bigint")
    used = spark.createDataFrame([("a",), ("a",)], "proposal_token string")
    state = U.proposal_status(pending, used, 300_000_001)
    assert {r["proposal_token"]: r["state"] for r in state.collect()} == {"a": "APPLIED", "b": "EXPIRED", "c": "PENDING"}
    assert {r["state"] for r in U.proposal_status(pending, used.limit(0), 300_000_000).collect()} == {"PENDING"}


def test_lifecycle_takes_the_first_outcome(spark):
    p = spark.createDataFrame([("a", "s1", 0), ("b", "s1", 0)], "proposal_token string, session_id string, us bigint")
    o = spark.createDataFrame([("a", "s2", 400_000_000, "MUTATION_APPLIED"), ("a", "s1", 5, "MUTATION_REJECTED")], "proposal_token string, session_id string, us bigint, type string")
    got = {r["proposal_token"]: tuple(r)[2:] for r in U.mutation_lifecycle(p, o).collect()}
    assert got == {"a": ("MUTATION_REJECTED", 5, False, True), "b": ("OPEN", -1, False, False)}


def test_audit_file(spark):
    path = scratch_path(spark, "audit-test")
    assert A.read_audit(spark, path).count() == 0
    lines = ['{"ts": 1.25, "type": "QUERY_ACCEPTED", "tables_accessed": ["a"]}', "", "{broken", '{"ts": 2, "type": "X", "other": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    log = A.read_audit(spark, path)
    assert sorted(r["type"] for r in A.good_events(log).collect()) == ["QUERY_ACCEPTED", "X"]
    assert [r[0] for r in A.bad_lines(log).collect()] == ["{broken"]
    at = A.good_events(log).select(F.unix_micros(A.event_time(F.col("ts")))).collect()
    assert sorted(r[0] for r in at) == [1_250_000, 2_000_000]


def test_export(spark):
    df = spark.sql("SELECT 1 AS i, CAST(1.5 AS DECIMAL(4,2)) AS d, DATE '2024-01-02' AS day, CAST('ab' AS BINARY) AS b, true AS t, array(1) AS a")
    assert A.as_json_rows(df).first()[0] == '{"i":1,"d":"1.50","day":"2024-01-02","b":"YWI=","t":true,"a":[1]}'


@pytest.mark.parametrize("n,holds", [(5, 5), (0, 1), (-3, 1), (999, 200), (None, 20), ("x", 20)])
def test_last_n_clamp(n, holds):
    assert L.clamp_last(n) == holds


def test_last_events_are_oldest_first_and_bad_lines_take_a_place(spark):
    log = spark.createDataFrame([(i, i % 4 != 0) for i in range(50)], "seq int, ok boolean")
    assert [r["seq"] for r in L.last_events(log, "seq", 6, F.col("ok")).collect()] == [45, 46, 47, 49]


def test_function_verdicts(spark):
    df = spark.createDataFrame([("SELECT COUNT(*), pg_sleep(1), pg_read_binary_file ('x'), my_f(upper(a))",)], "q string")
    assert {r["function_name"]: r["verdict"] for r in L.function_usage(df, "q").collect()} == {"count": "ALLOWLISTED", "pg_sleep": "BLOCKED_NAME", "pg_read_binary_file": "BLOCKED_PREFIX", "my_f": "OTHER", "upper": "ALLOWLISTED"}


def test_compat(spark):
    s = F.lit("abcdef")
    assert one(spark, X.substring(s, 0, 3), X.substring(s, 2, 3), X.substring(s, -5, 3)) == ["ab", "bcd", ""]
    assert one(spark, X.left(s, 2), X.left(s, -2), X.left(s, -9), X.right(s, 2), X.right(s, -2), X.right(s, 9), X.right(s, 0)) == ["ab", "abcd", "", "ef", "cdef", "abcdef", ""]
    assert one(spark, X.concat(F.lit("a"), F.lit(None), F.lit("b")), X.strpos(s, "cd")) == ["ab", 3]
    assert one(spark, X.trunc(F.lit(-2.75)), X.trunc(F.lit(2.75), 1), X.log(F.lit(100.0))) == [-2.0, 2.7, 2.0]
    assert one(spark, X.day_of_week(F.lit("2024-01-07").cast("date")), X.epoch(F.lit("1970-01-01 00:00:01.5").cast("timestamp"))) == [0, 1.5]
    assert one(spark, X.encode(F.lit("ab").cast("binary"), "hex"), X.json_path_text(F.lit('{"a":{"b":7}}'), "a", "b")) == ["6162", "7"]
    assert X.date_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    age = one(spark, X.age(F.lit("2024-03-15").cast("date"), F.lit("2023-12-31").cast("date")))[0]
    assert (age["months"], age["days"], age["micros"]) == (2, 15, 0)
    for later, earlier, wanted in (
        ("2001-04-10", "1957-06-13", (43 * 12 + 9, 27, 0)), ("2021-02-28", "2020-02-29", (11, 28, 0)),
        ("2024-03-01 06:00:00", "2024-02-29 18:00:00", (0, 0, 12 * 3_600_000_000)), ("2024-03-31", "2024-03-31", (0, 0, 0)),
        ("1957-06-13", "2001-04-10", (-43 * 12 - 9, -27, 0)),
    ):
        got = one(spark, X.age(F.lit(later).cast("timestamp"), F.lit(earlier).cast("timestamp")))[0]
        assert tuple(got) == wanted
    moment = F.lit("2024-01-07 15:04:05").cast("timestamp")
    assert one(spark, X.to_char(moment, "HH:MI AM"), X.to_char(moment, 'FMMonth YYYY, "at" HH24')) == ["03:04 PM", "January 2024, at 15"]
    for bad in ("Month YYYY", "Q", "YYYY W", '"open'):
        with pytest.raises(ValueError):
            X.date_pattern(bad)
    assert one(spark, X.initcap(F.lit("foo-bar  bAZ_9x éa")), X.int_div(F.lit(-7), F.lit(2))) == ["Foo-Bar  Baz_9x Éa", -3]
    assert one(spark, X.round_double(F.lit(2.5)), X.round_double(F.lit(3.5)), X.sqrt(F.lit(4.0))) == [2.0, 4.0, 2.0]
    later = F.date_format(F.lit("2024-01-31").cast("timestamp") + X.make_interval(months=1, hours=3), "yyyy-MM-dd HH")
    assert one(spark, later) == ["2024-02-29 03"]
    series = [[r[0] for r in spark.range(1).select(X.generate_series(*map(F.lit, a))).collect()] for a in ((1, 4), (5, 1, -2), (3, 1), (2, 2))]
    assert series == [[1, 2, 3, 4], [5, 3, 1], [], [2]]
    with pytest.raises(Exception, match="square root"):
        one(spark, X.sqrt(F.lit(-1.0)))
    agg = spark.createDataFrame([(1, None), (1, 2)], "k int, v int").groupBy("k").agg(X.array_agg(F.col("v")).alias("vs")).first()["vs"]
    assert sorted(agg, key=str) == [2, None]
    with pytest.raises(Exception, match="logarithm"):
        one(spark, X.log(F.lit(0.0)))


def test_range_join_against_all_pairs(spark):
    points = spark.createDataFrame([(i, i * 37 % 500) for i in range(200)], "p int, x int")
    ranges = spark.createDataFrame([(j, j * 13 % 480, j * 13 % 480 + j % 60) for j in range(80)], "r int, lo int, hi int")
    got = {(r["p"], r["r"]) for r in range_join(points, ranges, "x", "lo", "hi", 25).collect()}
    all_points, all_ranges = points.collect(), ranges.collect()
    want = {(p["p"], r["r"]) for p in all_points for r in all_ranges if r["lo"] <= p["x"] < r["hi"]}
    assert got == want and want


def test_byte_budget_says_which_cap(spark):
    from sparkward.operators import bounded as B

    df = spark.range(500).select("id", F.lit("x" * 10).alias("v"))
    by_rows = B.byte_budget(df, [F.col("id")]).collect()
    assert len(by_rows) == 100 and all(r["truncated"] and r["truncation_reason"] == B.over_rows(100) for r in by_rows)
    by_bytes = B.byte_budget(df, [F.col("id")], max_bytes=1024).collect()
    assert 0 < len(by_bytes) < 100 and all(r["truncation_reason"] == B.over_bytes(1024) for r in by_bytes)
    whole = B.byte_budget(df.filter("id < 9"), [F.col("id")]).collect()
    assert len(whole) == 9 and not any(r["truncated"] or r["truncation_reason"] for r in whole)


def test_usage_median_is_exact(spark):
    from sparkward.operators import audit as L

    rows = [("QUERY_ACCEPTED", "s", 1, float(i * i % 30_011), 0) for i in range(25_001)]
    log = spark.createDataFrame(rows, "type string, session_id string, row_count long, exec_ms double, us long")
    got = L.usage(log.withColumn("at", F.timestamp_micros("us"))).first()
    assert got["exec_ms_p50"] == sorted(r[3] for r in rows)[12_500]
