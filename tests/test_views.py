"""What a governed reader may and may not run."""

import pytest
from pyspark.sql import functions as F

from sparkward.functions.masking import masked_view
from sparkward.plans import inputs as I
from sparkward.plans.views import Refused, Tenancy, governed_query, governed_session, tables_accessed


@pytest.fixture(scope="module")
def reader(spark, root):
    loaders = {t: (lambda s, t=t: I.table(s, root, t)) for t in ("orders", "nation", "supplier")}
    loaders["customer"] = lambda s: I.customer_pii(s, root)
    return governed_session(
        spark, loaders, ["Orders", "nation", "customer", "supplier", "missing"],
        masked={"customer": masked_view}, restricted=["supplier"],
    )


@pytest.fixture(scope="module", autouse=True)
def outside(spark, root):
    """Tables of the parent session and of the shared catalogs."""
    spark.read.parquet(f"{root}/supplier.parquet").createOrReplaceTempView("parent_only")
    spark.read.parquet(f"{root}/supplier.parquet").createOrReplaceGlobalTempView("everyones")
    yield
    spark.catalog.dropGlobalTempView("everyones")


def test_visible_tables(reader):
    assert reader.visible == {"orders", "nation", "customer"}


@pytest.mark.parametrize("text", [
    "", "   ;", "DROP VIEW customer", "SELECT 1; SELECT 2", "INSERT INTO orders SELECT * FROM orders",
    "SELECT 1) q; DROP VIEW customer --", "SET x = 1", "CREATE TABLE t AS SELECT 1", "TRUNCATE TABLE orders",
    "SELECT * FROM supplier", "SELECT * FROM parent_only", "SELECT * FROM global_temp.everyones",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)",
    "WITH x AS (SELECT * FROM supplier) SELECT * FROM x",
    "SELECT (SELECT max(s_suppkey) FROM supplier) AS m FROM orders",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
    "SELECT try_reflect('java.lang.System', 'getenv', 'HOME') FROM orders", "SELECT no_such_function(1)", "not sql",
])
def test_refused(reader, text):
    with pytest.raises(Refused):
        governed_query(reader, text)


def test_files_are_not_tables(reader, root):
    with pytest.raises(Refused):
        governed_query(reader, f"SELECT * FROM parquet.`{root}/supplier.parquet`")


def test_catalog_tables_are_refused(spark, reader, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS shared_catalog_table USING parquet LOCATION '{tmp_path}/t' AS SELECT 1 AS a")
    try:
        for name in ("shared_catalog_table", "default.shared_catalog_table", "spark_catalog.default.shared_catalog_table"):
            with pytest.raises(Refused):
                governed_query(reader, f"SELECT * FROM {name}")
    finally:
        spark.sql("DROP TABLE shared_catalog_table")


def test_a_cte_name_does_not_open_a_table(reader):
    """A name defined in the query is that query's own; the restricted table stays shut."""
    rows = governed_query(reader, "WITH supplier AS (SELECT 1 AS a) SELECT * FROM supplier").collect()
    assert [r["a"] for r in rows] == [1]
    with pytest.raises(Refused):
        governed_query(reader, "SELECT * FROM (WITH supplier AS (SELECT 1 AS a) SELECT * FROM supplier) x, supplier")


def test_writing_ctes_are_refused(reader):
    with pytest.raises(Refused):
        governed_query(reader, "WITH del AS (DELETE FROM customer WHERE c_custkey = 1 RETURNING *) SELECT * FROM del")


@pytest.mark.parametrize("text,rows", [
    ("SELECT * FROM orders", 100), ("SELECT * FROM orders LIMIT 50", 50), ("SELECT * FROM orders LIMIT 50000", 100),
    ("SELECT * FROM orders LIMIT 0", 100), ("SELECT * FROM orders LIMIT 0;", 100), ("SELECT * FROM nation", 25),
    ("SELECT 1 AS one", 1), ("SELECT * FROM orders ORDER BY o_orderkey -- all\n", 100),
])
def test_limit(reader, text, rows):
    assert governed_query(reader, text).count() == rows


def test_order_survives(reader):
    keys = [r[0] for r in governed_query(reader, "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC").collect()]
    assert keys == sorted(keys, reverse=True) and len(keys) == 100


def test_tables_accessed(reader):
    df = governed_query(reader, "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
    assert tables_accessed(df) == ["customer", "orders"]


def test_nothing_raw_shows(spark, root, reader):
    raw = {v for r in I.customer_pii(spark, root).select("email", "phone").collect() for v in r if v and len(v) > 6}
    for text in ("SELECT email, phone FROM customer", "SELECT split_part(email, '@', 1) AS a, reverse(phone) AS b FROM customer",
                 "SELECT array_agg(email) AS xs, max(phone) AS p FROM customer",
                 "SELECT email AS harmless, named_struct('p', phone) AS s FROM customer"):
        shown = str(governed_query(reader, text).collect())
        assert not any(v in shown or v[::-1] in shown for v in raw)


def test_predicates_see_masked_values(reader):
    assert governed_query(reader, "SELECT * FROM customer WHERE email LIKE 'customer.%'").count() == 0


def test_settings_follow(spark, reader):
    assert reader.session.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert reader.session.conf.get("spark.sql.runSQLOnFiles") == "false"
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_tenant_rows_are_all_a_reader_can_reach(spark, root):
    loaders = {"customer": lambda s: I.table(s, root, "customer")}
    seven = governed_session(spark, loaders, ["customer"], tenancy={"customer": Tenancy("c_nationkey", "7")})
    assert {r[0] for r in seven.sql("SELECT DISTINCT c_nationkey FROM customer").collect()} == {7}
    # A predicate that fails on another tenant's row must not be run on it.
    text = "SELECT * FROM customer WHERE 1 / (c_nationkey - 8) < 0"
    assert seven.sql(text).count() == seven.table("customer").count() > 0
    everyone = governed_session(spark, loaders, ["customer"], tenancy={"customer": Tenancy("c_nationkey", "")})
    assert everyone.table("customer").count() == spark.read.parquet(f"{root}/customer.parquet").count()


def test_only_needed_columns_are_read(reader):
    plan = governed_query(reader, "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in scan


def test_masks_are_planned_after_the_limit_and_the_order(reader):
    df = governed_query(reader, "SELECT c_custkey, email FROM customer ORDER BY c_custkey")
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_dotted_names(spark):
    from sparkward.functions.masking import mask_frame

    assert mask_frame(spark.sql("SELECT 'abc@x.com' AS `e.mail`")).select(F.col("`e.mail`")).first()[0] == "a***c@x.com"


REFLECT = "reflect('java.lang.System', 'getProperty', 'user.dir')"


@pytest.mark.parametrize("text", [
    "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(40)) + f", {REFLECT} AS c40",
    f"SELECT * FROM customer WHERE c_custkey IN (SELECT max(c_custkey) FROM customer WHERE {REFLECT} = 'x')",
    f"WITH t AS (SELECT {REFLECT} AS r) SELECT 1 AS one FROM t",
    f"SELECT count(*) AS n FROM customer GROUP BY {REFLECT}",
    f"SELECT upper(concat('a', {REFLECT})) AS a",
    "SELECT java_method('java.lang.System', 'lineSeparator') AS r",
    "SELECT input_file_name() AS f FROM customer",
    "SELECT current_user() AS u",
    "SELECT (SELECT version()) AS v",
])
def test_system_functions_are_refused_anywhere(reader, text):
    with pytest.raises(Refused):
        governed_query(reader, text)


def test_a_text_that_names_a_function_is_data(reader):
    assert governed_query(reader, "SELECT 'please reflect(x)' AS x").first()["x"] == "please reflect(x)"


@pytest.mark.parametrize("limit", ["LIMIT 0", "limit 0 -- x", "LIMIT -3", "LIMIT 0 /* limit 5 */", "LIMIT (1 - 1)"])
def test_an_empty_limit_gives_the_most(reader, limit):
    assert governed_query(reader, f"SELECT c_custkey FROM customer {limit}").count() == 100
    assert governed_query(reader, f"WITH t AS (SELECT c_custkey FROM customer) SELECT * FROM t {limit}").count() == 100


def test_other_limits_hold(reader):
    assert governed_query(reader, "SELECT c_custkey FROM customer LIMIT 7 -- limit 0").count() == 7
    assert governed_query(reader, "SELECT 'limit 0' AS x").count() == 1
    assert governed_query(reader, "SELECT * FROM (SELECT c_custkey FROM customer LIMIT 0) q").count() == 0


def tenant_session(spark, root, tenant="7"):
    loaders = {"customer": lambda s: I.table(s, root, "customer"), "nation": lambda s: I.table(s, root, "nation")}
    return governed_session(spark, loaders, list(loaders), tenancy={"customer": Tenancy("c_nationkey", tenant)})


def test_no_predicate_passes_the_tenant_barrier(spark, root):
    seven = tenant_session(spark, root)
    df = seven.sql("SELECT c_custkey FROM customer WHERE 1 / (c_nationkey - 8) < 0 AND c_acctbal > 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "CollectMetrics" in line)
    assert any("c_acctbal" in line and "Filter" in line for line in plan[:at])
    below = " ".join(line for line in plan[at:] if "Filter" in line)
    assert "c_nationkey" in below and "c_acctbal" not in below and "- 8" not in below
    # The tenant's own rows and the columns asked for are all that is scanned for.
    scan = next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in scan


@pytest.mark.parametrize("text", [
    "SELECT count(*) FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey AND CAST(1 / (b.c_nationkey - 8) AS INT) < 5",
    "SELECT count(*) FROM customer WHERE c_custkey IN (SELECT max(c_custkey) FROM customer WHERE 1 / (c_nationkey - 8) < 0) OR TRUE",
    "SELECT (SELECT max(1 / (c_nationkey - 8)) FROM customer), count(*) FROM customer",
    "WITH c AS (SELECT * FROM customer WHERE 1 / (c_nationkey - 8) < 0) SELECT count(*) FROM c UNION ALL SELECT count(*) FROM c",
    "SELECT count(*) FROM customer JOIN nation ON n_nationkey = CAST(7 + 0 * (1 / (c_nationkey - 8)) AS INT)",
    "SELECT sum(1 / (c_nationkey - 8)) FROM customer GROUP BY 1 / (c_nationkey - 8) HAVING max(1 / (c_nationkey - 8)) < 0",
])
def test_hidden_rows_are_in_no_expression(spark, root, text):
    assert tenant_session(spark, root).sql(text.replace("/", "div")).collect()


def test_nothing_is_written_for_a_tenant(spark, root, monkeypatch):
    import sparkward.session as session

    def fail(*_):
        raise AssertionError("a copy")

    monkeypatch.setattr(session, "scratch_path", fail)
    assert tenant_session(spark, root).sql("SELECT * FROM customer").count() > 0
