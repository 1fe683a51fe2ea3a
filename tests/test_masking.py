import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkward.functions import masking as M
from sparkward.functions import scrub as S

VECTORS = [
    ("email", "customer_1@example.com", "c***1@example.com"),
    ("x", "ab@x.com", "***@x.com"),
    ("email", "a@b@c", "***@masked.com"),
    ("email", "", "***@masked.com"),
    ("email", None, None),
    ("e_mail", "sensitive-value-1", "***@masked.com"),
    ("phone", "+1-555-0101", "***-***-0101"),
    ("phone", None, None),
    ("x", "+1-555-0101", "+1-555-0101"),
    ("x", "+1 (663) 555-6869", "***-***-6869"),
    ("mobile_no", "sensitive-value-1", "***-***-****"),
    ("social_security_no", "any text", "[REDACTED_SENSITIVE]"),
    ("credit_card", "any text", "[REDACTED_SENSITIVE]"),
    ("hotel_name", "Grand Hotel", "Grand Hotel"),
    ("mailer_report", "weekly", "weekly"),
    ("price", "9.99", "9.99"),
    ("x", "é.x@y.com", "é***x@y.com"),
    ("x", "a.b@y.com\n", "a***b@y.com\n"),
    ("token", "ann@y.com", "a***n@y.com"),
    ("token", None, None),
]


@pytest.mark.parametrize("column,value,expected", VECTORS)
def test_vectors(spark, column, value, expected):
    df = spark.createDataFrame([(value,)], f"`{column}` string")
    assert M.mask_frame(df).first()[0] == expected


def test_name_classes(spark):
    names = ["E-Mail Address", "email", "Phone-Number", "TELEPHONE", "api_token", "ssn", "mailer", "hotel", "cellar"]
    by_name = [M.pii_class(n) for n in names]
    assert by_name == ["email", "email", "phone", "phone", "secret", "secret", None, None, None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(M.pii_class_column(F.col("n"))).collect()] == by_name


def test_nested_strings_and_other_kinds(spark):
    df = spark.sql(
        "SELECT 7 AS email, array('a@b.co', null) AS xs, named_struct('phone', '555', 'n', 1) AS s, "
        "map('k', 'abc@d.com') AS m, CAST(NULL AS STRUCT<a: STRING>) AS gone"
    )
    row = M.mask_frame(df).first()
    assert row["email"] == 7
    assert row["xs"] == ["***@b.co", None]
    assert (row["s"]["phone"], row["s"]["n"]) == ("***-***-****", 1)
    assert row["m"] == {"k": "a***c@d.com"}
    assert row["gone"] is None


def test_duplicate_names_are_refused(spark):
    with pytest.raises(ValueError, match="named twice"):
        M.mask_frame(spark.sql("SELECT 1 AS a, 2 AS A"))


def test_masks_stay_on_the_jvm(spark, root):
    plan = M.mask_frame(spark.read.parquet(f"{root}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_masked_view_masks_null(spark):
    df = spark.createDataFrame([(None, None), ("123", "nobody"), ("555-1234", "l@x.com")], "phone string, email string")
    assert [tuple(r) for r in M.masked_view(df).collect()] == [
        ("***-***-****", "***@masked.com"), ("***-***-****", "***@masked.com"), ("***-***-1234", "l***@x.com"),
    ]


def test_masking_twice(spark):
    df = spark.createDataFrame([("l***@x.com", "***-***-1234"), ("***@masked.com", "***-***-****")], "email string, phone string")
    assert [tuple(r) for r in M.mask_frame(df).collect()] == [
        ("l****@x.com", "***-***-1234"), ("*****@masked.com", "***-***-****"),
    ]


def test_sql_functions(spark):
    M.register_sql_functions(spark)
    row = spark.sql("SELECT mask_email('abc@x.com'), mask_email('a@b@c'), mask_phone('12-34'), mask_phone('x'), "
                    "mask_secret('s'), mask_secret(NULL), mask_email(NULL)").first()
    assert list(row) == ["a***c@x.com", "***@masked.com", "***-***-1234", "***-***-****", "[REDACTED_SENSITIVE]", None, None]


def _plain_mask(cls, v):
    """The rules, spelled out once more for the property test."""
    email = re.match(r"^[\w.\-]+@[\w.\-]+\.\w+$", v, re.ASCII)
    phone = re.match(r"^(\+?[0-9]{1,3}[- ]?)?\(?[0-9]{3}\)?[- ]?[0-9]{3}[- ]?[0-9]{4}$", v)
    if cls == "email" or email:
        at = v.split("@")
        if len(at) != 2:
            return "***@masked.com"
        return (f"{at[0][0]}***{at[0][-1]}" if len(at[0]) > 2 else "***") + "@" + at[1]
    if cls == "phone" or phone:
        d = re.sub("[^0-9]", "", v)
        return f"***-***-{d[-4:]}" if len(d) >= 4 else "***-***-****"
    return "[REDACTED_SENSITIVE]" if cls == "secret" else v


_TEXT = st.text(alphabet="ab1.@-+() 5_=;'\"/:", max_size=24)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(_TEXT, min_size=50, max_size=200))
def test_mask_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for cls in ("email", "phone", "secret", None):
        got = [r[0] for r in df.select(M.mask_string(F.col("v"), cls)).collect()]
        assert got == [_plain_mask(cls, v) for v in values]


SCRUB = [
    ("postgresql://alice:s3cr3t@h:5432/db", "postgresql://alice:***@h:5432/db"),
    ("password=hunter2 x", "password=*** x"),
    ("LOGIN PASSWORD 's3cret'", "LOGIN PASSWORD '***'"),
    ("hotel lobby mailer", "hotel lobby mailer"),
    ("PWD = 'a b', Secret=\"c;d\";e", "PWD=***, Secret=***;e"),
    ("passwords=1", "passwords=1"),
    (None, None),
]


@pytest.mark.parametrize("text,expected", SCRUB)
def test_scrub_vectors(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.scrub_secrets(F.col("t"))).first()[0] == expected


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.text(alphabet="pwd=secret 'x;://a:@\"", max_size=30), min_size=50, max_size=200))
def test_scrub_twice_is_scrub_once(spark, values):
    once = spark.createDataFrame([(v,) for v in values], "v string").select(S.scrub_secrets(F.col("v")).alias("a"))
    assert once.filter(S.scrub_secrets(F.col("a")) != F.col("a")).count() == 0


FINDINGS = [
    ("mail a.b@c.de, x@y.zz.", [("email", "a.b@c.de"), ("email", "x@y.zz")]),
    ("a@b.c-d@e.f", [("email", "a@b.c"), ("email", "-d@e.f")]),
    ("call +1 (663) 555-6869 or 5551234567", [("phone", "+1 (663) 555-6869"), ("phone", "5551234567")]),
    ("card 4111111111111111 no", []),
    ("555-123-4567 555-123-4568", [("phone", "555-123-4567"), ("phone", "555-123-4568")]),
    ("token = \"abc\" pwd=x", [("credential", "token = \"abc\""), ("credential", "pwd=x")]),
    ("at pg://u:p@h/db", [("uri_password", "://u:p@")]),
    ("nothing", []),
]
REDACTED = [
    "mail a***b@c.de, ***@y.zz.", "***@b.c***@e.f", "call ***-***-6869 or ***-***-4567",
    "card 4111111111111111 no", "***-***-4567 ***-***-4568", "token=*** pwd=***", "at pg://u:***@h/db", "nothing",
]


def test_findings_and_redaction(spark):
    keys = (*S.CREDENTIAL_KEYS, "token")
    texts = [t for t, _ in FINDINGS]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = S.text_findings(df, "id", "text", keys).collect()
    for i, (_, expected) in enumerate(FINDINGS):
        got = sorted(((r["class"], r["pos"], r["value"]) for r in found if r["id"] == i), key=lambda x: (x[0], x[1]))
        assert [(c, v) for c, _, v in got] == sorted(expected, key=lambda e: e[0])
    redacted = df.select("id", S.redact_text(F.col("text"), keys).alias("r")).orderBy("id").collect()
    assert [r["r"] for r in redacted] == REDACTED


def test_long_runs_are_read_once(spark):
    """A text of one run of word characters must not take quadratic time."""
    df = spark.createDataFrame([("a" * 2_000_000 + " @ ",)], "text string")
    assert S.text_findings(df.withColumn("id", F.lit(1)), "id", "text").count() == 0
    assert df.select(F.length(S.redact_text(F.col("text")))).first()[0] == 2_000_003


def test_scrubbed_lines_stay_json(spark):
    df = spark.createDataFrame([("x", {"raw": ["password=hunter2"]})], "type string, detail map<string, array<string>>")
    row = S.scrub_leaves(df).first()
    assert row["detail"] == {"raw": ["password=***"]}
