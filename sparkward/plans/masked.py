"""Queries on masking and scrubbing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.functions import masking as M
from sparkward.functions import scrub as S
from sparkward.plans import check_sql as C
from sparkward.plans import inputs as I
from sparkward.plans.access import role_session
from sparkward.plans.registry import query

# Spellings of column names, given to parts by their size.
_NAMES = (
    "E-Mail Address", "mobile_no", "Social Security No", "hotel_name", "mailer_report",
    "API-Token", "Telephone", "credit_card", "microphone", "price",
)
_NAME = (
    "concat(p_brand, ' ', CASE p_size % 10 "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES[:-1]))
    + f" ELSE '{_NAMES[-1]}' END)"
)


@query("normalize_column", f"""
    SELECT p_partkey, {_NAME} AS name, regexp_replace(lower({_NAME}), '[^a-z]', '', 'g') AS plain FROM part""")
def normalize_column(spark, root):
    named = I.table(spark, root, "part").selectExpr("p_partkey", f"{_NAME} AS name")
    return named.withColumn("plain", M.normalize_column(F.col("name")))


_PLAIN = "regexp_replace(lower(name), '[^a-z]', '', 'g')"
_CLASS = f"""CASE WHEN regexp_matches({_PLAIN}, 'email') THEN 'email'
    WHEN regexp_matches({_PLAIN}, 'phone|mobile|telephone') THEN 'phone'
    WHEN regexp_matches({_PLAIN}, 'token|secret|password|passwd|ssn|socialsecurity|creditcard|passcode')
    THEN 'secret' END"""


@query("pii_columns", f"""
    SELECT coalesce({_CLASS}, 'none') AS class, name, count(*) AS n
    FROM (SELECT {_NAME} AS name FROM part) GROUP BY 1, 2""")
def pii_columns(spark, root):
    named = I.table(spark, root, "part").selectExpr(f"{_NAME} AS name")
    return named.groupBy("name").agg(F.count("*").alias("n")).select(
        F.coalesce(M.pii_class_column(F.col("name")), F.lit("none")).alias("class"), "name", "n"
    )


def _masks(cls: str, column: str) -> str:
    return I.with_sql("customer_pii", f"""
        SELECT c_custkey, {C.mask(column, cls)} AS masked, {C.mask(column)} AS by_value FROM customer_pii""")


@query("mask_email", _masks("email", "email"))
def mask_email(spark, root):
    v = F.col("email")
    return I.customer_pii(spark, root).select(
        "c_custkey", M.mask_string(v, "email").alias("masked"), M.mask_string(v, None).alias("by_value")
    )


@query("mask_phone", _masks("phone", "phone"))
def mask_phone(spark, root):
    v = F.col("phone")
    return I.customer_pii(spark, root).select(
        "c_custkey", M.mask_string(v, "phone").alias("masked"), M.mask_string(v, None).alias("by_value")
    )


_SECRET = "CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'ann@x.example.com' ELSE props END"


@query("mask_secret", f"SELECT event_id, {C.mask('v', 'secret')} AS api_token FROM (SELECT event_id, {_SECRET} AS v FROM events)")
def mask_secret(spark, root):
    tokens = I.table(spark, root, "events").selectExpr("event_id", f"{_SECRET} AS api_token")
    return tokens.withColumn("api_token", M.mask_string(F.col("api_token"), M.pii_class("api_token")))


@query("mask_frame", I.with_sql("customer_pii", f"""
    SELECT c_custkey, c_name, {C.mask('email', 'email')} AS email, {C.mask('phone', 'phone')} AS phone,
           {C.mask('phone')} AS contact,
           concat_ws('|', {C.mask('phone')}, {C.mask('email')}, c_mktsegment) AS contacts,
           {C.mask('phone', 'secret')} AS pair_secret, {C.mask('email')} AS pair_note FROM customer_pii"""))
def mask_frame(spark, root):
    wide = I.customer_pii(spark, root).select(
        "c_custkey", "c_name", "email", "phone", F.col("phone").alias("contact"),
        F.array("phone", "email", "c_mktsegment").alias("contacts"),
        F.struct(F.col("phone").alias("secret"), F.col("email").alias("note")).alias("pair"),
    )
    return M.mask_frame(wide).select(
        "c_custkey", "c_name", "email", "phone", "contact",
        F.concat_ws("|", "contacts").alias("contacts"),
        F.col("pair.secret").alias("pair_secret"), F.col("pair.note").alias("pair_note"),
    )


_VIEW = I.with_sql("customer_pii", "").rstrip() + f", v AS ({C.CUSTOMER_VIEW}) "


@query("masked_customer_view", _VIEW + "SELECT * FROM v")
def masked_customer_view(spark, root):
    return M.masked_view(I.customer_pii(spark, root))


@query("masked_pipeline", _VIEW + f"""
    SELECT c_custkey, {C.mask('c_name')} AS c_name, c_nationkey, c_acctbal,
           {C.mask('c_mktsegment')} AS c_mktsegment, {C.mask('email', 'email')} AS email,
           {C.mask('phone', 'phone')} AS phone FROM v""")
def masked_pipeline(spark, root):
    return M.mask_frame(M.masked_view(I.customer_pii(spark, root)))


@query("mask_before_function", _VIEW + """
    SELECT c_custkey, split_part(email, '@', 1) AS local_part, split_part(email, '@', 2) AS domain_part,
           substring(phone, 1, 3) AS p1, substring(phone, 4, 3) AS p2, reverse(phone) AS backwards FROM v""")
def mask_before_function(spark, root):
    return role_session(spark, root).sql("""
        SELECT c_custkey, split_part(email, '@', 1) AS local_part, split_part(email, '@', 2) AS domain_part,
               substring(phone, 1, 3) AS p1, substring(phone, 4, 3) AS p2, reverse(phone) AS backwards
        FROM customer""")


@query("scrub_secrets", I.with_sql("audit", f"""
    SELECT event_id, {C.scrub('raw_input')} AS scrubbed FROM audit WHERE raw_input IS NOT NULL"""))
def scrub_secrets(spark, root):
    log = I.audit_log(spark, root).filter(F.col("raw_input").isNotNull())
    return log.select("event_id", S.scrub_secrets(F.col("raw_input")).alias("scrubbed"))


@query("scrub_events", I.with_sql("audit", f"""
    SELECT {C.scrub("CAST(to_json({event_id: event_id, type: type, detail: {raw: coalesce(raw_input, ''), tables: tables_accessed}, safe_sql: safe_sql}) AS VARCHAR)")} AS line
    FROM audit"""))
def scrub_events(spark, root):
    log = I.audit_log(spark, root).select(
        "event_id", "type",
        F.struct(F.coalesce("raw_input", F.lit("")).alias("raw"), F.col("tables_accessed").alias("tables"))
        .alias("detail"), "safe_sql",
    )
    return S.scrub_events(log)


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count({c}) AS n_values, "
        f"CAST(count(CASE WHEN regexp_matches({c}, '{C.EMAIL}') THEN 1 END) AS DOUBLE) / count({c}) AS email_share, "
        f"CAST(count(CASE WHEN regexp_matches({c}, '{C.PHONE}') THEN 1 END) AS DOUBLE) / count({c}) AS phone_share "
        f"FROM {table}" for c in columns
    )


_PROFILED = {
    "customer_pii": ("c_name", "c_mktsegment", "email", "phone"),
    **{
        t: tuple(c for c, kind in columns if kind == "string")
        for t, columns in I.COLUMNS.items()
        if t != "customer" and any(kind == "string" for _, kind in columns)
    },
}


@query("pii_value_profile", I.with_sql("customer_pii", " UNION ALL ".join(
    _profile_sql(t, c) for t, c in _PROFILED.items())))
def pii_value_profile(spark, root):
    parts = [
        M.value_profile(I.customer_pii(spark, root) if t == "customer_pii" else I.table(spark, root, t), t)
        for t in _PROFILED
    ]
    return reduce(DataFrame.unionByName, parts)


# The given texts announce credentials with `token` too.
_KEYS = (*S.CREDENTIAL_KEYS, "token")
_TEXTS = (
    "texts AS (SELECT 'documents' AS source_table, doc_id AS id, text FROM documents "
    "UNION ALL SELECT 'pages', page_id, html FROM pages)"
)


def _texts(spark, root) -> DataFrame:
    docs = I.table(spark, root, "documents").select(
        F.lit("documents").alias("source_table"), F.col("doc_id").alias("id"), "text")
    pages = I.table(spark, root, "pages").select(
        F.lit("pages").alias("source_table"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


def _found(cls: str, pattern: str, group: int, options: str = "") -> str:
    extra = f", '{options}'" if options else ""
    return (
        f"SELECT source_table, id, '{cls}' AS class, unnest(f) AS value, "
        f"CAST(unnest(range(len(f))) AS INT) AS pos FROM (SELECT source_table, id, "
        f"regexp_extract_all(text, '{pattern}', {group}{extra}) AS f FROM texts)"
    )


@query("pii_text_findings", f"WITH {_TEXTS} " + " UNION ALL ".join([
    _found("email", C.EMAIL_FOUND, 0),
    _found("phone", rf"(?:^|[^0-9])({C.PHONE_FOUND}\d{{4}})\b", 1),
    _found("credential", C.key_value("|".join(_KEYS)), 0, "i"),
    _found("uri_password", C.URI, 0),
]))
def pii_text_findings(spark, root):
    texts = _texts(spark, root).withColumn("key", F.struct("source_table", "id"))
    return S.text_findings(texts, "key", "text", _KEYS).select("key.*", "class", "pos", "value")


@query("redact_text", f"""WITH {_TEXTS} SELECT source_table, id, length(r) AS n_chars, md5(r) AS digest
    FROM (SELECT source_table, id, {C.redact('text', '|'.join(_KEYS))} AS r FROM texts)""")
def redact_text(spark, root):
    redacted = S.redact_text(F.col("text"), _KEYS)
    return _texts(spark, root).withColumn("r", redacted).select(
        "source_table", "id", F.length("r").cast("bigint").alias("n_chars"), F.md5("r").alias("digest")
    )
