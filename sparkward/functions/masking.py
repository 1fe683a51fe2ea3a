"""Masking of personal data by column name and by value, as plain `Column`s."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name stems per class, looked up in this order.
STEMS = {
    "email": ("email",),
    "phone": ("phone", "mobile", "telephone"),
    "secret": (
        "token", "secret", "password", "passwd", "ssn",
        "socialsecurity", "creditcard", "passcode",
    ),
}
# What a whole value must look like to count as an email or a phone.
# [\p{L}\p{N}_] is a word character and \p{Nd} a digit in any script; (?d) lets $
# stand before a final newline only.
EMAIL_VALUE = r"(?d)^[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+$"
PHONE_VALUE = (
    r"(?d)^(\+?\p{Nd}{1,3}[- ]?)?\(?\p{Nd}{3}\)?[- ]?\p{Nd}{3}[- ]?\p{Nd}{4}$"
)
# A phone value is at most 19 characters and a final newline.
_PHONE_VALUE_MAX = 20

STARS = "***"
NO_EMAIL = "***@masked.com"
NO_PHONE = "***-***-****"
SECRET = "[REDACTED_SENSITIVE]"


def normalize_name(name: str) -> str:
    return re.sub("[^a-z]", "", (name or "").lower())


def normalize_column(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def pii_class(name: str) -> str | None:
    """The class a column name announces, or None."""
    plain = normalize_name(name)
    for cls, stems in STEMS.items():
        if any(stem in plain for stem in stems):
            return cls
    return None


def pii_class_column(name: Column) -> Column:
    """`pii_class` for names that are data."""
    plain = normalize_column(name)
    chain = F
    for cls, stems in STEMS.items():
        chain = chain.when(plain.rlike("|".join(stems)), F.lit(cls))
    return chain


def is_email(value: Column) -> Column:
    return value.contains("@") & value.rlike(EMAIL_VALUE)


def is_phone(value: Column) -> Column:
    return (F.length(value) <= _PHONE_VALUE_MAX) & value.rlike(PHONE_VALUE)


def mask_email(value: Column) -> Column:
    parts = F.split(value, "@")
    name, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shown = F.when(
        F.length(name) > 2,
        F.concat(F.substring(name, 1, 1), F.lit(STARS), F.substring(name, -1, 1)),
    ).otherwise(F.lit(STARS))
    return F.when(F.size(parts) == 2, F.concat(shown, F.lit("@"), domain)).otherwise(
        F.lit(NO_EMAIL)
    )


def mask_phone(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\P{Nd}", "")
    return F.when(
        F.length(digits) >= 4, F.concat(F.lit("***-***-"), F.substring(digits, -4, 4))
    ).otherwise(F.lit(NO_PHONE))


def mask_string(value: Column, cls: str | None) -> Column:
    """Mask one string of a column of class `cls`. NULL stays NULL."""
    chain = F.when(value.isNull(), value)
    if cls == "email":
        return chain.otherwise(mask_email(value))
    chain = chain.when(is_email(value), mask_email(value))
    if cls == "phone":
        return chain.otherwise(mask_phone(value))
    chain = chain.when(is_phone(value), mask_phone(value))
    return chain.otherwise(F.lit(SECRET) if cls == "secret" else value)


def map_strings(
    value: Column, kind: T.DataType, name: str, fn: Callable[[Column, str], Column]
) -> Column:
    """Apply `fn(string, nearest field name)` to a string or to the strings within."""
    if isinstance(kind, T.StringType):
        return fn(value, name)
    if not _holds_strings(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: map_strings(v, kind.elementType, name, fn))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: map_strings(v, kind.valueType, name, fn))
    fields = [
        map_strings(value.getField(f.name), f.dataType, f.name, fn).alias(f.name)
        for f in kind.fields
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def _holds_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_strings(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_strings(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def mask_frame(df: DataFrame) -> DataFrame:
    """Mask every string of every column, strings inside arrays and structs too."""
    seen = [c.lower() for c in df.columns]
    twice = sorted({c for c in seen if seen.count(c) > 1})
    if twice:
        raise ValueError(f"output columns named twice: {twice}")
    return df.select(
        *[
            map_strings(
                F.col(f"`{f.name}`"), f.dataType, f.name,
                lambda v, name: mask_string(v, pii_class(name)),
            ).alias(f.name)
            for f in df.schema.fields
        ]
    )


def barrier_phone(phone: Column) -> Column:
    """The phone as the masked view shows it; NULL shows as a mask."""
    return F.when(
        F.length(phone) >= 4, F.concat(F.lit("***-***-"), F.substring(phone, -4, 4))
    ).otherwise(F.lit(NO_PHONE))


def barrier_email(email: Column) -> Column:
    """The email as the masked view shows it; NULL shows as a mask."""
    parts = F.split(email, "@")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(
        email.contains("@"), F.concat(F.substring(first, 1, 1), F.lit("***@"), second)
    ).otherwise(F.lit(NO_EMAIL))


def masked_view(df: DataFrame, phone: str = "phone", email: str = "email") -> DataFrame:
    """The view a reader gets in place of a table with a phone and an email column."""
    return df.withColumns({phone: barrier_phone(F.col(phone)), email: barrier_email(F.col(email))})


def value_profile(df: DataFrame, table: str) -> DataFrame:
    """Per string column, the share of values that look like an email or a phone.

    One pass over the table; unlabelled columns with a share above zero are
    candidates for masking.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    stats = []
    for i, name in enumerate(names):
        v = F.col(f"`{name}`")
        stats += [
            F.count(v).alias(f"n{i}"),
            F.count_if(is_email(v)).alias(f"e{i}"),
            F.count_if(is_phone(v)).alias(f"p{i}"),
        ]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"), F.col(f"n{i}").alias("n_values"),
                F.col(f"e{i}").alias("n_emails"), F.col(f"p{i}").alias("n_phones"),
            )
            for i, name in enumerate(names)
        ]
    )
    rows = df.agg(*stats).select(F.explode(entries).alias("r"))
    per_value = F.greatest(F.col("r.n_values"), F.lit(1))
    return rows.select(
        F.lit(table).alias("table_name"), "r.column_name", "r.n_values",
        (F.col("r.n_emails") / per_value).alias("email_share"),
        (F.col("r.n_phones") / per_value).alias("phone_share"),
    )


def register_sql_functions(spark) -> None:
    """Give SQL users the masks as SQL functions, without any Python per row."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_email(v STRING) RETURNS STRING RETURN "
        "CASE WHEN v IS NULL THEN NULL WHEN size(split(v, '@')) <> 2 THEN '***@masked.com' "
        "WHEN length(split(v, '@')[0]) > 2 THEN concat(left(v, 1), '***', "
        "right(split(v, '@')[0], 1), '@', split(v, '@')[1]) "
        "ELSE concat('***@', split(v, '@')[1]) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_phone(v STRING) RETURNS STRING RETURN "
        "CASE WHEN v IS NULL THEN NULL "
        "WHEN length(regexp_replace(v, '[^0-9]', '')) >= 4 "
        "THEN concat('***-***-', right(regexp_replace(v, '[^0-9]', ''), 4)) "
        "ELSE '***-***-****' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_secret(v STRING) RETURNS STRING RETURN "
        "CASE WHEN v IS NOT NULL THEN '[REDACTED_SENSITIVE]' END"
    )
