"""Redaction of credentials and personal data inside free text.

All of it is `regexp_*` on whole texts, so it stays on the JVM. A cheap `contains`
test in front keeps the regex off texts that cannot match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkward.functions.masking import map_strings

# The credential shapes to redact and the keys that announce one.
# (?U) gives \w, \d, \s and \b their Unicode meaning.
CREDENTIAL_KEYS = ("password", "passwd", "pwd", "secret")
URI_PASSWORD = r"(?U)(://[^/:\s?#]+:)([^@/\s?#]+)(@)"
KEY_VALUE = r"(?iU)\b({keys})\s*=\s*('[^']*'|\"[^\"]*\"|[^\s;,]+)"
SQL_PASSWORD = r"(?iU)\bPASSWORD\s+'[^']*'"

# The local part starts where a run of its characters starts, or where the match
# before ended, and is taken whole (++): a long run without '@' is read once.
EMAIL_IN_TEXT = (
    r"(?:\G|(?<![\p{L}\p{N}_.\-]))[\p{L}\p{N}_.\-]++@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+"
)
# The same emails with first and last character of a local part longer than two,
# and the domain, as groups.
EMAIL_PARTS_IN_TEXT = (
    r"(?:\G|(?<![\p{L}\p{N}_.\-]))"
    r"(?:([\p{L}\p{N}_.\-])[\p{L}\p{N}_.\-]+([\p{L}\p{N}_.\-])|[\p{L}\p{N}_.\-]{1,2})"
    r"@([\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+)"
)
# A phone does not start inside a longer run of digits, nor end in one.
PHONE_IN_TEXT = (
    r"(?<!\p{Nd})(?:\+?\p{Nd}{1,3}[- ]?)?\(?\p{Nd}{3}\)?[- ]?\p{Nd}{3}[- ]?(\p{Nd}{4})\b"
)


def key_value_pattern(keys: Sequence[str] = CREDENTIAL_KEYS) -> str:
    return KEY_VALUE.replace("{keys}", "|".join(keys))


def scrub_secrets(text: Column, keys: Sequence[str] = CREDENTIAL_KEYS) -> Column:
    """URI passwords, then `key = value` pairs, then SQL `PASSWORD '...'` literals."""
    out = F.when(
        text.contains("://"), F.regexp_replace(text, URI_PASSWORD, "$1***$3")
    ).otherwise(text)
    out = F.when(
        out.contains("="), F.regexp_replace(out, key_value_pattern(keys), "$1=***")
    ).otherwise(out)
    return F.when(
        out.contains("'"), F.regexp_replace(out, SQL_PASSWORD, "PASSWORD '***'")
    ).otherwise(out)


def scrub_events(df: DataFrame, out: str = "line") -> DataFrame:
    """Each event as one scrubbed JSON line, nested fields included."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.select(scrub_secrets(line).alias(out))


def scrub_leaves(df: DataFrame) -> DataFrame:
    """Scrub every string of every field, so that what is written stays valid JSON."""
    return df.select(
        *[
            map_strings(F.col(f"`{f.name}`"), f.dataType, f.name, lambda v, _: scrub_secrets(v))
            .alias(f.name)
            for f in df.schema.fields
        ]
    )


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def text_findings(
    df: DataFrame, key: str, text: str, keys: Sequence[str] = CREDENTIAL_KEYS
) -> DataFrame:
    """One row per email, phone or credential in a text: key, class, position, value."""
    body = F.col(text)
    none = F.array().cast("array<string>")
    by_class = {
        "email": F.when(body.contains("@"), _matches(body, EMAIL_IN_TEXT)).otherwise(none),
        "phone": F.when(body.rlike(r"\p{Nd}{4}"), _matches(body, PHONE_IN_TEXT)).otherwise(none),
        "credential": F.when(body.contains("="), _matches(body, key_value_pattern(keys)))
        .otherwise(none),
        "uri_password": F.when(body.contains("://"), _matches(body, URI_PASSWORD))
        .otherwise(none),
    }
    tagged = [_tagged(cls, found) for cls, found in by_class.items()]
    return df.select(F.col(key), F.explode(F.concat(*tagged)).alias("f")).select(
        key, "f.class", "f.pos", "f.value"
    )


def _tagged(cls: str, found: Column) -> Column:
    return F.transform(
        found,
        lambda v, i: F.struct(F.lit(cls).alias("class"), i.alias("pos"), v.alias("value")),
    )


def redact_text(text: Column, keys: Sequence[str] = CREDENTIAL_KEYS) -> Column:
    """The text with every finding replaced by its masked form."""
    out = scrub_secrets(text, keys)
    # Groups that took no part in a match insert nothing: a short local part
    # leaves only the stars.
    masked = F.regexp_replace(out, EMAIL_PARTS_IN_TEXT, "$1***$2@$3")
    out = F.when(out.contains("@"), masked).otherwise(out)
    return F.when(
        out.rlike(r"\p{Nd}{4}"), F.regexp_replace(out, PHONE_IN_TEXT, "***-***-$1")
    ).otherwise(out)
