"""Roles, grants and capabilities as tables, and the checks made against them.

A policy has one row per role: role, description, tables_read, tables_write,
can_propose, can_approve, management. Joins against it carry no broadcast hint: a
small policy is broadcast by its measured size, a large one is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY_SCHEMA = (
    "role string, description string, tables_read array<string>, tables_write array<string>, "
    "can_propose boolean, can_approve boolean, management boolean"
)
CAPABILITIES = ("can_propose", "can_approve", "management")
FALLBACK_ROLE = "reader"


def fallback_policy(spark: SparkSession, tables_read: Sequence[str]) -> DataFrame:
    """The least-privilege policy that holds when the given one is invalid."""
    row = (
        FALLBACK_ROLE, "Holds while no valid policy is given: may query the open tables.", [t.lower() for t in tables_read], [],
        False, False, False,
    )
    return spark.createDataFrame([row], POLICY_SCHEMA)


def grants_table(policy: DataFrame) -> DataFrame:
    """One row per (role, table, privilege), names in lower case; no list, no rows."""

    def one(column: str, privilege: str) -> DataFrame:
        return policy.select(
            "role", F.explode(F.array_distinct(F.transform(column, F.lower))).alias("table_name")
        ).withColumn("privilege", F.lit(privilege))

    return one("tables_read", "read").unionByName(one("tables_write", "write"))


def role_capabilities(policy: DataFrame) -> DataFrame:
    """The three flags per role; an absent flag is false."""
    return policy.select(
        "role", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in CAPABILITIES]
    )


def resolve_role(
    requests: DataFrame, policy: DataFrame, default_role: str, role: str = "role"
) -> DataFrame:
    """Adds `active_role`: the requested role if the policy knows it, else the default."""
    known = policy.select(F.col("role").alias("_known")).distinct()
    asked = F.lower(F.trim(F.col(role)))
    return requests.join(known, asked == F.col("_known"), "left").withColumn(
        "active_role", F.coalesce("_known", F.lit(default_role))
    ).drop("_known")


def role_spec(
    requests: DataFrame, policy: DataFrame, fallback_tables: Sequence[str]
) -> DataFrame:
    """Adds what the policy grants the role; a role nobody defined gets the fallback."""
    spec = policy.select(
        "role", *[F.transform(c, F.lower).alias(c) for c in ("tables_read", "tables_write")],
        *CAPABILITIES, F.lit(True).alias("_known"),
    )
    least = {
        "tables_read": F.array(*[F.lit(t.lower()) for t in fallback_tables]),
        "tables_write": F.array().cast("array<string>"),
    }
    cells = [
        F.when(F.col("_known"), F.col(c)).otherwise(least.get(c, F.lit(False))).alias(c)
        for c in spec.columns if c not in ("role", "_known")
    ]
    return requests.join(spec, "role", "left").select(*requests.columns, *cells)


def policy_problems(policy: DataFrame, default_role: str) -> DataFrame:
    """One row: what is wrong with the policy, and whether to degrade to the fallback."""
    checks = policy.agg(
        F.count("*").alias("n_roles"),
        F.coalesce(F.bool_or(F.col("role") == default_role), F.lit(False)).alias("has_default"),
        F.count_if(F.col("role").isNull()).alias("n_unnamed"),
    )
    degraded = (F.col("n_roles") == 0) | ~F.col("has_default") | (F.col("n_unnamed") > 0)
    reason = (
        F.when(F.col("n_roles") == 0, "no roles defined")
        .when(~F.col("has_default"), "default role not in roles")
        .when(F.col("n_unnamed") > 0, "role without a name")
        .otherwise("ok")
    )
    return checks.select("*", degraded.alias("degraded"), reason.alias("reason"))


def validated_policy(
    policy: DataFrame, default_role: str, fallback_tables: Sequence[str]
) -> DataFrame:
    """The policy if it is valid, else the fallback. Reads one row to decide."""
    degraded = policy_problems(policy, default_role).first()["degraded"]
    return fallback_policy(policy.sparkSession, fallback_tables) if degraded else policy


def denied_tables(
    requests: DataFrame,
    grants: DataFrame,
    privilege: str,
    request: str = "request_id",
    tables: str = "tables_accessed",
) -> DataFrame:
    """Requests that touch tables their role was not granted, with those tables.

    One join per request, on the role: a role's grants, at most the catalog's
    tables, travel as one row, so requests are neither exploded nor regrouped.
    """
    held = (
        grants.filter(F.col("privilege") == privilege)
        .groupBy("role").agg(F.collect_set("table_name").alias("_held"))
    )
    touched = F.array_distinct(F.transform(tables, F.lower))
    left_out = F.array_except(touched, F.coalesce("_held", F.array().cast("array<string>")))
    denied = requests.join(held, "role", "left").select(
        request, "role", F.array_sort(left_out).alias("denied")
    )
    return denied.filter(F.size("denied") > 0)


def unlisted_tables(
    requests: DataFrame, allowlist: Sequence[str], request: str, tables: str
) -> DataFrame:
    """Requests that name tables outside the allowlist of every role, with those tables."""
    listed = F.array(*[F.lit(t.lower()) for t in allowlist])
    left_out = F.array_except(F.array_distinct(F.transform(tables, F.lower)), listed)
    named = requests.select(request, F.array_sort(left_out).alias("denied"))
    return named.filter(F.size("denied") > 0)


def capability_gate(requests: DataFrame, policy: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds `verdict`: may this role propose, apply or reset? Reads are open."""
    gated = requests.join(role_capabilities(policy), "role", "left")

    def needs(flag: str) -> Column:
        return F.when(F.coalesce(F.col(flag), F.lit(False)), "ALLOWED").otherwise("FORBIDDEN_ROLE")

    verdict = (
        F.when(F.col(kind) == "propose", needs("can_propose"))
        .when(F.col(kind) == "apply", needs("can_approve"))
        .when(F.col(kind) == "reset", needs("management"))
        .otherwise("ALLOWED")
    )
    return gated.select(*requests.columns, verdict.alias("verdict"))


def restricted_filter(entries: DataFrame, allowed: DataFrame, table: str) -> DataFrame:
    """Catalog entries whose table is in the allowlist (one column `table_name`)."""
    return entries.join(
        allowed.select(F.col("table_name").alias(table)).distinct(), table, "left_semi"
    )


def row_filter(
    df: DataFrame, tenant_column: str, tenant: str | None, passthrough: bool = False
) -> DataFrame:
    """Rows the tenant may see. No tenant, or an empty one, sees all.

    With `passthrough` there is no tenant column to compare with, and a set tenant
    sees no rows.
    """
    if not tenant:
        return df
    if passthrough:
        return df.filter(F.lit(False))
    return df.filter(F.col(tenant_column).cast("string") == tenant)


def grant_matrix(grants: DataFrame, restricted: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Table by role; each cell lists the privileges. Restricted tables have none.

    Write carries read with it, as the provisioned grant does.
    """
    open_grants = grants.join(
        restricted.select("table_name").distinct(), "table_name", "left_anti"
    ).select(
        "role", "table_name",
        F.explode(
            F.when(F.col("privilege") == "write",
                   F.array(*map(F.lit, ("delete", "insert", "select", "update"))))
            .otherwise(F.array(F.lit("select")))
        ).alias("privilege"),
    )
    cells = open_grants.groupBy("table_name").pivot("role", list(roles)).agg(
        F.concat_ws(",", F.array_sort(F.collect_set("privilege")))
    )
    return cells.select("table_name", *[F.coalesce(F.col(r), F.lit("")).alias(r) for r in roles])
