"""Analytics over the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions a governed query may call.
SAFE_FUNCTIONS = (
    "count", "sum", "avg", "min", "max", "array_agg", "string_agg", "every", "bool_and", "bool_or",
    "upper", "lower", "trim", "ltrim", "rtrim", "length", "char_length", "concat", "coalesce",
    "nullif", "replace", "substring", "split_part", "left", "right", "position", "strpos",
    "lpad", "rpad", "repeat", "reverse", "initcap", "to_char", "encode",
    "round", "ceil", "ceiling", "floor", "abs", "mod", "power", "sqrt", "sign", "trunc", "log",
    "ln", "exp",
    "now", "current_date", "current_time", "current_timestamp", "date_part", "extract", "age",
    "date_trunc", "to_timestamp", "to_date", "make_date", "make_interval",
    "greatest", "least", "cast",
    "json_extract_path_text", "jsonb_extract_path_text", "json_array_length", "jsonb_array_length",
    "row_number", "rank", "dense_rank", "ntile", "lag", "lead", "first_value", "last_value",
    "nth_value", "percent_rank", "cume_dist",
    "typeof", "pg_typeof", "unnest", "generate_series",
)
# Functions that are refused by name, and by how their name starts.
BLOCKED_FUNCTIONS = (
    "current_setting", "set_config", "pg_sleep", "pg_cancel_backend", "pg_terminate_backend",
    "pg_reload_conf", "pg_rotate_logfile", "pg_start_backup", "pg_stop_backup", "pg_switch_wal",
    "pg_create_restore_point", "pg_current_logfile", "inet_server_addr", "inet_client_addr",
)
BLOCKED_PREFIXES = (
    "pg_read", "pg_ls", "pg_write", "pg_stat_file", "pg_execute", "lo_import", "lo_export",
    "lo_create", "dblink", "postgres_fdw",
)
# How many events a summary may show.
LAST_DEFAULT, LAST_MOST = 20, 200


def clamp_last(n: object) -> int:
    try:
        return max(1, min(int(n), LAST_MOST))
    except (TypeError, ValueError):
        return LAST_DEFAULT


def last_events(log: DataFrame, seq: str, n: object = LAST_DEFAULT, good: Column | None = None) -> DataFrame:
    """The last N lines of the log, oldest first, then without the bad ones.

    `seq` is the line order. Bad lines take a place, so fewer than N may come back.
    """
    last = log.orderBy(F.col(seq).desc()).limit(clamp_last(n))
    return (last if good is None else last.filter(good)).orderBy(seq)


def function_verdict(name: Column) -> Column:
    return (
        F.when(name.isin(*BLOCKED_FUNCTIONS), "BLOCKED_NAME")
        .when(name.rlike("^(" + "|".join(BLOCKED_PREFIXES) + ")"), "BLOCKED_PREFIX")
        .when(name.isin(*SAFE_FUNCTIONS), "ALLOWLISTED")
        .otherwise("OTHER")
    )


def function_usage(log: DataFrame, sql: str) -> DataFrame:
    """How often logged SQL calls each function, and what the lists say of it.

    Lexical: a name followed by a bracket.
    """
    called = F.regexp_extract_all(F.lower(sql), F.lit(r"([a-z_][a-z0-9_]*)\s*\("), F.lit(1))
    names = log.select(F.explode(called).alias("function_name"))
    counted = names.groupBy("function_name").agg(F.count("*").alias("n_calls"))
    return counted.withColumn("verdict", function_verdict(F.col("function_name")))


def table_access(log: DataFrame) -> DataFrame:
    """Accepted queries per table and role."""
    touched = log.filter(F.col("type") == "QUERY_ACCEPTED").select(
        "role", F.explode(F.transform("tables_accessed", F.lower)).alias("table_name")
    )
    return touched.groupBy("table_name", "role").agg(F.count("*").alias("n_queries"))


def grant_compliance(log: DataFrame, grants: DataFrame) -> DataFrame:
    """Accepted queries that read tables their role is not granted: counts per pair.

    Counted before the check, so the log is shuffled by nothing but its few pairs.
    """
    allowed = grants.filter("privilege = 'read'").select("role", "table_name").distinct()
    return table_access(log).join(allowed, ["role", "table_name"], "left_anti")


STAGES = ("CB", "RATE_LIMIT", "AST", "ROLE", "TIMEOUT", "DB")


def rejections(log: DataFrame) -> DataFrame:
    """Rejections per type and session, one column per stage."""
    rejected = log.filter(F.col("type").isin("QUERY_REJECTED", "MUTATION_REJECTED"))
    stages = [F.count_if(F.col("stage") == s).alias(s.lower()) for s in STAGES]
    return rejected.groupBy("type", "session_id").agg(
        *stages, F.count_if(F.col("stage").isNull()).alias("no_stage")
    )


def rejection_rollup(log: DataFrame) -> DataFrame:
    """Rejections by type and stage with subtotals; `level` 0 is the finest."""
    rejected = log.filter(F.col("type").isin("QUERY_REJECTED", "MUTATION_REJECTED"))
    staged = rejected.select("type", F.coalesce("stage", F.lit("NONE")).alias("stage"))
    return staged.rollup("type", "stage").agg(
        F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")
    )


def usage(log: DataFrame, bucket: str = "10 minutes") -> DataFrame:
    """Per session and time bucket: queries, rows, execution time, its exact median."""
    accepted = log.filter(F.col("type") == "QUERY_ACCEPTED")
    return accepted.groupBy(F.window("at", bucket).alias("w"), "session_id").agg(
        F.count("*").alias("n_queries"),
        F.sum("row_count").alias("n_rows"),
        F.sum(F.col("exec_ms").cast("decimal(28,6)")).cast("double").alias("exec_ms_sum"),
        F.max("exec_ms").alias("exec_ms_max"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY exec_ms)").alias("exec_ms_p50"),
    ).select(
        F.unix_micros("w.start").alias("bucket_us"), "session_id",
        "n_queries", "n_rows", "exec_ms_sum", "exec_ms_max", "exec_ms_p50",
    )
