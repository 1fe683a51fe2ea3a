"""Table discovery: row counts, schemas, measured keys and inclusion between tables."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table; Parquet answers from its footers, reading no column."""
    return _union(
        [
            df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, df in tables.items()
        ]
    )


def catalog_estimate(spark: SparkSession, table: str) -> int | None:
    """The row estimate of a catalog table, as `ANALYZE TABLE` last left it."""
    facts = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Statistics'").first()
    if facts is None or "rows" not in facts["data_type"]:
        return None
    return int(facts["data_type"].split(",")[-1].split("rows")[0])


def list_tables(
    tables: Mapping[str, DataFrame], descriptions: Mapping[str, str], grants: DataFrame
) -> DataFrame:
    """The given tables: description (empty where none is told), how many roles may read it, rows."""
    spark = grants.sparkSession
    told = spark.createDataFrame(list(descriptions.items()), "table_name string, description string")
    readers = (
        grants.filter("privilege = 'read'").groupBy("table_name")
        .agg(F.count_distinct("role").alias("n_readers"))
    )
    listed = table_rows(tables).join(readers, "table_name", "left").join(told, "table_name", "left")
    return listed.select(
        "table_name", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("n_readers", F.lit(0)).alias("n_readers"), "n_rows",
    )


#: Columns of a composite key, at most.
KEY_PARTS = 2
#: How far an estimated count of distinct values may lie below the rows of a key. Its error is 2 %.
_NEAR = 0.85
#: Tables of more rows are first searched for repeats among one in so many values, then among one in fewer.
_SLICED, _SLICES = 100_000, (64, 8)
#: Types that are no part of a composite key: measures, flags and contents.
_NO_PART = ("double", "float", "boolean", "binary", "array", "map", "struct")


def describe_table(df: DataFrame, table: str) -> DataFrame:
    """One row per column: position, name, type, notnull, default and key flag; see `describe_tables`."""
    return describe_tables({table: df})


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of each table: position, name, type, notnull, default and key flag.

    Parquet declares neither keys nor NOT NULL, so both are measured. A column that is a key by
    itself is flagged; in a table without one, the columns of its first composite key.
    """
    facts, keys = unique_sets(tables)
    rows = []
    for table, df in tables.items():
        own = [k for t, k in keys if t == table]
        flagged = {c for k in own if len(k) == 1 for c in k} or set(own[0] if own else ())
        for i, f in enumerate(df.schema.fields, 1):
            n_rows, n_nulls, _ = facts[table, (f.name,)]
            rows.append((table, i, f.name, f.dataType.simpleString(), not f.nullable or n_nulls == 0, "", f.name in flagged))
    return _session(tables).createDataFrame(
        rows, "table_name string, cid int, name string, type string, notnull boolean, default_value string, is_primary_key boolean"
    )


def composite_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, columns, n_rows): every smallest set of two or more columns, up to KEY_PARTS, that is unique."""
    facts, keys = unique_sets(tables)
    rows = [(t, ",".join(k), facts[t, k][0]) for t, k in keys if len(k) > 1]
    return _session(tables).createDataFrame(rows, "table_name string, columns string, n_rows long")


def unique_sets(tables: Mapping[str, DataFrame], most: int = KEY_PARTS) -> tuple[dict, list[tuple[str, tuple[str, ...]]]]:
    """((table, columns) -> (rows, rows with a null, distinct values), and the smallest unique sets in column order).

    Level by level: a set is looked at only if no part of it is unique by itself. A sketch of
    each set, all in one scan of the table, drops what is far from unique. A value met twice tells
    for certain that a set is no key, and all rows of a value have one digest; so digests of a
    slice of the values, with all their rows, drop most others for a fraction of the shuffle.
    What is left, no repeat being known, is counted exactly over all rows in one shuffle of digests.
    Each is a few numbers for each set of columns.
    """
    facts: dict = {}
    keys: list[tuple[str, tuple[str, ...]]] = []
    for size in range(1, most + 1):
        wanted = {t: _sets(df, t, size, facts, keys) for t, df in tables.items()}
        seen = _estimates({t: tables[t] for t in tables if wanted[t]}, wanted)
        facts |= seen
        near = {t: [k for k in ks if (t, k) in seen and seen[t, k][1] == 0 and seen[t, k][2] >= _NEAR * seen[t, k][0]] for t, ks in wanted.items()}
        for share in _SLICES:
            large = {t: [k for k in ks if facts[t, k][0] > _SLICED] for t, ks in near.items()}
            repeated = {k for k, (n, _, distinct) in _counted(tables, large, share).items() if distinct < n}
            near = {t: [k for k in ks if (t, k) not in repeated] for t, ks in near.items()}
        facts |= _counted(tables, near)
        keys += [(t, k) for t, ks in near.items() for k in ks if facts[t, k][2] == facts[t, k][0]]
    return facts, keys


def _sets(df: DataFrame, table: str, size: int, facts: dict, keys: list) -> list[tuple[str, ...]]:
    if size == 1:
        return [(c,) for c in df.columns]
    unique = [set(k) for t, k in keys if t == table]
    parts = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(_NO_PART) and facts[table, (f.name,)][1] == 0]

    def possible(columns: tuple[str, ...]) -> bool:
        values = 1.0
        for c in columns:
            values *= facts[table, (c,)][2] * 1.1
        return values >= facts[table, columns[:1]][0] and not any(k <= set(columns) for k in unique)

    return [k for k in combinations(parts, size) if possible(k)]


def _whole(columns: Sequence[str]) -> Column:
    """Whether no part is null."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def _value(df: DataFrame, column: str) -> Column:
    """A column as something that can be hashed."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{column}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{column}`")


def _estimates(tables: Mapping[str, DataFrame], sets: Mapping[str, Sequence[tuple[str, ...]]]) -> dict:
    """(rows, rows with a null, distinct values by a sketch) of each set; a row for each table."""
    parts = []
    for t, df in tables.items():
        cells = [
            F.struct(
                F.count_if(~_whole(k)).alias("n_nulls"),
                F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(_whole(k), F.xxhash64(*(_value(df, c) for c in k))), F.lit(12))), F.lit(0)).alias("n_distinct"),
            )
            for k in sets[t]
        ]
        parts.append(df.agg(F.count("*").alias("n_rows"), F.array(*cells).alias("sets")).select(F.lit(t).alias("table_name"), "n_rows", "sets"))
    found = _union(parts).collect() if parts else []
    return {
        (r["table_name"], k): (r["n_rows"], x["n_nulls"], x["n_distinct"])
        for r in found
        for k, x in zip(sets[r["table_name"]], r["sets"], strict=True)
    }


def _counted(tables: Mapping[str, DataFrame], sets: Mapping[str, Sequence[tuple[str, ...]]], share: int = 1) -> dict:
    """(table, columns) -> (rows, rows with a null, distinct values); see `_exact`."""
    numbered = [(t, k) for t, ks in sets.items() for k in ks]
    exact = _exact(tables, sets, share)
    return {numbered[r["at"]]: (r["n_rows"], r["n_nulls"], r["n_distinct"]) for r in (exact.collect() if exact is not None else [])}


def _exact(tables: Mapping[str, DataFrame], sets: Mapping[str, Sequence[tuple[str, ...]]], share: int = 1) -> DataFrame | None:
    """(at, n_rows, n_nulls, n_distinct) of the sets, numbered in order of `sets`.

    One scan of each table and one shuffle of (set, 128-bit digest); no value travels, and equal
    ones are summed before the shuffle. With a `share`, all this of the rows whose value has a digest
    that it divides, without nulls.
    """
    parts, first = [], 0
    for t, ks in sets.items():
        cells = [
            F.struct(F.lit(i).alias("at"), *(F.when(_whole(k), F.xxhash64(F.lit(salt), *(_value(tables[t], c) for c in k))).alias(f"h{salt}") for salt in (1, 2)))
            for i, k in enumerate(ks, first)
        ]
        first += len(ks)
        if cells:
            # rows of no slice go before anything is made of them
            inside = [c["h1"] % share == 0 for c in cells] if share > 1 else [F.lit(True)]
            read = tables[t].filter(reduce(lambda a, b: a | b, inside))
            parts.append(read.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    if not parts:
        return None
    digests = _union(parts) if share == 1 else _union(parts).filter(F.col("h1") % share == 0)
    counted = digests.groupBy("at", "h1", "h2").agg(F.count("*").alias("n"))
    return counted.groupBy("at").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("h1").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count("h1").alias("n_distinct"),
    )


def _session(tables: Mapping[str, DataFrame]) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def key_profile(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """Per candidate column: rows, NULLs, distinct values, and whether it is a key; see `key_profiles`."""
    return key_profiles({table: df}, {table: columns})


def key_profiles(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per column of each table: rows, NULLs, distinct values, and whether it is a key.

    All columns of a table are counted exactly in one scan and one shuffle of digests.
    """
    asked = {t: [(c,) for c in (columns[t] if columns else df.columns)] for t, df in tables.items()}
    listed = _session(tables).createDataFrame(
        [(t, i, k[0]) for i, (t, k) in enumerate((t, k) for t, ks in asked.items() for k in ks)], "table_name string, at int, column_name string"
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = listed.join(_exact(tables, asked), "at", "left").select("table_name", "column_name", *map(zero, ("n_rows", "n_nulls", "n_distinct")))
    return out.withColumn("is_key", (F.col("n_nulls") == 0) & (F.col("n_distinct") == F.col("n_rows")))


def candidate_references(
    columns: Mapping[str, Sequence[tuple[str, str]]],
) -> list[tuple[str, str, str, str]]:
    """References worth checking, from names and types alone.

    A column may refer to one of another table if both have the same type and the same
    name, less a prefix of one or two letters, and that name ends in `key` or `id`.
    """
    named = [
        (t, c, kind, base)
        for t, cs in columns.items()
        for c, kind in cs
        if (base := re.sub(r"^[a-z]{1,2}_", "", c)).endswith(("key", "id"))
    ]
    return [
        (t, c, u, d)
        for t, c, kind, base in named
        for u, d, other, name in named
        if t != u and (kind, base) == (other, name)
    ]


def value_references(
    tables: Mapping[str, DataFrame], children: Sequence[tuple[str, str]], keys: Collection[tuple[str, str]]
) -> list[tuple[str, str, str, str]]:
    """References that the values alone allow: from `children` to the key columns `keys` of other tables.

    One theta sketch of each column, of a fixed size and all in one job, tells which pairs surely
    do not hold: a value of the child below both sketches' thresholds that the parent's sketch lacks is
    no value of the parent. So no pair that holds is dropped; what is left is for `fk_profile` to count.
    """
    columns = list(dict.fromkeys([*children, *keys]))
    kinds = {(t, c): _family(tables[t].schema[c].dataType.simpleString()) for t, c in columns}
    columns = [x for x in columns if kinds[x]]
    parts = []
    for t in dict.fromkeys(t for t, _ in columns):
        own = [c for u, c in columns if u == t]
        sketches = [F.struct(F.lit(c).alias("c"), F.theta_sketch_agg(F.col(f"`{c}`").cast(kinds[t, c])).alias("sketch")) for c in own]
        parts.append(tables[t].agg(F.array(*sketches).alias("xs")).select(F.lit(t).alias("t"), F.explode("xs").alias("x")).select("t", "x.*"))
    if not parts:
        return []
    kept = _union(parts).collect()  # a few kilobytes for each column
    held = _session(tables).createDataFrame([(r["t"], r["c"], kinds[r["t"], r["c"]], r["sketch"]) for r in kept], "t string, c string, kind string, sketch binary")
    asked = _session(tables).createDataFrame([*children], "t string, c string")
    named = _session(tables).createDataFrame([*keys], "u string, d string")
    child = held.join(asked, ["t", "c"])
    parent = held.select(F.col("t").alias("u"), F.col("c").alias("d"), "kind", F.col("sketch").alias("other")).join(named, ["u", "d"])
    pairs = child.join(parent, "kind").filter("t <> u")
    lacking = F.theta_sketch_estimate(F.theta_difference("sketch", "other"))
    return sorted((r["t"], r["c"], r["u"], r["d"]) for r in pairs.filter((F.theta_sketch_estimate("sketch") > 0) & (lacking == 0)).select("t", "c", "u", "d").collect())


def _family(kind: str) -> str | None:
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "bigint"
    return "string" if kind == "string" else None


def fk_profile(
    tables: Mapping[str, DataFrame],
    candidates: Sequence[tuple[str, str, str, str]],
    allowed: Collection[str],
) -> DataFrame:
    """Which `(table, column, references_table, references_column)` hold as foreign keys.

    A reference holds if no child value lacks a parent. Child values are made
    distinct before the join, so repeats of one value do not travel. References to
    tables outside `allowed` are neither checked nor shown.
    """
    checks = []
    for child, column, parent, target in candidates:
        if parent not in allowed:
            continue
        wanted = tables[child].select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct()
        had = tables[parent].select(F.col(target).alias("v"))
        orphans = wanted.join(had, "v", "left_anti").agg(F.count("*").alias("n_orphans"))
        checks.append(
            orphans.select(
                F.lit(child).alias("table_name"), F.lit(column).alias("column_name"),
                F.lit(parent).alias("references_table"), F.lit(target).alias("references_column"),
                "n_orphans", (F.col("n_orphans") == 0).alias("is_foreign_key"),
            )
        )
    return _union(checks)


def composite_references(
    tables: Mapping[str, DataFrame], candidates: Sequence[tuple[str, Sequence[str], str, Sequence[str]]]
) -> DataFrame:
    """Which `(table, columns, references_table, references_columns)` of several columns hold, columns in the key's order.

    A child row with a null part refers to nothing, as it does for a declared reference.
    """
    checks = []
    for child, columns, parent, targets in candidates:
        names = [f"v{i}" for i in range(len(columns))]
        wanted = tables[child].select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True))).dropna().distinct()
        had = tables[parent].select(*(F.col(f"`{c}`").alias(n) for c, n in zip(targets, names, strict=True)))
        orphans = wanted.join(had, names, "left_anti").agg(F.count("*").alias("n_orphans"))
        checks.append(
            orphans.select(
                F.lit(child).alias("table_name"), F.lit(",".join(columns)).alias("column_names"), F.lit(parent).alias("references_table"),
                F.lit(",".join(targets)).alias("references_columns"), "n_orphans", (F.col("n_orphans") == 0).alias("is_foreign_key"),
            )
        )
    return _union(checks)
