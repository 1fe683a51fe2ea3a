"""Reviewed inserts, updates and deletes: preview, ledger, versioned apply."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"
# How long a proposal lives and what it waits for.
PROPOSAL_TTL_S = 300
AWAITING = "AWAITING_OPERATOR_APPROVAL"

PROPOSAL_SCHEMA = (
    "proposal_token string, us bigint, statement_type string, target_tables array<string>, "
    "normalized_sql string, query_plan array<string>, status string"
)


@dataclass(frozen=True)
class Mutation:
    """A change to one table. UPDATE and DELETE need a predicate."""

    kind: str
    where: Column | None = None
    values: Mapping[str, Column] = field(default_factory=dict)
    rows: DataFrame | None = None

    def __post_init__(self):
        if self.kind not in (INSERT, UPDATE, DELETE):
            raise ValueError(f"'{self.kind}' is not an INSERT, UPDATE or DELETE")
        if self.kind != INSERT and self.where is None:
            raise ValueError(f"{self.kind} without a predicate is refused")
        if self.kind == INSERT and self.rows is None:
            raise ValueError("INSERT needs rows")

    @property
    def hits(self) -> Column:
        """True where the predicate is TRUE; UNKNOWN does not count."""
        return F.coalesce(self.where, F.lit(False))

    def sql(self, table: str) -> str:
        """The statement, as the ledger keeps it."""
        if self.kind == INSERT:
            return f"INSERT INTO {table} ({', '.join(self.rows.columns)})"
        where = f" WHERE {_text(self.where)}"
        if self.kind == DELETE:
            return f"DELETE FROM {table}{where}"
        return f"UPDATE {table} SET {', '.join(f'{c} = {_text(v)}' for c, v in self.values.items())}{where}"


def _text(column: Column) -> str:
    return column._jc.toString()


def transformed(base: DataFrame, change: Mutation) -> DataFrame:
    """The table after the change."""
    if change.kind == INSERT:
        return base.unionByName(change.rows)
    if change.kind == DELETE:
        return base.filter(~change.hits)
    return base.select(
        *[
            F.when(change.hits, change.values[c]).otherwise(F.col(c)).cast(t.dataType).alias(c)
            if c in change.values else F.col(c)
            for c, t in ((f.name, f) for f in base.schema.fields)
        ]
    )


def affected(base: DataFrame, change: Mutation) -> DataFrame:
    """One row: how many rows the change touches."""
    if change.kind == INSERT:
        return change.rows.agg(F.count("*").alias("affected_rows"))
    return base.agg(F.count_if(change.hits).alias("affected_rows"))


def preview(base: DataFrame, change: Mutation) -> DataFrame:
    """The touched rows before and after, in column `side`. Nothing is executed.

    One pass over the table: the predicate says which rows differ, so the two states
    need not be compared.
    """
    if change.kind == INSERT:
        return change.rows.select(F.lit("after").alias("side"), *base.columns)
    touched = base.filter(change.hits)
    before = F.struct(F.lit("before").alias("side"), *base.columns)
    if change.kind == DELETE:
        return touched.select(F.inline(F.array(before)))
    after = F.struct(
        F.lit("after").alias("side"),
        *[
            change.values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in base.schema.fields
        ],
    )
    return touched.select(F.inline(F.array(before, after)))


def plan_lines(df: DataFrame) -> list[str]:
    """The whole plan a reviewer sees, however many columns it has."""
    conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(name)
    conf.set(name, str(1 << 30))
    try:
        return df._jdf.queryExecution().simpleString().splitlines()
    finally:
        conf.set(name, before)


def propose(base: DataFrame, change: Mutation, token: str, us: int, target_tables: list[str]) -> DataFrame:
    """One ledger row for the change: its statement, and the plan of what applying it writes."""
    targets = sorted({t.lower() for t in target_tables})
    plan = plan_lines(change.rows if change.kind == INSERT else transformed(base, change))
    row = (token, us, change.kind, targets, change.sql(targets[0]), plan, AWAITING)
    return base.sparkSession.createDataFrame([row], PROPOSAL_SCHEMA)


def record(proposals: DataFrame, ledger: str) -> None:
    proposals.write.mode("append").parquet(ledger)


def proposal_status(
    proposals: DataFrame, applied: DataFrame, now_us: int, ttl_s: int = PROPOSAL_TTL_S
) -> DataFrame:
    """Adds `state`: APPLIED once used, EXPIRED after the lifetime, else PENDING."""
    used = applied.select("proposal_token").distinct().withColumn("_used", F.lit(True))
    aged = F.lit(now_us) - F.col("us") > ttl_s * 1_000_000
    state = (
        F.when(F.col("_used"), "APPLIED").when(aged, "EXPIRED").otherwise("PENDING")
    )
    return proposals.join(used, "proposal_token", "left").withColumn("state", state).drop("_used")


def mutation_lifecycle(
    proposed: DataFrame, outcomes: DataFrame, ttl_s: int = PROPOSAL_TTL_S
) -> DataFrame:
    """Each proposal with its first outcome: latency, lifetime breach, same session.

    Both sides: proposal_token, session_id, us; outcomes also type.
    """
    # One outcome per token before the join: a token replayed often cannot skew it.
    first = outcomes.groupBy("proposal_token").agg(
        F.min(F.struct("us", "type", "session_id")).alias("o")
    )
    latency = F.col("o.us") - F.col("us")
    return proposed.join(first, "proposal_token", "left").select(
        "proposal_token",
        "session_id",
        F.coalesce("o.type", F.lit("OPEN")).alias("outcome"),
        F.coalesce(latency, F.lit(-1)).alias("latency_us"),
        F.coalesce(latency > ttl_s * 1_000_000, F.lit(False)).alias("ttl_breach"),
        F.coalesce(F.col("o.session_id") == F.col("session_id"), F.lit(False)).alias("same_session"),
    )


def _folders(spark: SparkSession, root: str) -> dict[int, tuple[str, bool]]:
    """Version to its folder and whether its write finished. `v3` holds the whole table, `v4a` only rows added to v3."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = {int(m[1]): n for n in names if (m := re.fullmatch(r"v(\d+)a?", n))}
    return {n: (f"{root}/{name}", fs.exists(path(f"{root}/{name}/_SUCCESS"))) for n, name in sorted(found.items())}


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions under `root` whose write finished, in order."""
    return [n for n, (_, done) in _folders(spark, root).items() if done]


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table at a version; the newest committed one by default."""
    done = {n: folder for n, (folder, done) in _folders(spark, root).items() if done}
    if not done:
        raise FileNotFoundError(f"no committed version under {root}")
    at = max(done) if version is None else version
    parts = [done[at]]
    while parts[-1].endswith("a"):
        at -= 1
        parts.append(done[at])
    return spark.read.parquet(*reversed(parts))


def _claim(spark: SparkSession, root: str, version: int, token: str) -> None:
    """Take a version's number for the one writer that gets it; the claim tells for which proposal."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claim-{version}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    # On a local disk Hadoop looks first and creates then, so the file system itself is asked.
    local = fs.getUri().getScheme() == "file"
    try:
        mine = jvm.java.io.File(path.toUri().getPath()).createNewFile() if local else True
        out = fs.create(path, local) if mine else None
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getSimpleName():
            raise
        out = None
    if out is None:
        raise FileExistsError(f"version {version} under {root} is another writer's")
    out.write(bytearray(token.encode()))
    out.close()


def claims(spark: SparkSession, root: str, after: int = 0) -> dict[int, str]:
    """Committed version to the token it was claimed with, of versions past `after`."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = {}
    for n in versions(spark, root):
        at = path(f"{root}/claim-{n}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if n > after and fs.exists(at):
            found[n] = spark.read.text(at.toString(), wholetext=True).agg(F.max("value")).first()[0] or ""
    return found


def write_version(df: DataFrame, root: str, base: int = 0, only_added: bool = False, token: str = "") -> int:
    """Commit version base + 1 beside the others; the one being read is never overwritten.

    The number is claimed first, by creating a file that must not be there. So of two writers that
    started from one base the second fails, whatever it writes and whenever it looked, and so does
    one that meets what a dead writer left: `clear_abandoned` removes that.
    """
    spark = df.sparkSession
    if base + 1 in _folders(spark, root):
        raise FileExistsError(f"version {base + 1} under {root} exists already")
    _claim(spark, root, base + 1, token)
    df.write.mode("errorifexists").parquet(f"{root}/v{base + 1}{'a' if only_added else ''}")
    return base + 1


def clear_abandoned(spark: SparkSession, root: str) -> list[int]:
    """Remove versions, and claims to versions, whose write never finished; only while no writer is at work."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    known, folder = _folders(spark, root), path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    claimed = {int(m[1]) for n in names if (m := re.fullmatch(r"claim-(\d+)", n))}
    gone = sorted({n for n, (_, done) in known.items() if not done} | (claimed - known.keys()))
    for n in gone:
        if n in known:
            fs.delete(path(known[n][0]), True)
        fs.delete(path(f"{root}/claim-{n}"), False)
    return gone


def apply(spark: SparkSession, root: str, change: Mutation, token: str = "") -> int:
    """Commit the table after the change as the next version. An INSERT writes only its rows.

    UPDATE and DELETE write the table anew: plain Parquet has no change in place.
    """
    base = versions(spark, root)[-1]
    before = read_version(spark, root, base)
    if change.kind == INSERT:
        return write_version(change.rows.select(*before.columns), root, base, only_added=True, token=token)
    return write_version(transformed(before, change), root, base, token=token)


APPLIED_SCHEMA = "proposal_token string, us bigint, version int"


def apply_proposal(
    spark: SparkSession, root: str, ledger: str, used: str, token: str, change: Mutation, now_us: int, can_approve: bool
) -> int:
    """Apply a recorded proposal once, within its lifetime, by someone who may approve.

    `ledger` holds what `propose` gave, `used` one row for each applied proposal. The version
    carries the token, so a run that dies between the commit and that row leaves a proposal
    that is known to be applied; one that dies before the commit leaves it usable.
    """
    if not can_approve:
        raise PermissionError("this role may not approve changes")
    pending = spark.read.schema(PROPOSAL_SCHEMA).parquet(ledger).filter(F.col("proposal_token") == token)
    spent = spark.createDataFrame([], APPLIED_SCHEMA) if not _exists(spark, used) else spark.read.schema(APPLIED_SCHEMA).parquet(used)
    last = spent.agg(F.max("version")).first()[0] or 0
    for version, claimed in claims(spark, root, last).items():
        if claimed == token:
            spark.createDataFrame([(token, now_us, version)], APPLIED_SCHEMA).write.mode("append").parquet(used)
            raise PermissionError(f"proposal '{token}' is applied")
    row = proposal_status(pending, spent.filter(F.col("proposal_token") == token), now_us).first()
    if row is None:
        raise LookupError(f"no proposal '{token}'")
    if row["state"] != "PENDING":
        raise PermissionError(f"proposal '{token}' is {row['state'].lower()}")
    if row["statement_type"] != change.kind or row["normalized_sql"] != change.sql(row["target_tables"][0]):
        raise PermissionError(f"the change is not the one proposed as '{token}'")
    version = apply(spark, root, change, token)
    spark.createDataFrame([(token, now_us, version)], APPLIED_SCHEMA).write.mode("append").parquet(used)
    return version


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
