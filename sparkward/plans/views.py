"""Sessions scoped to a role, and the reads made in them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sparkward.functions.compat import interval_text
from sparkward.functions.masking import mask_frame
from sparkward.operators.bounded import MAX_BYTES, MAX_ROWS, clamp, over_bytes, row_bytes
from sparkward.operators.policy import row_filter
from sparkward.plans.checked import inspect, limit_at
from sparkward.plans.dialect import as_spark, by_types

Loader = Callable[[SparkSession], DataFrame]

class Refused(PermissionError):
    """A read that is not run. `stage` says what refused it, as the audit log names it."""

    def __init__(self, reason: str, stage: str = "AST"):
        super().__init__(reason)
        self.stage = stage


@dataclass(frozen=True)
class Tenancy:
    """Rows of `table` belong to the tenant named in `column`."""

    column: str
    tenant: str | None


@dataclass(frozen=True)
class GovernedSession:
    session: SparkSession
    visible: frozenset[str]
    #: Tables that exist for some role. Reading one that is not visible is the role's fault, not the text's.
    known: frozenset[str] = frozenset()

    def table(self, name: str) -> DataFrame:
        clean = name.strip().lower()
        if clean not in self.visible:
            raise Refused(f"table '{clean}' is not readable here", "ROLE" if clean in self.known else "AST")
        return self.session.table(clean)

    def sql(self, text: str) -> DataFrame:
        """The read as Spark plans it: scoped and checked, but neither masked by value
        nor limited. For jobs that go on to compute with the result."""
        return _read(self, _one_statement(text), "")


def governed_session(
    spark: SparkSession,
    loaders: Mapping[str, Loader],
    readable: Iterable[str],
    *,
    masked: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
    restricted: Iterable[str] = (),
    tenancy: Mapping[str, Tenancy] | None = None,
) -> GovernedSession:
    """A session whose only tables are the role's views.

    A masked table is registered under its own name, so a user's functions only ever
    see masked values. Restricted tables are not registered for any role. A tenant's
    rows are observed on their way to the user's SQL: Spark moves no predicate below
    what counts rows, so none of the user's ever sees a hidden row, and nothing is copied.
    """
    session = spark.newSession()
    _copy_settings(spark, session)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    blocked = {r.lower() for r in restricted}
    names = {r.lower() for r in readable} & {n.lower() for n in loaders} - blocked
    for name in sorted(names):
        df = loaders[name](session)
        held = (tenancy or {}).get(name)
        if held is not None and held.tenant:
            own = row_filter(df, held.column, held.tenant)
            df = own.observe(f"tenant-{name}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))
        mask = (masked or {}).get(name)
        (mask(df) if mask else df).createOrReplaceTempView(name)
    return GovernedSession(session, frozenset(names), frozenset({n.lower() for n in loaders} - blocked))


def _copy_settings(source: SparkSession, target: SparkSession) -> None:
    for key, value in source.conf.getAll.items():
        if key.startswith("spark.sql.") and target.conf.isModifiable(key):
            target.conf.set(key, value)


def readable_tables(grants: DataFrame, role: str) -> list[str]:
    """The tables a role may read; one row per table of the catalog at most."""
    rows = grants.filter((F.col("role") == role) & (F.col("privilege") == "read"))
    return [r["table_name"] for r in rows.select("table_name").distinct().collect()]


def governed_query(governed: GovernedSession, text: str, limit: int | None = None) -> DataFrame:
    """One read end to end: scoped to the role's views, clamped and masked.

    Spark's own parser is the statement check: text that is not one query does not
    parse inside the brackets.
    """
    most = MAX_ROWS if limit is None else clamp(limit)
    return mask_frame(_read(governed, _one_statement(text), f" LIMIT {most}"))


@dataclass(frozen=True)
class GovernedResult:
    """What a read returned: the rows that fit, in order, the tables it read, and its measures."""

    rows: DataFrame
    tables: list[str]
    metrics: dict

    def metrics_row(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([tuple(self.metrics.values())], _METRICS)


_METRICS = "row_count long, payload_bytes long, truncated boolean, truncation_reason string"


def governed_result(
    governed: GovernedSession, text: str, limit: int | None = None, max_bytes: int = MAX_BYTES
) -> GovernedResult:
    """A read with its byte budget kept and its measures taken, in one run.

    The clamped result is one partition of at most the row limit, so its own order can be
    numbered. The rows that fit come to the caller, row limit and byte budget at most; what is
    measured is observed on the very rows they are taken from.
    """
    read = governed_query(governed, text, limit)
    at, size, upto = _free(read.columns, "at", "bytes", "upto")
    numbered = read.coalesce(1).withColumn(at, F.monotonically_increasing_id())
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    sized = numbered.withColumn(size, row_bytes(read)).withColumn(upto, F.sum(size).over(before))
    fits, seen = F.col(upto) <= max_bytes, Observation()
    observed = sized.observe(
        seen,
        F.count_if(fits).alias("row_count"),
        F.coalesce(F.max(F.when(fits, F.col(upto))), F.lit(0)).alias("payload_bytes"),
        F.coalesce(F.max(upto) > max_bytes, F.lit(False)).alias("truncated"),
    )
    kept = observed.filter(fits).orderBy(at).select(*(F.col(f"`{c}`") for c in read.columns)).collect()
    metrics = {k: seen.get[k] for k in ("row_count", "payload_bytes", "truncated")}
    metrics["truncation_reason"] = over_bytes(max_bytes) if metrics["truncated"] else ""
    return GovernedResult(governed.session.createDataFrame(kept, read.schema), tables_accessed(read), metrics)


def _free(taken: Iterable[str], *names: str) -> list[str]:
    """Names like these that none of the taken ones is."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def tables_accessed(df: DataFrame) -> list[str]:
    """The views a plan reads, sorted."""
    return sorted(inspect(df).views)


def _one_statement(text: str) -> str:
    body = text.strip()
    body = body[:-1].rstrip() if body.endswith(";") else body
    if not body:
        raise Refused("empty SQL text")
    return body


def _with_limit(session: SparkSession, body: str) -> str:
    """The text with the most rows in place of a limit of 0 or less."""
    found = limit_at(session, body)
    if found is None or found[0] > 0:
        return body
    return f"{body[: found[1]]}{MAX_ROWS}{body[found[2] + 1 :]}"


def _read(governed: GovernedSession, body: str, tail: str) -> DataFrame:
    """The user's query as Spark runs it: functions as Postgres has them, checked, intervals as text."""
    session = governed.session
    try:
        body = as_spark(session, body)
        if tail:
            body = _with_limit(session, body)
        whole = lambda text: f"SELECT * FROM (\n{text}\n) q{tail}"
        text = by_types(session, whole(body), lambda t: session.sql(t)._jdf.queryExecution().analyzed())
        df = session.sql(text)
    except ParseException as e:
        raise Refused("only a single SELECT is permitted") from e
    except AnalysisException as e:
        raise Refused(str(e).splitlines()[0], _stage(governed, e)) from e
    except ValueError as e:
        raise Refused(str(e)) from e
    _check(governed, df)
    spans = [f.name for f in df.schema.fields if f.dataType.typeName() == "interval"]
    return df.withColumns({c: interval_text(F.col(f"`{c}`")) for c in spans}) if spans else df


def _stage(governed: GovernedSession, e: AnalysisException) -> str:
    if e.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
        return "AST"
    name = (e.getMessageParameters() or {}).get("relationName", "").strip("`").lower()
    return "ROLE" if name in governed.known else "AST"


def _check(governed: GovernedSession, df: DataFrame) -> None:
    seen = inspect(df)
    if seen.calls:
        raise Refused(f"functions that reach outside the query are not permitted: {sorted(seen.calls)}")
    outside = seen.views - governed.visible
    if outside or seen.relations:
        raise Refused(f"access denied to table(s): {sorted(outside) or 'of the catalog'}")
