"""Windowed enforcement over an event log, in batch.

Input rows carry a session key, `us` (epoch microseconds) and whatever a rule needs.
Every rule takes its own windows and thresholds as `Limits`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.operators.running import (
    KEY, STRETCH, Cut, Running, Sliding, flag, running, sliding,
)
from sparkward.session import written

SECOND_US = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Thresholds and windows. The defaults. `cut` says how a session is
    spread over tasks."""

    max_violations: int = 3
    violation_window_s: int = 300
    quarantine_s: int = 900
    max_queries: int = 30
    rate_window_s: int = 60
    max_compute_us: int = 15_000_000
    compute_window_s: int = 600
    cut: Cut = Cut()

    @property
    def violation_us(self) -> int:
        return self.violation_window_s * SECOND_US

    @property
    def quarantine_us(self) -> int:
        return self.quarantine_s * SECOND_US

    @property
    def rate_us(self) -> int:
        return self.rate_window_s * SECOND_US

    @property
    def compute_us(self) -> int:
        return self.compute_window_s * SECOND_US


DEFAULTS = Limits()


def log_violation() -> Column:
    """Which audit events count as violations when the log is replayed."""
    rejected = F.col("type").isin("QUERY_REJECTED", "MUTATION_REJECTED")
    by_stage = F.coalesce(F.col("stage") == "AST", F.lit(False))
    by_key = F.coalesce(F.col("reason") == "bad operator key", F.lit(False))
    return rejected & (by_stage | by_key)


def violation_window(
    violations: DataFrame,
    keys: Sequence[str],
    limits: Limits = DEFAULTS,
    keep_stretch: bool = False,
) -> DataFrame:
    """Adds `n_violations`: violations in the trailing window, this one included."""
    counted = violations.withColumn("_one", F.lit(1).cast("bigint"))
    out = sliding(
        counted, keys, "us", {"n_violations": Sliding("_one", limits.violation_us)},
        limits.cut, keep_stretch,
    )
    return out.drop("_one")


def breaker_trips(
    violations: DataFrame, keys: Sequence[str], limits: Limits = DEFAULTS
) -> DataFrame:
    """The violations that trip the breaker; each further one trips it again."""
    counted = violation_window(violations, keys, limits)
    return counted.filter(F.col("n_violations") >= limits.max_violations)


def quarantine_intervals(
    trips: DataFrame, keys: Sequence[str], limits: Limits = DEFAULTS
) -> DataFrame:
    """Union of `[trip, trip + quarantine)` per session, as start, end, trips.

    The trips, few beside the log they come from, are written out before the passes
    over them, so the log is not read again for each. Only the first and last trip of an interval reach the final window, and two
    intervals are at least one quarantine apart, so a session has few of them.
    """
    moments = written(trips.groupBy(*keys, "us").agg(F.count("*").alias("_n")), "trips")
    placed = running(
        moments, keys, "us",
        {
            "_prev": Running("us", "max", before=True),
            "_next": Running("us", "min", before=True, ahead=True),
            "_upto": Running("_n", "sum"),
        },
        limits.cut,
    )
    gap = limits.quarantine_us
    starts = F.col("_prev").isNull() | (F.col("us") - F.col("_prev") > gap)
    ends = F.col("_next").isNull() | (F.col("_next") - F.col("us") > gap)
    edges = placed.select(
        *keys, "us", "_upto", "_n", starts.alias("_starts"), ends.alias("_ends")
    ).filter("_starts OR _ends")
    in_order = Window.partitionBy(*keys).orderBy("us")
    last_us = F.when(F.col("_ends"), F.col("us")).otherwise(F.lead("us").over(in_order))
    last_upto = F.when(F.col("_ends"), F.col("_upto")).otherwise(F.lead("_upto").over(in_order))
    return (
        edges.withColumns({"_last_us": last_us, "_last_upto": last_upto})
        .filter("_starts")
        .select(
            *keys,
            F.col("us").alias("start_us"),
            (F.col("_last_us") + gap).alias("end_us"),
            (F.col("_last_upto") - F.col("_upto") + F.col("_n")).alias("n_trips"),
        )
    )


def with_trips(
    events: DataFrame, keys: Sequence[str], is_violation: Column, limits: Limits = DEFAULTS
) -> DataFrame:
    """Adds to every event the violation count and, if it trips, its own `trip_us`."""
    flagged = events.withColumn("_v", flag(is_violation))
    counted = sliding(
        flagged, keys, "us", {"n_violations": Sliding("_v", limits.violation_us)},
        limits.cut, keep_stretch=True,
    )
    trips = (F.col("_v") == 1) & (F.col("n_violations") >= limits.max_violations)
    return counted.withColumn("trip_us", F.when(trips, F.col("us"))).drop("_v")


def quarantine_asof(
    events: DataFrame, keys: Sequence[str], is_violation: Column, limits: Limits = DEFAULTS
) -> DataFrame:
    """Adds, as of each event, `quarantined` and the whole seconds that remain."""
    tripped = with_trips(events, keys, is_violation, limits)
    latest = running(tripped, keys, "us", {"_last": Running("trip_us", "max")})
    left = F.col("_last") + limits.quarantine_us - F.col("us")
    return latest.select(
        *events.columns,
        F.coalesce(left > 0, F.lit(False)).alias("quarantined"),
        F.when(left > 0, F.floor(left / SECOND_US)).otherwise(0).cast("bigint")
        .alias("remaining_s"),
    )


def rate_window(events: DataFrame, keys: Sequence[str], limits: Limits = DEFAULTS) -> DataFrame:
    """Adds `n_queries`: recorded queries in the trailing rate window."""
    counted = events.withColumn("_one", F.lit(1).cast("bigint"))
    return sliding(
        counted, keys, "us", {"n_queries": Sliding("_one", limits.rate_us)}, limits.cut
    ).drop("_one")


def compute_budget(
    events: DataFrame, keys: Sequence[str], spent_us: str, limits: Limits = DEFAULTS
) -> DataFrame:
    """Adds the compute spent in the window before each event, and if it is refused."""
    spent = sliding(
        events, keys, "us",
        {"spent_before_us": Sliding(spent_us, limits.compute_us, before=True)},
        limits.cut,
    )
    return spent.withColumn("over_budget", F.col("spent_before_us") >= limits.max_compute_us)


def write_gate(
    events: DataFrame,
    keys: Sequence[str],
    *,
    is_violation: Column,
    is_query: Column,
    is_write: Column,
    spent_us: str,
    limits: Limits = DEFAULTS,
) -> DataFrame:
    """Verdict per request: quarantine (writes only), then rate, then compute budget.

    The three windows share one shuffle; only the last trip needs a second pass.
    Requests are judged on what the log holds before them.
    """
    flagged = events.withColumns({"_v": flag(is_violation), "_q": flag(is_query)})
    counted = sliding(
        flagged, keys, "us",
        {
            "_n_violations": Sliding("_v", limits.violation_us),
            "_n_queries": Sliding("_q", limits.rate_us, before=True),
            "_spent": Sliding(spent_us, limits.compute_us, before=True),
        },
        limits.cut, keep_stretch=True,
    )
    trips = (F.col("_v") == 1) & (F.col("_n_violations") >= limits.max_violations)
    latest = running(
        counted.withColumn("_trip", F.when(trips, F.col("us"))), keys, "us",
        {"_last": Running("_trip", "max", before=True)},
    )
    quarantined = F.coalesce(F.col("us") < F.col("_last") + limits.quarantine_us, F.lit(False))
    verdict = (
        F.when(is_write & quarantined, "QUARANTINED")
        .when(F.col("_n_queries") >= limits.max_queries, "RATE_LIMITED")
        .when(F.col("_spent") >= limits.max_compute_us, "COMPUTE_EXHAUSTED")
        .otherwise("ALLOWED")
    )
    return latest.select(*events.columns, verdict.alias("verdict"))


def rate_admission(events: DataFrame, key: str, tie: str, limits: Limits = DEFAULTS) -> DataFrame:
    """Adds `admitted`: refused when the admitted queries of the window reach the limit.

    Refused queries are not recorded, so this is a recurrence. It only has to be
    followed where it can matter: an event whose *raw* count is within the limit is
    admitted whatever came before. So stretches of time without a single contested
    event stay on the JVM. Runs of contested stretches are sorted by time and folded,
    with the events of the window before them as lead-in. A run is sequential by
    nature, but only a run: the sort spills, rows stream through the fold in batches,
    and its state is at most `limit` times.
    """
    columns = events.columns
    counted = sliding(
        events.withColumn("_one", F.lit(1).cast("bigint")), [key], "us",
        {"n_queries": Sliding("_one", limits.rate_us)}, limits.cut, keep_stretch=True,
    )
    placed = counted.join(_contested_runs(counted, limits), [KEY, STRETCH], "left")
    calm = placed.filter(F.col("_run").isNull()).select(*columns, F.lit(True).alias("admitted"))
    leads = F.col("us") > F.col("_lead_run") - limits.rate_us
    contested = placed.select(
        *columns,
        F.coalesce("_run", F.when(leads, F.col("_lead_run"))).alias("_run"),
        F.col("_run").isNotNull().alias("_judged"),
    ).filter(F.col("_run").isNotNull())
    folded = _fold_runs(contested, key, tie, limits)
    return calm.unionByName(folded.filter("_judged").select(*columns, "admitted"))


def _contested_runs(counted: DataFrame, limits: Limits) -> DataFrame:
    """Per session and stretch: the run it belongs to, or the run it leads into.

    Contested stretches less than one rate window apart are one run, with what lies
    between them: only after a whole window without a contested event is it known
    which events of the window were admitted, namely all.
    """
    width, reach = limits.cut.width, limits.rate_us
    forth, back = Window.partitionBy(KEY).orderBy(STRETCH), Window.partitionBy(KEY).orderBy(F.desc(STRETCH))
    strictly = (Window.unboundedPreceding, -1)
    hot_at = F.when(F.col("_hot"), F.col(STRETCH))
    stretches = counted.groupBy(KEY, STRETCH).agg(
        (F.max("n_queries") > limits.max_queries).alias("_hot")
    ).withColumns(
        {"_prev": F.max(hot_at).over(forth.rowsBetween(*strictly)),
         "_next": F.min(hot_at).over(back.rowsBetween(*strictly))}
    )
    apart = F.col(STRETCH) - (F.col("_prev") + width) >= reach
    between = F.coalesce(F.col("_next") - (F.col("_prev") + width) < reach, F.lit(False))
    starts = F.col("_hot") & F.coalesce(apart, F.lit(True))
    start = F.when(starts, F.col(STRETCH))
    near = F.col("_next") - reach < F.col(STRETCH) + width
    in_run = F.col("_hot") | between
    return stretches.select(
        KEY,
        STRETCH,
        F.when(in_run, F.last(start, ignorenulls=True).over(forth)).alias("_run"),
        F.when(~in_run & near, F.col("_next")).alias("_lead_run"),
    )


def _fold_runs(rows: DataFrame, key: str, tie: str, limits: Limits) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])
    return (
        rows.repartition(key, "_run")
        .sortWithinPartitions(key, "_run", "us", tie)
        .mapInPandas(_Admission(key, limits.max_queries, limits.rate_us), schema)
    )


class _Admission:
    """Folds sorted batches; the state passes from one batch to the next."""

    def __init__(self, key: str, limit: int, width_us: int):
        self.key, self.limit, self.width_us = key, limit, width_us

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept = None, []
        for batch in batches:
            us = batch["us"].to_numpy()
            keys, runs = batch[self.key].to_numpy(), batch["_run"].to_numpy()
            admitted = np.zeros(len(us), dtype=bool)
            codes = pd.factorize(keys, use_na_sentinel=False)[0]
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (runs[1:] != runs[:-1])) + 1
            edges = [0, *cuts.tolist(), len(us)] if len(us) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = (None if pd.isna(keys[lo]) else keys[lo], runs[lo])
                if own != group:
                    group, kept = own, []
                kept = self._fold(us[lo:hi], admitted[lo:hi], kept)
            yield batch.assign(admitted=admitted)

    def _fold(self, us: np.ndarray, admitted: np.ndarray, kept: list[int]) -> list[int]:
        """Marks the admitted rows; jumps over the refused ones by binary search."""
        i = 0
        while i < len(us):
            if len(kept) >= self.limit:
                free_at = kept[-self.limit] + self.width_us
                if us[i] < free_at:
                    i = int(np.searchsorted(us, free_at, side="left"))
                    continue
            admitted[i] = True
            kept.append(int(us[i]))
            del kept[: -self.limit]
            i += 1
        return kept


def health_snapshot(
    events: DataFrame,
    keys: Sequence[str],
    at_us: int,
    *,
    is_violation: Column,
    is_query: Column,
    spent_us: str,
    limits: Limits = DEFAULTS,
) -> DataFrame:
    """Status of every session at one moment.

    Only events young enough to matter are read: a quarantine in force at the moment
    was tripped within it, by violations of the window before.
    """
    reach = max(
        limits.quarantine_us + limits.violation_us, limits.rate_us, limits.compute_us
    )
    sessions = events.filter(F.col("us") <= at_us).select(*keys).distinct().withColumn(KEY, F.struct(*keys))
    recent = events.filter((F.col("us") <= at_us) & (F.col("us") > at_us - reach))
    tripped = with_trips(recent.withColumns(
        {"_viol": is_violation, "_query": is_query}), keys, F.col("_viol"), limits)

    def young(width_us: int) -> Column:
        return F.col("us") > at_us - width_us

    status = tripped.groupBy(F.struct(*keys).alias(KEY)).agg(
        F.max("trip_us").alias("_trip"),
        F.count_if(F.col("_viol") & young(limits.violation_us)).alias("violations_in_window"),
        F.count_if(F.col("_query") & young(limits.rate_us)).alias("queries_in_window"),
        F.sum(F.when(young(limits.compute_us), F.col(spent_us)).otherwise(0)).alias("_spent"),
    )
    left = F.coalesce(F.col("_trip") + limits.quarantine_us - at_us, F.lit(0))
    return sessions.join(status, KEY, "left").select(
        *keys,
        F.when(left > 0, "QUARANTINED").otherwise("HEALTHY").alias("status"),
        (left > 0).alias("is_quarantined"),
        F.greatest(F.floor(left / SECOND_US), F.lit(0)).cast("bigint").alias("remaining_s"),
        F.coalesce("violations_in_window", F.lit(0)).alias("violations_in_window"),
        F.lit(limits.max_violations).alias("max_violations"),
        F.coalesce("queries_in_window", F.lit(0)).alias("queries_in_window"),
        F.lit(limits.max_queries).alias("max_queries"),
        F.round(F.coalesce("_spent", F.lit(0)) / SECOND_US, 3).alias("compute_s"),
        (F.lit(limits.max_compute_us) / SECOND_US).alias("max_compute_s"),
    )


def reset_epochs(
    events: DataFrame, keys: Sequence[str], is_reset: Column, limits: Limits = DEFAULTS
) -> DataFrame:
    """Adds `epoch`: how many resets the session has seen. Used as a further key of
    any rule above, it clears that rule's state at each reset."""
    flagged = events.withColumn("_r", flag(is_reset))
    return running(
        flagged, keys, "us", {"epoch": Running("_r", "sum")}, limits.cut
    ).drop("_r")


def state_rows(
    violations: DataFrame, keys: Sequence[str], limits: Limits = DEFAULTS
) -> DataFrame:
    """What each violation writes to the state table: count, quarantine in force, time."""
    counted = violation_window(violations, keys, limits, keep_stretch=True)
    trips = F.when(F.col("n_violations") >= limits.max_violations, F.col("us"))
    latest = running(
        counted.withColumn("_trip", trips), keys, "us", {"_last": Running("_trip", "max")}
    )
    until = F.col("_last") + limits.quarantine_us
    return latest.select(
        *keys,
        F.col("n_violations").alias("violations"),
        F.when(until > F.col("us"), until).alias("quarantine_until"),
        F.col("us").alias("last_seen"),
    )


def state_upsert(stored: DataFrame, updates: DataFrame, key: str = "session_id") -> DataFrame:
    """The state table after the updates: per session the row seen last wins."""
    rest = [c for c in stored.columns if c not in (key, "last_seen")]
    both = stored.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    newest = F.max(F.struct("last_seen", "_new", *rest)).alias("r")
    return both.groupBy(key).agg(newest).select(
        key, *[F.col(f"r.{c}").alias(c) for c in stored.columns if c != key]
    )


def state_merge(
    memory: DataFrame, stored: DataFrame, at_us: int, key: str = "session_id"
) -> DataFrame:
    """Reload of stored state: more violations win, the later quarantine in force wins."""
    both = memory.select(key, "violations", "quarantine_until").unionByName(
        stored.select(key, "violations", "quarantine_until")
    )
    in_force = F.when(F.col("quarantine_until") > at_us, F.col("quarantine_until"))
    return both.groupBy(key).agg(
        F.max("violations").alias("violations"), F.max(in_force).alias("quarantine_until")
    )


def state_delete(stored: DataFrame, gone: DataFrame, key: str = "session_id") -> DataFrame:
    named = gone.select(F.col(key).alias("_gone")).distinct()
    return stored.join(named, stored[key].eqNullSafe(named["_gone"]), "left_anti")
