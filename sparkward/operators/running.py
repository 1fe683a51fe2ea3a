"""Running and sliding aggregates over a key whose rows need not fit in one task.

A plain `Window.partitionBy(key)` sends all rows of a key to one task, and a sliding
frame re-adds every row of the frame for each row. Here

* every key's rows are cut into stretches of the order column, each in a task of its
  own, and what came before a stretch is carried in from totals aggregated before the
  shuffle; a key has as many totals as it has stretches, however many rows;
* a sliding sum is a running sum over rows that add at their time and rows that
  take away again one window later, so the work does not grow with the window.

Rows with a null key are one key of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The key of a row as one value that is never null, so that null keys join too, and the
# stretch it belongs to, named by where it starts. Results that keep these columns stay
# partitioned by them, so a further pass needs no shuffle.
KEY, STRETCH = "_key", "_stretch"
_STEP = "_step"
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class Cut:
    """Every key is cut every `width` units of the order column: what one task takes of it is what it has within that."""

    width: int = HOUR_US


@dataclass(frozen=True)
class Running:
    """One running aggregate: `sum` or `max` of a column over the rows so far.

    Rows with an equal order value count as one moment. `before` leaves the row's
    own moment out; `ahead` runs from the end of the key and takes `min`.
    """

    column: str
    how: str = "sum"
    before: bool = False
    ahead: bool = False


def stretch_of(moment: Column, width: int) -> Column:
    """Where the stretch of a moment starts."""
    return (moment - F.pmod(moment, F.lit(width))).cast("bigint")


def with_stretch(df: DataFrame, keys: Sequence[str], order: str, cut: Cut) -> DataFrame:
    return df.withColumns({KEY: F.struct(*keys), STRETCH: stretch_of(F.col(order), cut.width)})


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggregates: Mapping[str, Running],
    cut: Cut | None = None,
) -> DataFrame:
    """Add running aggregates over an integer `order` column, per `keys`.

    Rows that already carry `STRETCH` keep the stretch they have.
    """
    rows = df if STRETCH in df.columns else with_stretch(df, keys, order, cut or Cut())
    totals = rows.groupBy(KEY, STRETCH).agg(
        *[_fold(a.how)(a.column).alias(f"_t_{name}") for name, a in aggregates.items()]
    )
    carry = totals.select(
        KEY,
        STRETCH,
        *[
            _fold(a.how)(f"_t_{name}").over(_others(a.ahead)).alias(f"_c_{name}")
            for name, a in aggregates.items()
        ],
    )
    joined = rows.join(carry, [KEY, STRETCH], "left")
    added = []
    for name, a in aggregates.items():
        own = _fold(a.how)(a.column).over(_within(order, a))
        carried = F.col(f"_c_{name}")
        if a.how == "sum":
            total = F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
        else:
            pick = F.greatest if a.how == "max" else F.least
            total = pick(own, carried)
        added.append(total.alias(name))
    return joined.select(*df.columns, *added)


def _fold(how: str):
    return {"sum": F.sum, "max": F.max, "min": F.min}[how]


def _others(ahead: bool):
    by = F.col(STRETCH).desc() if ahead else F.col(STRETCH)
    return Window.partitionBy(KEY).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _within(order: str, a: Running):
    by = F.col(order).desc() if a.ahead else F.col(order)
    last = -1 if a.before else 0
    frame = Window.partitionBy(KEY, STRETCH).orderBy(by)
    return frame.rangeBetween(Window.unboundedPreceding, last)


@dataclass(frozen=True)
class Sliding:
    """Sum of an integer column over the trailing `width_us` microseconds.

    Half-open: a row counts while `now - t < width`. `before` leaves out the rows
    at the current microsecond.
    """

    column: str
    width_us: int
    before: bool = False


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    totals: Mapping[str, Sliding],
    cut: Cut | None = None,
    keep_stretch: bool = False,
) -> DataFrame:
    """Add sliding sums to every row; all of them in one shuffle of the rows.

    Each row is sent once with its payload, and once more per window width as a
    narrow row that takes its values away when it leaves that window. Departures
    come before arrivals at the same microsecond.
    """
    cut = cut or Cut()
    widths = sorted({s.width_us for s in totals.values()})
    moments = F.explode(F.array(F.lit(0), *[F.lit(w) for w in widths])).alias("_width")
    payload = [c for c in df.columns if c not in keys]
    arrives = F.col("_width") == 0
    at = (F.col(us) + F.col("_width")).cast("bigint")
    spread = df.select("*", moments).select(
        *keys,
        F.struct(*keys).alias(KEY),
        *[F.when(arrives, F.col(f"`{c}`")).alias(c) for c in payload],
        stretch_of(at, cut.width).alias(STRETCH),
        (at * 2 + F.when(arrives, 1).otherwise(0)).alias(_STEP),
        *[
            F.when(arrives, F.col(s.column))
            .when(F.col("_width") == s.width_us, -F.col(s.column))
            .otherwise(0).cast("bigint").alias(f"_m_{name}")
            for name, s in totals.items()
        ],
        arrives.alias("_arrives"),
    )
    wanted = {
        name: Running(f"_m_{name}", "sum", before=s.before) for name, s in totals.items()
    }
    out = running(spread, keys, _STEP, wanted).filter("_arrives")
    return out.select(*df.columns, *([KEY, STRETCH] if keep_stretch else []), *totals)


def flag(condition: Column) -> Column:
    """1 where the condition is true, else 0: a count as a sum."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
