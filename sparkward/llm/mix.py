"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

1. Sources stand in code point order, null last, and weigh `weights`, repeating. Together they are to
   give `percent` of all words. A target stops at `most` times its source's size; what is above is shared
   again by weight until none is above.
2. Every document gets the key E / w: E exponential, from a digest of its id, w its quality weight.
   Small keys go first, so a document of twice the weight has twice the rate of being early.
3. A source gives complete epochs first. What its target lacks then is taken in order of keys:
   documents whole while they fit, and of the one that crosses the budget the words that fit. So
   the words taken equal the target, rounded.
4. The running sums are not made by sorting a source. Keys fall in cells of GRAIN to a factor of e;
   cells are summed before the shuffle, and the sums, as many at most as the grid has cells, run
   up within each source. Only the one cell of a source in which its budget ends is sorted.

A null text has no words, a text without words takes nothing and is taken 0 words of. A null doc_id is keyed by its
text. Rows that share a doc_id are each a document of their own. A source without words has target 0; an empty table
gives no rows. Other columns are not read. Every run on the same rows takes the same words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.frames import kept

WORD = r"[^ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
#: Cells of keys for each factor of e: the fullest holds about 1 / (2.7 * GRAIN) of a source.
GRAIN = 8192
_BITS = 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def plain_share(text: Column, size: Column) -> Column:
    """A quality weight between 0.05 and 1: less by the symbols a word has on average."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), 1 - F.coalesce(symbols, F.lit(0)) / F.greatest(size, F.lit(1)))


def exponential(name: Column, seed: str = "") -> Column:
    """A number of the exponential distribution, of 52 bits of a digest of `name`."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), name)), 1, _BITS // 4)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << _BITS))
    return -F.log(uniform)


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` with `rank` from 0 in code point order, null last; sorted by ranges, not in one task."""
    order = F.col("source").asc_nulls_last()
    place = F.monotonically_increasing_id()
    rows = kept(
        sources.repartitionByRange(order)
        .sortWithinPartitions(order)
        .select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")),
        "mix-sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    What a unit of weight gets rises from round to round; only two sums over the sources
    come back from each.
    """
    if not weights or min(weights) <= 0 or not 0 <= percent <= 100 * most:
        raise ValueError("weights must be above 0, and percent between 0 and 100 times most")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights))
    own = kept(numbered(sources).withColumn("weight", weight).drop("rank"), "mix-weights")
    limit = F.col("source_size") * most
    total = own.agg(F.sum("source_size")).first()[0] or 0
    share, above = 0.0, -1
    while True:
        over = limit < F.col("weight") * share
        n, full, rest = own.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == above or rest is None:
            break
        above, share = n, (percent * total / 100 - full) / rest
    return own.select("source", "source_size", F.least(limit.cast("double"), F.col("weight") * share).alias("target"))


def planned(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    quality: Column | None = None,
    seed: str = "",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document.

    `quality` is an expression over `docs`, above 0; by default `plain_share` of the text.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"),
        exponential(F.coalesce(doc_id, text, F.lit("")), seed).alias("e"),
        (F.lit(None).cast("double") if quality is None else quality.cast("double")).alias("w"),
        (text if quality is None else F.lit(None).cast("string")).alias("text"),
    )
    key = F.col("e") / F.coalesce("w", plain_share(F.col("text"), F.col("size")))
    rows = rows.select("doc_id", "source", "size", key.alias("key")).withColumn("cell", F.floor(F.log("key") * GRAIN))
    rows = kept(rows, "mix-keys")

    cells = kept(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    goals = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs).withColumn("budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    goals = kept(goals, "mix-goals")

    up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = cells.withColumn("through", F.sum("words").over(up_to))
    sums = sums.join(goals, same(sums, goals), "left").select(sums["source"], "cell", "through", "words", "budget")
    ends = sums.filter("through > budget").groupBy("source").agg(F.min_by(F.struct("cell", (F.col("through") - F.col("words")).alias("before")), "cell").alias("end"))
    plan = goals.join(ends, same(goals, ends), "left").select(goals["*"], "end")
    plan = kept(plan, "mix-plan")

    known = rows.join(plan, same(rows, plan)).drop(plan["source"])
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("end.before") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    last = known.filter("cell = end.cell").withColumn("extra", F.least("size", F.greatest(left, F.lit(0).cast("long"))))
    whole = known.filter("end IS NULL OR cell <> end.cell").withColumn(
        "extra", F.when(F.col("end").isNull() | (F.col("cell") < F.col("end.cell")), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    taken = F.col("epochs") * F.col("size") + F.col("extra")
    return whole.unionByName(last).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: (doc_id, source, copy, n_words, text), a row for each time a document is taken.

    A copy that the budget ends in has its first words only. Documents must have distinct ids.
    """
    plan = planned(docs, **how).filter("taken > 0")
    copies = plan.select("doc_id", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    words = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    out = copies.withColumn("n_words", words).join(whole, "doc_id")
    pieces = F.regexp_extract_all("text", F.lit(r"[ \t\n\x0B\f\r]*" + WORD), 0)
    cut = F.when(F.col("n_words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("n_words").cast("int")), ""))
    return out.select("doc_id", "source", "copy", "n_words", cut.alias("text"))
