"""Hard negatives: for an anchor and each of its positives, the nearest rows of other labels in a window of scores.

A score is the inner product of two integer vectors; higher comes first, ties by smaller vec_id. An
anchor's positives are its first `positives` other rows of its label; for each, the first `negatives` rows of
another label with low * positive_score <= 100 * score <= high * positive_score are returned.

Every search runs twice over the tree of `gnat`: first in the anchor's own cell, whose k-th best score
raises the lower end of the window; then in every other cell that the narrower annulus may meet. Cells
are cut into blocks of rows, and the anchors that visit a cell into blocks of anchors; a task holds
one block of each. It multiplies them and keeps the first k of each window, so no pair leaves it, and no
vector that many rows share fills a task. What tasks keep is merged by rank. Results are exact.

Rows with a null id or label, a null vector, or a component that is null or not finite take no part. Missing
components of shorter vectors are 0. Rows that share a vec_id count as one, that of the smallest label, then vector.
Components beyond 64 bits stand for the nearest 64-bit integer, and so do scores. An anchor whose label no other
row has, or whose windows are empty, gives no rows; nor does an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkward.llm import gnat
from sparkward.llm.frames import kept

#: Rows and visiting anchors of one task's blocks, and scores held at a time there.
ROWS, ANCHORS, SCORES = 8192, 2048, 1 << 21
SCALE = 256
LEAST, MOST = -(2**63), 2**63 - 1


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v: array of long, all of one length) of the rows that take part, one for each vec_id."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"), usable.alias("usable"))
    own = kept(own.filter("vec_id IS NOT NULL AND label IS NOT NULL AND usable").drop("usable"), "vectors")
    size = own.agg(F.max(F.size("v"))).first()[0] or 0
    own = own.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))))
    again = own.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    one = own.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    return own.join(again, "vec_id", "left_anti").unionByName(one)


@dataclass
class Index:
    """(vec_id, label, v, cell, block) of every row, the tree, and the blocks of each cell."""

    rows: DataFrame
    tree: gnat.Tree
    blocks: dict[int, int]


def _norm() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, gnat.matrix(part.column("v"))


def indexed(rows: DataFrame) -> Index:
    """Grow the tree on a sample, put every row into its cell, and measure all ranges."""
    top, size = rows.agg(F.max(_norm()), F.max(F.size("v"))).first()
    n = min(gnat.SAMPLE, gnat.SAMPLE_BYTES // (8 * max(1, size or 1)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, n)).select("v").toArrow()
    tree = gnat.grown(gnat.matrix(sample.column("v")), float(top or 0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _batches(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tree.descend(x), pa.int64())], [*part.schema.names, "cell"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(gnat.measured(tree, (x for _, x in _batches(batches))))
        columns = list(zip(*found, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 2, strict=True)], ["node", "i", "j", "low", "high"])

    placed = kept(rows.mapInArrow(cells, "vec_id long, label long, v array<long>, cell long"), "cells")
    spans = placed.select("v").mapInArrow(ranges, "node long, i long, j long, low double, high double")
    spans = spans.groupBy("node", "i", "j").agg(F.min("low"), F.max("high"))
    sizes = placed.groupBy("cell").count()
    # Both are bounded by the tree, not by the rows.
    blocks = {cell: -(-n // ROWS) for cell, n in sizes.collect()}
    return Index(placed, gnat.with_ranges(tree, [tuple(r) for r in spans.collect()]), blocks)


def _of(counts: dict[int, int], cell: Column) -> Column:
    """Into how many blocks a cell is cut; one if it isn't listed."""
    many = [x for c, n in counts.items() if n > 1 for x in (F.lit(c), F.lit(n))]
    return F.coalesce(F.element_at(F.create_map(*many), cell), F.lit(1)) if many else F.lit(1)


def _block(counts: dict[int, int], key: str) -> Column:
    return F.pmod(F.xxhash64(key), _of(counts, F.col("cell"))).cast("int")


def _windows(lists: list, fill: float) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=0)), fill)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def best(rows: pa.Table, anchors: pa.Table, same: bool, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor_id, window, vec_id, score): the first k of each anchor's windows among `rows`."""
    rows = rows.sort_by("vec_id")
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    x, q = gnat.matrix(rows.column("v")), gnat.matrix(anchors.column("v"))
    exact = x.shape[1] * max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) < 2**53
    if not exact:
        x, q = (np.array(t.column("v").to_pylist(), dtype=object) for t in (rows, anchors))
    names, own = anchors.column("anchor_id").to_numpy(), anchors.column("label").to_numpy()
    lists = {n: anchors.column(n).to_pylist() for n in ("window", "lower", "upper")}
    step = max(1, SCORES // len(ids))
    for at in range(0, len(names), step):
        to = slice(at, at + step)
        scores = q[to] @ x.T
        usable = (labels[None] == own[to, None]) == same
        usable &= ids[None] != names[to, None]
        if not exact:
            scores = np.clip(scores, LEAST, MOST)
        scores = np.where(usable, scores, -np.inf if exact else LEAST - 1)
        order = np.argsort(-scores, axis=1, kind="stable")
        ranked = np.take_along_axis(scores, order, axis=1)
        window, lower, upper = lists["window"][to], lists["lower"][to], lists["upper"][to]
        kind = float if exact else object
        low, high = (_windows(x, f).astype(kind) if exact else _objects(x, f) for x, f in ((lower, 1), (upper, 0)))
        for w in range(low.shape[1]):
            first = (ranked > high[:, w, None]).sum(axis=1)
            place = first[:, None] + np.arange(k)[None]
            inside = place < len(ids)
            place = np.minimum(place, len(ids) - 1)
            value = np.take_along_axis(ranked, place, axis=1)
            good = inside & (value >= low[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
            if exact:
                good &= np.isfinite(value.astype(float))
            else:
                good &= value > LEAST - 1
            for a, j in np.argwhere(good).tolist():
                yield int(names[at + a]), window[a][w], int(ids[order[a, place[a, j]]]), int(value[a, j])


def _objects(lists: list, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, dtype=object)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


_FOUND = "anchor_id long, window long, vec_id long, score long"
_ASKED = ["anchor_id", "label", "v", "cell", "window", "lower", "upper"]


def _scan(index: Index, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """The first k rows, in each block, of every window of the anchors that visit the block's cell."""
    by_cell = {c: -(-n // ANCHORS) for c, n in visits.groupBy("cell").count().collect()}
    blocks = index.blocks
    left = index.rows.withColumn("block", _block(blocks, "vec_id")).withColumn("part", F.explode(F.sequence(F.lit(0), _of(by_cell, F.col("cell")) - 1)))
    right = visits.withColumn("part", _block(by_cell, "anchor_id")).withColumn("block", F.explode(F.sequence(F.lit(0), _of(blocks, F.col("cell")) - 1)))
    names = ["anchor_id", "window", "vec_id", "score"]

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = list(best(rows, anchors, same, k)) if rows.num_rows and anchors.num_rows else []
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    keys = ["cell", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)


def _asked(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each anchor with all its windows; as many as it has positives, at most."""
    x = F.sort_array(F.collect_list(F.struct("window", "lower", "upper"))).alias("x")
    listed = windows.groupBy("anchor_id").agg(x)
    return anchors.join(listed, "anchor_id").select(*anchors.columns, *(F.col(f"x.{n}").alias(n) for n in ("window", "lower", "upper")))


def first_of(index: Index, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, vec_id, score, rank): the first k rows of each window (anchor_id, window, lower, upper).

    `anchors` are (anchor_id, label, v, cell); `same` asks for rows of the anchor's label, else of others.
    """
    near = kept(_scan(index, _asked(anchors, windows), same, k), "near")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    bound = near.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("anchor_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    tighter = windows.join(bound, ["anchor_id", "window"], "left").select(
        "anchor_id", "window", F.when(F.col("n") >= k, F.greatest("lower", "worst")).otherwise(F.col("lower")).alias("lower"), "upper"
    )
    tree = index.tree

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q in _batches(batches):
            cells = tree.reached(q, _windows(part.column("lower").to_pylist(), 1), _windows(part.column("upper").to_pylist(), 0))
            home = part.column("cell").to_numpy()
            cells = [c[c != h] for c, h in zip(cells, home, strict=True)]
            columns = [pa.array(cells, pa.list_(pa.int64())) if n == "cell" else part.column(n) for n in _ASKED]
            yield pa.RecordBatch.from_arrays(columns, _ASKED)

    schema = "anchor_id long, label long, v array<long>, cell array<long>, window array<long>, lower array<long>, upper array<long>"
    visits = _asked(anchors, tighter).select(*_ASKED).mapInArrow(route, schema).withColumn("cell", F.explode("cell"))
    far = _scan(index, kept(visits, "visits"), same, k)
    return near.unionByName(far).withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `anchor` is an expression of vec_id."""
    index = indexed(kept(vectors(rows), "distinct-vectors"))
    anchors = kept(index.rows.filter(anchor).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    every = anchors.select("anchor_id", F.lit(0).cast("long").alias("window"), F.lit(LEAST).cast("long").alias("lower"), F.lit(MOST).alias("upper"))
    found = first_of(index, anchors, every, True, positives)
    found = kept(found.select("anchor_id", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wide = F.col("positive_score").cast("decimal(19,0)")
    windows = found.filter("positive_score >= 0").select(
        "anchor_id", "window", F.ceil(wide * low / 100).cast("long").alias("lower"), F.floor(wide * high / 100).cast("long").alias("upper")
    )
    worst = first_of(index, anchors, kept(windows, "windows"), False, negatives)
    return worst.join(found, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
