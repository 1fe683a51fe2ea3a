"""Connected components of links between documents, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm.frames import kept


def forest(links: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(node, smallest node it is linked with) by union-find, for all nodes but the smallest ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    for x in list(parent):
        if (top := root(x)) != x:
            yield x, top


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over what one task holds of the links; many links become one for each node."""

    def pairs() -> Iterator[tuple[int, int]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    out = list(forest(pairs()))
    for at in range(0, len(out), 1 << 16):
        node, low = zip(*out[at : at + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(low, pa.int64())], ["node", "low"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the smallest node it is connected with.

    Each task first replaces its links by a forest. Then, in rounds, every node points
    to its smallest neighbour, and the others of its neighbours are linked with that one,
    until each node points to one root. A node's neighbours are aggregated, not listed.
    """
    own = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = kept(own.mapInArrow(_contract, "node long, low long").distinct(), "forest")
    while True:
        low = kept(edges.groupBy("node").agg(F.min("low").alias("least"), F.max("low").alias("most")), "least")
        if low.filter("least <> most").limit(1).count() == 0:
            break
        joined = edges.join(low.select("node", "least"), "node")
        down = joined.filter("low <> least").select(F.col("low").alias("node"), F.col("least").alias("low"))
        edges = kept(down.unionByName(low.select("node", F.col("least").alias("low"))).mapInArrow(_contract, "node long, low long").distinct(), "forest")
    tree = low.select("node", F.col("least").alias("label"))
    while True:  # each round halves the way to the root
        up = tree.select(F.col("node").alias("label"), F.col("label").alias("above"))
        nearer = kept(tree.join(up, "label", "left"), "jump")
        if nearer.filter("above IS NOT NULL").limit(1).count() == 0:
            break
        tree = nearer.select("node", F.coalesce("above", "label").alias("label"))
    roots = tree.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    return kept(tree.unionByName(roots), "labels")
