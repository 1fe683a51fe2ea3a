"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

A document is its set of distinct word shingles (a text of fewer words, but not
none, is one shingle; a text without words has no set and is linked with nothing).
Two documents are linked if 100 * |intersection| >= percent * |union| of the full sets.

1. Equal sets become one class, named by its smallest doc_id, before anything else.
2. SuperMinHash: every element walks its own random permutation of the registers and
   offers rank + fraction to each; a document stops once no register can improve.
   Ranks of one element differ by construction, which lowers the variance.
3. Classes that agree on all registers of a band share a bucket. In each bucket the
   member with most neighbours is the hub; members are verified against their hubs.
   Union-find gives components.
4. Buckets whose members are still in several components are compared in full, block
   against block, each pair of blocks in a task of its own that emits links, not pairs.
   So no member of a bucket is left out, however large the bucket is.

Rows that share a doc_id count as one document. A row without doc_id is linked with
nothing; its component is null, and it is kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm import text as words_of
from sparkward.llm.frames import ids_and_texts, ids_schema, kept, map_batches
from sparkward.llm.unionfind import components, forest

BANDS, ROWS = 32, 6
#: Shingles of one block where a bucket is compared in full.
BLOCK = 400_000


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first document, the sorted distinct shingle hashes of each) by pieces."""
    for piece in words_of.pieces(column):
        found = words_of.words(piece, words_of.SPACED_FOLDED)
        hashes, doc, _ = words_of.windows(found, k)
        cuts = np.searchsorted(doc, np.arange(1, len(piece)))
        yield piece.first, [np.unique(part) for part in np.split(hashes, cuts)]


def superminhash(sets: list[np.ndarray], registers: int, block: int = 1 << 15) -> np.ndarray:
    """A row of `registers` values for each set; an empty set keeps the largest value."""
    sizes = np.array([len(s) for s in sets])
    best = np.full(len(sets) * registers, np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    step = words_of.odd_numbers(registers, salt=1000)
    for at in range(0, len(elements), block):
        e, d = elements[at : at + block], doc[at : at + block]
        rank = np.tile(np.arange(registers, dtype=np.uint16), (len(e), 1))
        row = np.arange(len(e))
        for j in range(registers):
            draw = words_of.mix(e ^ step[j])
            pick = j + ((draw & np.uint64(0xFFFF)) * np.uint64(registers - j) >> np.uint64(16)).astype(np.int64)
            target = rank[row, pick]
            rank[row, pick] = rank[row, j]
            offer = (np.uint64(j) << np.uint64(48)) | (draw >> np.uint64(16))
            np.minimum.at(best, d * registers + target, offer)
            live, of = np.unique(d, return_inverse=True)
            worst = best.reshape(-1, registers)[live].max(axis=1) >> np.uint64(48)
            on = (worst > j)[of]
            if not on.any():
                break
            if not on.all():
                e, d, row = e[on], d[on], row[on]
    return best.reshape(len(sets), registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    return words_of.mix((parts * words_of.odd_numbers(rows)).sum(axis=2, dtype=np.uint64) + words_of.odd_numbers(bands, 500))


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key: digest of the whole set, bands) for every row."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            sizes, keys, found = [], [], []
            for _, sets in shingle_sets(batch.column(1), k):
                sizes += [len(s) for s in sets]
                keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                found.append(band_keys(superminhash(sets, bands * rows), bands, rows).view(np.int64))
            flat = np.concatenate(found).ravel() if found else np.zeros(0, np.int64)
            offsets = np.arange(0, len(flat) + 1, bands, dtype=np.int32)
            return [batch.column(0), sizes, keys, pa.ListArray.from_arrays(offsets, flat)]

        return run

    return map_batches(ids_and_texts(docs), make, ids_schema("n_shingles long, set_key binary, bands array<long>"))


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, made again from their texts."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            sets = [s.view(np.int64) for _, part in shingle_sets(batch.column(1), k) for s in part]
            offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            return [batch.column(0), pa.ListArray.from_arrays(offsets, flat)]

        return run

    picked = ids_and_texts(docs).join(wanted.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return map_batches(picked, make, ids_schema("shingles array<long>")).withColumnRenamed("doc_id", "node")


def _linked(shared, n_a, n_b, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def _hub_links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members verified against the hubs of their buckets; a hub's set travels to its members."""
    mates = near.groupBy("bucket").agg(F.count("*").alias("size"))
    crowd = near.join(kept(mates, "bucket-sizes"), "bucket").groupBy("node").agg(F.sum("size").alias("crowd"))
    ranked = near.join(kept(crowd, "crowds"), "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("crowd", (-F.col("node")).alias("minus"))).alias("top"))
    hubs = kept(hubs.select("bucket", (-F.col("top.minus")).alias("hub")), "hubs")
    pairs = kept(near.join(hubs, "bucket").filter("node <> hub").select("node", "hub").distinct(), "hub-pairs")
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("others")), "hub")
    shared = F.size(F.array_intersect("shingles", "others"))
    return both.filter(_linked(shared, F.size("shingles"), F.size("others"), percent)).select(
        F.col("node").alias("a"), F.col("hub").alias("b")
    )


def block_links(nodes: np.ndarray, group: np.ndarray, block: np.ndarray, sets: list[np.ndarray], i: int, j: int, percent: int):
    """Links between blocks i and j whose ends are in different groups, a spanning forest of them."""
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    found = []
    for x in np.flatnonzero(block == i):
        others = np.flatnonzero((block == j) & (group != group[x]) & ((nodes > nodes[x]) | (i != j)))
        others = others[(100 * size[others] >= percent * size[x]) & (100 * size[x] >= percent * size[others])]
        if len(others):
            mask = np.zeros(ids.max() + 1, np.int64)
            mask[ids[begin[x] : begin[x] + size[x]]] = 1
            total = np.concatenate([[0], np.cumsum(mask[ids])])
            shared = total[begin[others] + size[others]] - total[begin[others]]
            hit = others[_linked(shared, size[x], size[others], percent)]
            found += [(int(nodes[x]), int(nodes[y])) for y in hit]
            group = np.where(np.isin(group, group[hit]), group[x], group)
    return list(forest(found))


def _rest_links(near: DataFrame, sets: DataFrame, sizes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that still hold several components: every two members are compared, by blocks."""
    held = near.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sizes, "node")
    split = held.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n_shingles").alias("weight"))
    split = kept(split.filter("lo <> hi").select("bucket", F.ceil(F.col("weight") / BLOCK).cast("int").alias("n")), "open-buckets")
    dealt = held.join(split, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label"
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        listed = table.column("shingles").combine_chunks()
        at, flat = listed.offsets.to_numpy(), listed.values.to_numpy()
        nodes, group, block = (table.column(c).to_numpy() for c in ("node", "label", "own"))
        parts = [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        links = block_links(nodes, group, block, parts, key[1].as_py(), key[2].as_py(), percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    grouped = dealt.join(sets, "node").groupBy("bucket", "i", "j")
    return grouped.applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`, rows in equal number.

    component_id is the smallest doc_id that links lead to; kept marks the row of that document.
    """
    signed = kept(signatures(docs, k, bands, rows), "signatures")
    usable = signed.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = kept(usable.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    members = kept(usable.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "node").distinct(), "members")
    heads = usable.join(members.filter("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi")
    buckets = heads.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct()
    # a bucket of one needs no further look
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("bucket")
    near = kept(buckets.join(kept(shared, "shared-buckets"), "bucket", "left_semi"), "near")
    sets = kept(sets_of(docs, near, k), "sets")
    sizes = sets.groupBy("node").agg(F.max(F.size("shingles")).alias("n_shingles"))
    same = members.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = kept(_hub_links(near, sets, percent), "hub-links")
    labels = components(links)
    rest = kept(_rest_links(near, sets, sizes, labels, percent), "rest-links")
    labels = components(links.unionByName(rest).unionByName(same))
    return (
        signed.select("doc_id", "n_shingles")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents whose component has a smaller doc_id; rows without doc_id stay."""
    gone = near_duplicates(docs, k, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
