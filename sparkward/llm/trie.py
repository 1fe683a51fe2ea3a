"""The prefix trie of conversations: every distinct sequence of first turns, with what its subtree holds.

A node of depth d is a distinct sequence of d turns (role, text); conversations that start
with it are its members, and the root (d = 0) has all. A node is named by its smallest member
and its depth, which no two nodes share.

1. A turn becomes an id: 128 bits of digest of role and text, and the text's code points. From
   here on no text is moved.
2. Turns stand in blocks of WIDTH positional columns, a row for each conversation and block. A
   block carries the key of the node before it: two 64-bit lanes, xor of a hash of (place, id)
   over all earlier turns, so a node's key follows from its parent's and back.
3. One ROLLUP over the positional columns, within (block, key before), makes all prefixes of all
   blocks at once; grouping_id tells the depth. Counts are partial before the shuffle, so a turn
   that a third of all conversations start with is a row per task there.
4. No walk over the tree is needed for the subtrees. A smallest member of a node is that of every
   deeper node on its own way; so a conversation is described by the depth from which it is
   smallest ("own depth"). Sums of that over members, by a second ROLLUP of the same kind, give
   leaves, children and savings of all subtrees.
5. Parents of nodes that start a way of their own are joined by key; all others' parents have the
   node's own conv_id.
6. The conversations that end in a node are joined in pieces of SPAN consecutive ids, and the
   pieces digested as a stream in order of ids. So no group of copies is held in memory.

Rows without conv_id take no part. Null role or text is empty. Turns of a conversation are in
order of turn, null first; turns of equal number in order of role and text, and each stays. So
a repeated row is a turn of its own. A conversation is put in order by one sort in one task, which spills;
nothing of it is collected. Other columns are not read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.llm.frames import kept

#: Turn-id columns of a block; ROLLUP makes WIDTH + 1 rows of each before it sums them up.
WIDTH = 8
#: A piece of the list of conversations that end in a node: 2 ** SPAN consecutive ids at most.
SPAN = 12

COLUMNS = [f"t{i}" for i in range(1, WIDTH + 1)]
KEY = ["depth", "k1", "k2"]


def turn_ids(rows: DataFrame) -> DataFrame:
    """(conv_id, place from 1, turn: id and code points) of every row of a table of turns."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    return own.filter("conv_id IS NOT NULL").select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("place"),
        F.struct(digest.alias("id"), F.length("text").alias("chars")).alias("turn"),
    )


def _lane(salt: int, place: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(salt), place, turn["id"])


def _blocks(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each member and block of its turns; a member without turns has one empty block."""
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.partitionBy("conv_id")
    lanes = [F.coalesce(F.bit_xor(_lane(i, F.col("place"), F.col("turn"))).over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)]
    chars = F.coalesce(F.sum("turn.chars").over(before), F.lit(0)).alias("chars_before")
    block = ((F.col("place") - 1) / WIDTH).cast("long").alias("block")
    columns = [F.max(F.when((F.col("place") - 1) % WIDTH == i, F.col("turn"))).alias(c) for i, c in enumerate(COLUMNS)]
    cut = (
        turns.select("conv_id", "place", "turn", block, *lanes, chars)
        .groupBy("conv_id", "block")
        .agg(
            F.max("place").alias("last"),
            F.sum("turn.chars").alias("own_chars"),
            *(F.min_by(c, "place").alias(c) for c in ("p1", "p2", "chars_before")),
            *columns,
        )
        .withColumn("n_turns", F.max("last").over(of_all))
        .withColumn("n_chars", F.sum("own_chars").over(of_all))
        .drop("last", "own_chars")
    )
    zero = ("block", "p1", "p2", "chars_before", "n_turns", "n_chars")
    return members.join(cut, "conv_id", "left").fillna(0, list(zero))


def _rollup(blocks: DataFrame, sums: str) -> DataFrame:
    """`sums` over the members of every node: (block, width, p1, p2, chars_before, t1.., and the sums)."""
    columns = ", ".join(COLUMNS)
    made = blocks.sparkSession.sql(
        f"""SELECT block, p1, p2, chars_before, {columns}, {WIDTH} - bit_count(grouping_id()) AS width, {sums}
            FROM {{blocks}} GROUP BY block, p1, p2, chars_before, ROLLUP ({columns})""",
        blocks=blocks,
    )
    # A block's own top is the node the block before ends with, but for the root.
    last = F.get(F.array(*COLUMNS), F.col("width") - 1)
    return made.filter(F.when(F.col("width") == 0, F.col("block") == 0).otherwise(last.isNotNull())).withColumn("last", last)


def _key(lane: int) -> Column:
    """The key of the node that a row's turns lead to; turns that ROLLUP took away count for nothing."""
    key = F.col(f"p{lane}")
    for i, c in enumerate(COLUMNS, 1):
        key = key.bitwiseXOR(F.when(F.col(c).isNotNull(), _lane(lane, F.col("block") * WIDTH + i, F.col(c))).otherwise(F.lit(0)))
    return key


def _depth() -> Column:
    return F.col("block") * WIDTH + F.col("width")


def _chars_above() -> Column:
    """Code points of all turns of a node but the last."""
    total = F.col("chars_before")
    for c in COLUMNS:
        total = total + F.coalesce(F.col(c)["chars"], F.lit(0))
    return total - F.coalesce(F.col("last")["chars"], F.lit(0))


def _own_depths(blocks: DataFrame) -> DataFrame:
    """Of every conversation that is smallest in some node: the least such depth, the code points
    above that depth, and whether one of the nodes has no children."""
    nodes = _rollup(blocks, "min(conv_id) AS conv_id, max(n_turns) AS deepest").select(
        "conv_id", _depth().alias("depth"), _chars_above().alias("above"), "deepest"
    )
    return nodes.groupBy("conv_id").agg(
        F.min("depth").alias("own_depth"),
        F.min_by("above", "depth").alias("shared_chars"),
        F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"),
    )


def _digests(blocks: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes some conversation ends in."""
    ends = blocks.filter(F.col("n_turns") <= (F.col("block") + 1) * WIDTH).select(
        F.col("n_turns").alias("depth"), _key(1).alias("k1"), _key(2).alias("k2"), "conv_id"
    )
    listed = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    parts = ends.groupBy(*KEY, F.shiftright("conv_id", SPAN).alias("span")).agg(F.array_join(listed, ",").alias("ids"))
    schema = "depth long, k1 long, k2 long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, digest = None, None
        names = [*KEY, "ends_sha256"]
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids")), strict=True):
                if key != open_key:
                    if open_key is not None:
                        done.append((*open_key, digest.hexdigest()))
                    open_key, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done])
        if open_key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*open_key, digest.hexdigest()), strict=True))])

    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "span").mapInArrow(run, schema)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Every node of the trie of `members` (conv_id, distinct) with the turns of `turn_ids`.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that
    members need not repeat, over the subtree), ends_sha256 (of the members that end there).
    """
    blocks = kept(_blocks(turns, members), "trie-blocks")
    known = blocks.join(_own_depths(blocks), "conv_id", "left").select(
        *blocks.columns,
        F.coalesce("own_depth", F.col("n_turns") + 1).alias("own_depth"),
        F.coalesce("shared_chars", "n_chars").alias("shared_chars"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    first = "min_by(struct(conv_id, n_turns, own_depth, shared_chars), conv_id) AS first"
    starts = ", ".join(f"count_if(own_depth = block * {WIDTH} + {i} AND own_depth <= n_turns) AS c{i}" for i in range(1, WIDTH + 2))
    sums = f"{first}, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(shared_chars) AS shared, {starts}"
    begun = F.get(F.array(*(f"c{i}" for i in range(1, WIDTH + 2))), F.col("width"))
    depth = F.col("depth")
    nodes = (
        _rollup(known, sums)
        .withColumns({"depth": _depth(), "k1": _key(1), "k2": _key(2), "above": _chars_above()})
        .select(
            *KEY,
            F.col("first.conv_id").alias("conv_id"),
            F.col("first.own_depth").alias("own_depth"),
            *(F.col(f"k{i}").bitwiseXOR(_lane(i, depth, F.col("last"))).alias(f"parent_k{i}") for i in (1, 2)),
            "n_convs",
            (begun + (F.col("first.n_turns") > depth).cast("long")).alias("n_children"),
            "n_leaves",
            (F.col("shared") - F.col("first.shared_chars") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"),
        )
    )
    nodes = kept(nodes, "trie-nodes")
    # A node that starts a way of its own hangs from another's node; the root's many are not joined.
    root = nodes.filter("depth = 0").select("conv_id")
    joined = nodes.filter("own_depth = depth AND depth > 1")
    above = nodes.select((depth + 1).alias("depth"), F.col("k1").alias("parent_k1"), F.col("k2").alias("parent_k2"), F.col("conv_id").alias("parent_conv_id"))
    others = nodes.filter("NOT (own_depth = depth AND depth > 1)").withColumn(
        "parent_conv_id", F.when(depth == 1, root.scalar()).when(depth > 1, F.col("conv_id"))
    )
    whole = others.unionByName(joined.join(above, ["depth", "parent_k1", "parent_k2"], "left").select(*others.columns))
    return whole.join(_digests(blocks), KEY, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) as it is."""
    turns = kept(turn_ids(rows), "turn-ids")
    return trie(turns, turns.filter("place = 1").select("conv_id"))


def with_shared_heads(turns: DataFrame, group: int, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, members) with the first turns of every conversation taken from its group's first one.

    Conversation c gets the first `heads` (an expression of conv_id, `most` at most) turns of
    conversation c - c % group, all if that has fewer and none if it doesn't exist, and then its
    own turns after its first `heads`.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "turn"))), lambda x: x["turn"])
    first = turns.filter((base == F.col("conv_id")) & (F.col("place") <= most)).groupBy(F.col("conv_id").alias("base")).agg(listed.alias("turns"))
    members = turns.filter("place = 1").select("conv_id", base.alias("base"), heads.alias("h"))
    empty = F.array().cast(first.schema["turns"].dataType)
    plan = members.join(first, "base", "left").select("conv_id", "h", F.slice(F.coalesce("turns", empty), F.lit(1), F.col("h")).alias("head"))
    taken = plan.select("conv_id", F.posexplode("head").alias("i", "turn")).select("conv_id", (F.col("i") + 1).cast("long").alias("place"), "turn")
    moved = F.col("place") - F.col("h") + F.size("head")
    own = turns.join(plan, "conv_id").filter(F.col("place") > F.col("h")).select("conv_id", moved.cast("long").alias("place"), "turn")
    return own.unionByName(taken), members.select("conv_id")
