"""The prefix trie against a walk over plain lists."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sparkward.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def lists(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in found.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    out = set()

    def walk(path):
        leaves, saved = 0, (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        for below in children[path]:
            n, s = walk(below)
            leaves, saved = leaves + n, saved + s
        leaves = leaves or 1
        ends = ",".join(str(c) for c in members[path] if len(convs[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        own = (members[path][0], len(path), parent, len(members[path]), len(children[path]), leaves, saved)
        out.add((*own, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        walk(())
    return out


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample(seed, n=60, most=12):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, most)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["", "a", "ab", "né"])))
    return rows


def test_against_a_walk(spark):
    rows = sample(1)
    rows += [(1000 + i, t, "user", "same") for i in range(300) for t in range(3)]  # copies
    rows += [(c, t, "user", f"x{t}") for c in (2000, 2001) for t in range(40)]  # several blocks
    rows += [(2002, t, "user", f"x{t}" if t < 33 else "y") for t in range(35)]
    rows += [(2003, t, "user", f"x{t}") for t in range(16)]  # ends where a block ends
    rows += [(-5, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "b")]
    rows += [(3000, None, "user", "first"), (3000, 0, None, None), (3000, 0, "b", "tie"), (3000, 0, "a", "tie"), (3000, 0, "a", "tie")]
    rows += [(3001, 0, "us", "er"), (3002, 0, "user", ""), (3003, 0, "", "user"), (3004, 0, "user", "é" * 20000)]
    table = spark.createDataFrame(rows, SCHEMA)
    for c in ("block", "place", "depth", "k1", "p1", "t1", "width", "last", "n_turns", "base", "h"):
        table = table.withColumn(c, F.lit("own"))
    assert found(trie.prefix_trie(table)) == brute(lists(rows))


def test_empty_table(spark):
    assert found(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == set()
    assert found(trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA))) == set()


def test_ends_over_several_pieces(spark):
    step = 1 << (trie.SPAN - 1)
    rows = [(i * step + j, 0, "user", "x") for i in range(-4, 5) for j in range(7)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(lists(rows))


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_shared_heads(spark):
    rows = sample(2, 250, 9) + [(c, 0, "user", "only") for c in range(300, 420)]
    rows = [r for r in rows if r[0] != 200]  # a group without its first conversation
    turns = trie.turn_ids(spark.createDataFrame(rows, SCHEMA))
    heads = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    convs = rebuilt(lists(rows))
    assert any(not t for t in convs.values())
    assert found(trie.trie(*trie.with_shared_heads(turns, 100, heads, 5))) == brute(convs)
