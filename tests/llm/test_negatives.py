"""Hard negatives and their tree against brute force."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkward.llm import gnat, negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, count=10, low=30, high=90):
    own = {}
    size = max((len(e) for _, _, e in rows if e is not None), default=0)
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e] + [0] * (size - len(e))
        own[i] = min(own.get(i, (label, v)), (label, v))
    out = set()
    for a in (i for i in own if i % 100 == 0):
        scores = {i: sum(x * y for x, y in zip(v, own[a][1])) for i, (_, v) in own.items() if i != a}
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in ranked if own[i][0] == own[a][0]][:positives]:
            fits = [i for i in ranked if own[i][0] != own[a][0] and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out |= {(a, p, r, i, scores[p], scores[i]) for r, i in enumerate(fits[:count], 1)}
    return out


def clustered(seed, n, dim=8, spread=0.05):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    x = centres[rnd.integers(12, size=n)] + spread * rnd.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("cell", "block", "part", "v", "window", "anchor_id", "rank"):
        df = df.withColumn(c, F.lit("own"))
    got = [tuple(r) for r in negatives.hard_negatives(spark, df, F.col("vec_id") % 100 == 0, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 128)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rnd = np.random.default_rng(5)
    x = clustered(1, 900)
    rows = [(i, int(rnd.integers(4)), x[i].astype(float).tolist()) for i in range(900)]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(300)]  # one vector, many times: ties
    rows += [(2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [math.nan] * 8), (2003, 1, [math.inf] + [0.0] * 7), (2004, 1, [None] * 8)]
    rows += [(2100, 2, rows[0][2][:3]), (2200, 3, []), (2300, 9, rows[0][2]), (None, 1, rows[0][2])]
    rows += [(7, 0, rows[9][2]), (100, 0, rows[100][2]), (100, 0, rows[100][2])]  # ids again
    assert found(spark, rows) == brute(rows)


def test_nothing_to_find(spark):
    assert found(spark, []) == set()
    assert found(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == set()
    assert found(spark, [(0, None, None)]) == set()


def test_scores_beyond_double(spark):
    rows = [(i, i % 2, [3e6 + i, 1.0 + i, -2e6]) for i in range(0, 60)] + [(100, 0, [3e6, 5.0, -1e6])]
    assert found(spark, rows, low=0, high=100) == brute(rows, low=0, high=100)


@pytest.mark.parametrize("same", [True, False])
def test_best_of_a_block(same):
    rnd = np.random.default_rng(0)
    x, q = rnd.integers(-3, 4, size=(200, 5)), rnd.integers(-3, 4, size=(20, 5))
    labels, own = rnd.integers(2, size=200), rnd.integers(2, size=20)
    rows = pa.table({"vec_id": np.arange(200)[::-1].copy(), "label": labels, "v": pa.array(x.tolist(), pa.list_(pa.int64()))})
    low, high = [[-4, 2]] * 20, [[6, 2**62]] * 20
    anchors = pa.table({"anchor_id": np.arange(20), "label": own, "v": pa.array(q.tolist(), pa.list_(pa.int64())), "window": [[7, 8]] * 20, "lower": low, "upper": high})
    want = set()
    for a in range(20):
        scores = {199 - i: int(x[i] @ q[a]) for i in range(200) if (labels[i] == own[a]) == same and 199 - i != a}
        for w, lo, up in ((7, -4, 6), (8, 2, 2**62)):
            fits = sorted((i for i in scores if lo <= scores[i] <= up), key=lambda i: (-scores[i], i))[:6]
            want |= {(a, w, i, scores[i]) for i in fits}
    assert set(negatives.best(rows, anchors, same, 6)) == want


def test_tree_skips_but_loses_nothing():
    x = np.floor(256 * clustered(3, 4000, 6, 0.02))
    tree = gnat.grown(x[:1000], float(gnat.norms(x).max()))
    assert tree.cells > 8
    gnat.with_ranges(tree, list(gnat.measured(tree, [x[:1500], x[1500:]])))
    cells, q = tree.descend(x), x[::100]
    scores = q @ x.T
    ranked = -np.sort(-scores, axis=1)
    lower, upper = ranked[:, [20]], ranked[:, [5]]
    visited = 0
    for i, some in enumerate(tree.reached(q, lower, upper)):
        inside = (scores[i] >= lower[i]) & (scores[i] <= upper[i])
        assert set(cells[inside]) <= set(some)
        visited += len(some)
    assert visited < 0.5 * tree.cells * len(q)
    assert all(len(c) == 0 for c in tree.reached(q, upper + 1, lower))


def test_equal_rows_make_one_cell():
    x = np.full((500, 4), 3.0)
    tree = gnat.grown(x, 36.0)
    assert tree.cells == 1 and not tree.descend(x).any()
    assert [c.tolist() for c in tree.reached(x[:2], np.array([[1.0], [9.0]]), np.array([[5.0], [2.0]]))] == [[0], []]


def test_every_row_is_in_the_index(spark):
    rows = [(i, 0, e.astype(float).tolist()) for i, e in enumerate(clustered(7, 3000, 16))]
    index = negatives.indexed(negatives.vectors(spark.createDataFrame(rows, SCHEMA)))
    per = defaultdict(int)
    for r in index.rows.groupBy("cell").count().collect():
        per[r["cell"]] = r["count"]
    assert sum(per.values()) == 3000 and set(per) == set(index.blocks)
