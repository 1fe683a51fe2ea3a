"""Mixing sources: targets, running sums and the mix itself against plain loops."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkward.llm import mix

SCHEMA = "doc_id long, source string, text string"


def corpus(seed=3, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "Z", "é", None, "tiny"] if i < 20 else ["a", "b", "Z", "é", None])
        rows.append((i, source, " ".join(rnd.choice(["w", "x#", "long\tone"]) for _ in range(rnd.randrange(0, 40)))))
    rows += [(1000, "a", None), (1001, "a", ""), (1002, "void", " \n\t"), (1003, "long", "word " * 60000), (None, "b", "some words here"), (None, "b", "some words here")]
    rows += [(5, "a", "one two three"), (5, "a", "one two three")]
    return rows


def size(text):
    return len((text or "").replace("\x1f", "_").split())


def brute_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, out = set(order), percent * sum(sizes.values()) / 100, {}
    while True:
        share = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * share > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * share for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= most * sizes[s]
        open_ -= full


def test_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("size", "key", "cell", "budget", "end", "target", "part", "rank", "w", "e"):
        docs = docs.withColumn(c, F.lit("own"))
    got = mix.planned(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, size(t)) for i, _, t in rows)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    goals, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], goals[r["source"]])
        whole = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        assert whole * r["size"] <= r["taken"] <= min(2, whole + 1) * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goals[s]) <= 0.5 for s in goals)
    assert sum(goals.values()) == pytest.approx(1.5 * sum(sizes.values()))
    # Of the last epoch, one document of a source at most is taken in part, and those before it whole.
    for s in goals:
        part = [r for r in got if r["source"] == s and r["size"] and 0 < r["taken"] % r["size"]]
        assert len(part) <= 1
    again = mix.planned(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mix.planned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_is_that_of_the_keys(spark):
    """The documents of the last epoch are those of the least E / w."""
    import hashlib

    rows = [(i, "s", "w " * (1 + i % 5) + "#" * (i % 3)) for i in range(500)]
    got = {r["doc_id"]: r for r in mix.planned(spark.createDataFrame(rows, SCHEMA), weights=(1,), percent=40).collect()}

    def key(i, text):
        u = (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / max(0.05, 1 - text.count("#") / size(text))

    left = round(0.4 * sum(size(t) for _, _, t in rows))
    for i, _, text in sorted(rows, key=lambda r: key(r[0], r[2])):
        assert got[i]["taken"] == min(size(text), left)
        left -= got[i]["taken"]
    assert left == 0


def test_better_documents_come_more_often(spark):
    rows = [(i, "s", "w " * 10) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    good = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    got = mix.planned(docs, weights=(1,), percent=20, quality=good).filter("taken > 0").collect()
    even = sum(r["doc_id"] % 2 == 0 for r in got)
    assert 0.72 < even / len(got) < 0.85


def test_mixed_texts(spark):
    rows = [r for r in corpus(4, 120) if r[0] is not None and r[0] != 5]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = {r["doc_id"]: r["taken"] for r in mix.planned(docs).collect()}
    words, texts = defaultdict(int), {i: t for i, _, t in rows}
    for r in mix.mixed(docs).collect():
        assert size(r["text"]) == r["n_words"]
        assert texts[r["doc_id"]].startswith(r["text"])
        words[r["doc_id"]] += r["n_words"]
    assert {i: n for i, n in plan.items() if n} == dict(words)


def test_bad_parameters(spark):
    sources = spark.createDataFrame([("a", 3)], "source string, source_size long")
    for how in ({"weights": ()}, {"weights": (1, 0)}, {"percent": 201}, {"percent": -1}):
        with pytest.raises(ValueError):
            mix.targets(sources, **how)
