"""Words, windows, union-find and boosted trees against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkward.llm import text as words_of
from sparkward.llm import trees
from sparkward.llm.unionfind import components, forest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = [
    (words_of.PLAIN, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True),
    (words_of.SPACED, r"[^\x20\x09-\x0D]+", False),
    (words_of.SPACED_FOLDED, r"[^\x20\x09-\x0D]+", True),
    (words_of.LINES, r"[^\n]+", False),
]


def texts(seed: int) -> list:
    rnd = random.Random(seed)
    made = ["".join(rnd.choice("ab AZ\n\t.,é9\x1c\x85 ") for _ in range(rnd.choice([0, 1, 3, 40, 900]))) for _ in range(40)]
    return [*made, None, "", "x" * 700, " \n "]


@pytest.mark.parametrize("charset, pattern, fold", KINDS)
@pytest.mark.parametrize("size", [1, 100, 10**6])
def test_words(monkeypatch, charset, pattern, fold, size):
    monkeypatch.setattr(words_of, "SEGMENT", 64)
    docs, hashes, seen = texts(3), {}, 0
    for piece in words_of.pieces(pa.chunked_array([docs[:9], docs[9:]]), size):
        found = words_of.words(piece, charset)
        for d in range(len(piece)):
            text = docs[piece.first + d] or ""
            wanted = re.findall(pattern, text.translate(LOW) if fold else text)
            own = slice(found.bounds[d], found.bounds[d + 1])
            got = [bytes(piece.data[a:b]).decode() for a, b in zip(found.start[own], found.end[own], strict=True)]
            assert [g.translate(LOW) if fold else g for g in got] == wanted
            for word, h in zip(wanted, found.hash[own].tolist(), strict=True):
                assert hashes.setdefault(word, h) == h
            seen += 1
    assert seen == len(docs)
    assert len(set(hashes.values())) == len(hashes)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_windows(k):
    docs, known = texts(5), {}
    for piece in words_of.pieces(pa.array(docs), 200):
        found = words_of.words(piece, words_of.SPACED)
        hashes, doc, first = words_of.windows(found, k)
        for d in range(len(piece)):
            own = re.findall(r"[^\x20\x09-\x0D]+", docs[piece.first + d] or "")
            wanted = [tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))] if own else []
            assert (first[doc == d] - found.bounds[d]).tolist() == list(range(len(wanted)))
            for window, h in zip(wanted, hashes[doc == d].tolist(), strict=True):
                assert known.setdefault(window, h) == h
    assert len(set(known.values())) == len(known)


def test_empty_column():
    assert list(words_of.pieces(pa.array([], pa.string()))) == []


def test_forest_and_components(spark):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    mess = [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(70)]
    links = [*chain, *star, *mess, (5, 5), (7, 6), (7, 6), (-3, 160)]
    rnd.shuffle(links)
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert dict(forest(links)) == {x: r for x, r in root.items() if x != r}
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = components(frame).collect()
    assert len(got) == len(nodes)
    assert {r["node"]: r["label"] for r in got} == {x: root[x] for x in nodes}
    assert components(frame.filter("false")).count() == 0


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    model = trees.fit(x[:2000], y[:2000], depth=3, trees=40)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    noisy = (x[:, 2] + rng.normal(0, 0.4, 3000) > 0.5).astype(float)
    for sign in (1, -1):
        bound = trees.fit(x, noisy, np.array([0, 0, sign, 0]), trees=30)
        row = np.repeat(rng.uniform(0, 1, (20, 4)), 50, axis=0)
        row[:, 2] = np.tile(np.linspace(0, 1, 50), 20)
        steps = np.diff(bound.score(row).reshape(20, 50), axis=1) * sign
        assert steps.min() >= -1e-12


def test_trees_score_as_walked_one_by_one():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400).astype(float)
    model = trees.fit(x, y, trees=7)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
