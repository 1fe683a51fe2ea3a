"""Line dedup by distinct words against brute force, near copies of short lines among them."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkward.llm import lines


def brute(rows, percent):
    known = [(d, i, line, frozenset(w for w in line.split(" ") if w)) for d, t in rows for i, line in enumerate(t.split("\n")) if line.strip()]
    gone = set()
    for d, i, line, own in known:
        for e, j, other, others in known:
            if (e, j) < (d, i) and (line == other or 100 * len(own & others) >= percent * len(own | others)):
                gone.add((d, i))
    return gone


@pytest.fixture(scope="module")
def rows():
    """Lines with one to twelve words changed, over a small and a large vocabulary, short and past LONG tokens."""
    rnd, out = random.Random(4), []
    for i in range(150):
        few = i % 2
        own = [f"w{rnd.randrange(90 if few else 5000)}" for _ in range(rnd.choice([1, 2, 4, 9, 20, 45, 62, 80, 130]))]
        for _ in range(rnd.randint(1, 4)):
            near = own[:]
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 12])):
                near[rnd.randrange(len(near))] = f"w{rnd.randrange(90 if few else 5000)}"
            if rnd.random() < 0.3:
                rnd.shuffle(near)
            out.append(" ".join(near))
    rnd.shuffle(out)
    base = [f"c{i}" for i in range(20)]
    out += [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(20)] * 3
    return [(d, "\n".join(out[4 * d : 4 * d + 4])) for d in range(len(out) // 4)]


@pytest.mark.parametrize("percent, rare", [(80, lines.RARE), (80, 0), (80, 3), (60, 3), (40, 0)])
def test_words(spark, rows, monkeypatch, percent, rare):
    monkeypatch.setattr(lines, "RARE", max(rare, 1))
    got = Counter((r["doc_id"], i) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), percent, by_word=True, folded=False).collect() for i in r["_removed"])
    wanted = brute(rows, percent)
    assert set(got) == wanted and len(wanted) > 100


def test_one_changed_word_in_a_line_of_twenty(spark):
    line = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, line), (2, line.replace("w10", "haingon")), (3, "another line")], "doc_id long, text string")
    assert {r["doc_id"]: r["_removed"] for r in lines.dedup_lines(docs, by_word=True).collect()} == {1: [], 2: [0], 3: []}


def test_copies_in_case_tabs_and_line_ends(spark):
    texts = ["One two\nthree four five", "one\ttwo \r\nTHREE four  five\r", "ONE TWO\n \t\r\none three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["_removed"]) for r in lines.dedup_lines(docs, by_word=True, folded=True).collect()}
    assert got == {0: (texts[0], []), 1: ("", [0, 1]), 2: (" \t\r\none three", [0])}


def brute_folded(rows, percent=80):
    """The registered setting: words between white space, lower-cased; lines of the same words in the same order are equal."""
    known = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if d is not None else []):
            own = [w for w in re.split(r"[ \t\x0B\f\r]+", line.lower()) if w]
            if own:
                known.append((d, i, own, frozenset(own)))
    gone = set()
    for d, i, words, own in known:
        for e, j, other, others in known:
            if (e, j) < (d, i) and (words == other or 100 * len(own & others) >= percent * len(own | others)):
                gone.add((d, i))
                break
    return gone


CLASHES = ("_removed", "_gone", "_doc", "_out", "_OUT_", "pos", "h", "key", "wanted")


def test_registered_setting(spark, rows):
    rnd = random.Random(9)

    def spoilt(text):
        signs = [rnd.choice([" ", "  ", "\t", " \r"]) if c == " " and rnd.random() < 0.1 else c.upper() if rnd.random() < 0.05 else c for c in text]
        return "".join(signs) + rnd.choice(["", "\r", " ", "\t"])

    more = [(d, "\n".join(spoilt(x) for x in t.split("\n"))) for d, t in rows]
    more += [(5000, None), (5001, ""), (5002, "\n \n\t\n"), (None, rows[0][1]), (5003, "w " * 30000 + "\nw"), (5004, rows[0][1]), (5005, "x" * 200000)]
    docs = spark.createDataFrame(more, "doc_id long, text string")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    wanted = brute_folded(more)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_removed_"]
    got = out.collect()
    assert {(r["doc_id"], i) for r in got for i in r["_removed_"]} == wanted and len(wanted) > 100
    texts = {d: t for d, t in more if d is not None}
    for r in got:
        assert all(r[c] == f"own {c}" for c in CLASHES)
        if r["doc_id"] is not None and r["text"] is not None:
            left = [x for i, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], i) not in wanted]
            assert r["text"] == "\n".join(left)
        else:
            assert r["text"] == (rows[0][1] if r["doc_id"] is None else None) or r["doc_id"] is None


def test_stage_with_clashing_columns(spark):
    import corpus_pipeline

    texts = [(1, "one two three\nfour"), (2, "one two three\nfive"), (3, "four"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(1))
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("one two three\nfour", 18), 2: ("five", 4), 4: (None, 0), 5: ("", 0)}


def test_a_group_of_near_copies_makes_few_rows(spark):
    """No line is held against all others of its group."""
    base = [f"g{i}" for i in range(30)]
    rnd = random.Random(2)
    group = [" ".join([*base[:k], f"own{i}", *base[k + 1 :]]) for i in range(1200) for k in [rnd.randrange(30)]]
    docs = spark.createDataFrame(list(enumerate(group)), "doc_id long, text string")
    got = {r["doc_id"] for r in lines.dedup_lines(docs).collect() if r["_removed"]}
    assert got == set(range(1, 1200))


def _rows_kept(monkeypatch):
    """How many rows each label of `kept` gets."""
    seen, own = Counter(), lines.kept

    def counted(df, label):
        out = own(df, label)
        if label in ("open-prefixes", "pairs", "rest", "mates"):
            seen[label] += out.count()
        return out

    monkeypatch.setattr(lines, "kept", counted)
    return seen


def test_long_lines_that_share_a_few_words_are_no_candidates(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(d, " ".join(rnd.sample([f"v{i}" for i in range(1500)], 120))) for d in range(300)]
    rows.append((300, " ".join([*rows[7][1].split(" ")[:115], *(f"own{i}" for i in range(5))])))
    seen = _rows_kept(monkeypatch)
    got = {r["doc_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["_removed"]}
    assert got == {300} and 0 < seen["open-prefixes"] < 100


@pytest.mark.parametrize("carried", [lines.CARRIED, 10])
def test_a_group_whose_first_line_decides_little_makes_few_rows(spark, monkeypatch, carried):
    """Two lines of the group are similar only if they change a word at the same place; most are not, to the earliest."""
    rnd, base = random.Random(3), [f"b{i}" for i in range(50)]
    rows = []
    for d in range(500):
        at = set(rnd.sample(range(50), 3))
        rows.append((d, " ".join(f"own{d}x{i}" if i in at else w for i, w in enumerate(base))))
    monkeypatch.setattr(lines, "CARRIED", carried)
    seen = _rows_kept(monkeypatch)
    got = {(r["doc_id"], i) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for i in r["_removed"]}
    assert got == brute(rows, 80) and len(got) > 400
    assert carried == 10 or seen["pairs"] + seen["rest"] + seen["mates"] < 40 * len(rows)


@pytest.mark.parametrize("percent", [50, 60, 75, 80])
def test_neighbours_of_crowded_words_lose_no_link(spark, monkeypatch, percent):
    """Lines of one to fourteen words of which none is rare, and of one word only."""
    rnd, texts = random.Random(percent), []
    for _ in range(110):
        own = rnd.sample([f"w{i}" for i in range(60)], rnd.randint(1, 14))
        near = [w for w in own if rnd.random() < 0.9] or own
        texts += [" ".join(own), " ".join([*near, *rnd.sample([f"w{i}" for i in range(60)], rnd.randint(0, 2))])]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(lines, "RARE", 1)
    got = {(r["doc_id"], i) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect() for i in r["_removed"]}
    assert got == brute(rows, percent) and 20 < len(got) < 200


def _rows_by_label(monkeypatch):
    """How many rows `kept` wrote, label by label, in order."""
    seen, own = [], lines.kept

    def counted(df, label):
        out = own(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(lines, "kept", counted)
    return seen


def test_keys_of_crowded_words_grow_with_the_line_not_its_square(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(d, " ".join(rnd.sample([f"v{i}" for i in range(300)], 50))) for d in range(120)]
    rows.append((120, rows[3][1].replace(" ", " own ", 1)))
    monkeypatch.setattr(lines, "RARE", 1)
    seen = _rows_by_label(monkeypatch)
    got = {r["doc_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["_removed"]}
    assert got == {120} and 0 < dict(seen)["prefixes"] <= 21 * len(rows)


def test_lines_that_only_share_a_word_with_a_candidate_go_no_further(spark, monkeypatch):
    rnd = random.Random(5)
    base, common = [f"b{i}" for i in range(30)], [f"c{i}" for i in range(60)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:29], "own"]))]
    rows += [(d, " ".join([*rnd.sample(base, 3), *rnd.sample(common, 27)])) for d in range(2, 302)]
    seen = _rows_by_label(monkeypatch)
    got = {r["doc_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["_removed"]}
    after = [n for _, n in seen[[label for label, _ in seen].index("prefixes") + 1 :]]
    assert got == {1} and max(after) < 100
