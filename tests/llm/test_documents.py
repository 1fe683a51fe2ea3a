"""Decontamination, near duplicates, line dedup, quality, BPE and licenses against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkward.llm import bpe, decontaminate, licenses, lines, neardup, quality
from sparkward.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"w{i}" for i in range(300)] + ["the", "of", "Été", "naïve", "x,", "END."]


def sentence(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) with nulls, empty and long texts, copies, near copies, shared lines and repeated rows."""
    rnd = random.Random(11)
    rows = [(i, "\n".join(sentence(rnd, rnd.randint(3, 40)) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    base, line = sentence(rnd, 70), sentence(rnd, 12)
    for i in range(100, 160):  # one large group of near copies, some of them far from each other
        own = base.split(" ")
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = rnd.choice(VOCABULARY)
        rows.append((i, " ".join(own)))
    rows += [(i, rows[3][1]) for i in range(200, 215)]
    rows += [(i, f"{line}\n{sentence(rnd, 20)}\n\n{line}") for i in range(300, 320)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "one"), (405, "one two"), (406, "ONE two")]
    rows += [(None, rows[3][1]), (None, None), (407, sentence(rnd, 30_000)), (-5, base), rows[7], rows[7], (8, rows[9][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    frame = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    for name in ("bands", "key", "h", "n_words", "items", "kept", "ids", "_removed2", "label", "node"):
        frame = frame.withColumn(name, F.lit(1))
    return frame


@pytest.fixture
def nothing(docs):
    return docs.filter("false")


# near duplicates


def shingles(text, k):
    own = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))] if text else []
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))) if own else frozenset()


def grouped(rows, k, percent):
    known = [(d, shingles(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {d: top(d) for d in root}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, corpus, k, percent):
    wanted = grouped(corpus, k, percent)
    got = neardup.near_duplicates(docs, k, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((d, len(shingles(t, k))) for d, t in corpus)
    for r in got:
        assert r["component_id"] == wanted.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def test_near_duplicates_in_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 500)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == {**grouped(corpus, 3, 85), None: None}


def test_drop_near_duplicates_keeps_one_and_all_columns(docs, corpus, nothing):
    wanted = grouped(corpus, 5, 80)
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter((d, t) for d, t in corpus if d is None or wanted[d] == d)
    assert neardup.drop_near_duplicates(nothing).count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for shared in (0, 30, 150, 190):
        pairs = []
        for _ in range(20):
            own = rng.permutation(pool)[: 400 - shared]
            pairs += [np.unique(own[:200]), np.unique(own[200 - shared :])]
        sign = neardup.superminhash(pairs, 192)
        same = (sign[::2] == sign[1::2]).mean()
        assert same == pytest.approx(shared / (400 - shared), abs=0.03)
    one = neardup.superminhash([pool[:500]], 192)
    assert (neardup.superminhash([pool[:500]], 192, block=64) == one).all()
    assert (neardup.superminhash([np.zeros(0, np.uint64)], 8) == np.iinfo(np.uint64).max).all()


# decontamination


def benchmark_rows(corpus):
    by = {d: t for d, t in corpus}
    own = (by[5] or "").split()
    return [(1, " ".join(own[2:20]).upper()), (2, "one two"), (3, None), (4, ""), (None, "w1"), (5, " ".join(own[2:20])), (6, "never-seen words"), (6, "one two")]


def brute_hits(text, items, size):
    own, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
    for item, t in items:
        words = WORD.findall((t or "").translate(LOW)) if item is not None else []
        k = min(size, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            for at in range(len(own) - k + 1):
                if own[at : at + k] == words[i : i + k]:
                    hit.update(range(at, at + k))
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [decontaminate.AUTOMATON_BYTES, 30])
def test_contaminated(spark, docs, corpus, limit):
    items = benchmark_rows(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    short = [(d, t) for d, t in corpus if len(t or "") < 5000]
    got = decontaminate.contaminated(docs.filter("text IS NULL OR length(text) < 5000"), bench, 10, limit).collect()
    wanted = Counter((d, *map(str, brute_hits(t, items, 10))) for d, t in short)
    assert Counter((r["doc_id"], *map(str, (r["n_words"], r["n_hit"], r["items"]))) for r in got) == wanted
    texts = dict(short)
    for r in got:
        if r["doc_id"] == 5:
            spans = [texts[5][s["start"] : s["end"]] for s in r["spans"]]
            assert sum(len(WORD.findall(s.translate(LOW))) for s in spans) == r["n_hit"] > 0


def test_drop_contaminated(spark, docs, corpus, nothing):
    items = benchmark_rows(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    clean = [(d, t) for d, t in corpus if d == 407 or not brute_hits(t, items, 10)[1]]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(clean)
    assert decontaminate.drop_contaminated(nothing, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.filter("false")).count() == len(corpus)


# line dedup


def brute_lines(rows, percent):
    seen, all_lines = set(), []
    for d, t in rows:
        if d is not None and t is not None:
            for pos, line in enumerate(t.split("\n")):
                if re.search(r"\S", line) and (d, pos, line) not in seen:
                    seen.add((d, pos, line))
                    own = [w for w in line.split(" ") if w]
                    tokens = frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)))
                    all_lines.append((d, pos, line, tokens))
    gone = set()
    for d, pos, line, tokens in all_lines:
        for e, at, other, others in all_lines:
            if (e, at) < (d, pos) and (line == other or 100 * len(tokens & others) >= percent * len(tokens | others)):
                gone.add((d, pos, line))
    return gone


def test_lines(docs, corpus, nothing):
    gone = brute_lines(corpus, 80)
    out = lines.dedup_lines(docs, by_word=False, folded=False)
    assert out.columns == [*docs.columns, "_removed"]
    wanted = Counter()
    for d, t in corpus:
        own = [] if t is None else t.split("\n")
        at = [i for i, line in enumerate(own) if (d, i, line) in gone]
        wanted[d, t if t is None else "\n".join(x for i, x in enumerate(own) if i not in at), str(at)] += 1
    assert Counter((r["doc_id"], r["text"], str(r["_removed"])) for r in out.collect()) == wanted
    assert any(len(x[2]) > 2 for x in wanted)
    assert lines.dedup_lines(nothing).count() == 0


def test_lines_run_without_python(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# quality


def brute_counts(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count, cover, seen, dup = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2)), set(), set(), 0
    for i in range(len(own) - 2):
        if count[tuple(own[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_counts(spark, docs, corpus, nothing):
    more = [(900, "a a a a a"), (901, "#é# ü|\n" * 40), (902, "a b\n" * 3 + "\n\n x"), (903, "é" * 3000 + " $" * 200)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r["doc_id"], *(r[c] for c in quality.COUNTS[:5])) for r in quality.counted(frame).collect())
    assert got == Counter((d, *brute_counts(t)) for d, t in [*corpus, *more])
    assert quality.counted(nothing).count() == 0


def test_quality_verdicts(spark, root):
    table = spark.read.parquet(f"{root}/documents.parquet").withColumn("score", F.lit("x"))
    labels = spark.read.parquet(f"{root}/labels.parquet")
    model = quality.train(table, labels)
    rows = quality.judged(table, model).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
    kept = {r["doc_id"] for r in quality.judged(table, model).filter("kept").collect()}
    out = quality.drop_bad(table, model)
    assert out.columns == table.columns
    assert {r["doc_id"] for r in out.collect()} == kept


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    rows = quality.judged(docs, None).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)


# BPE

ODD = ["<|startoftext|>hi<|endoftext|>there", "a<|startoftext|>'s I'll we've", "</w>the</w>", "x" * 3000, "ΣΑΣ İı ß ﬁ Å Å 한 １２³", "a\x1cb\x85c\xa0d\u2028e\u200bf", "👨‍👩‍👧 naïve—“quoted” #$%^", "\x00\x01"]


def test_bpe_is_the_library(spark, docs, corpus, nothing):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    signs = "aabcdeinorst  \n\t'sStTrRmMlLdDéÉßΣςİ１2³①<|>/w\x1c한字😀-_.,!?#\x00\x7f"
    made = ["".join(rnd.choice(signs) for _ in range(rnd.choice([1, 5, 60]))) for _ in range(400)]
    rows = [*corpus, *((10_000 + i, t) for i, t in enumerate([*ODD, *made]))]
    library = Tokenizer.from_file(tokenizer_path())
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(corpus) :], "doc_id long, text string"))
    wanted = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted[d, str(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], str(r["ids"]), r["decoded"]) for r in bpe.encoded(frame, tokenizer_path()).collect()) == wanted
    assert bpe.encoded(nothing, tokenizer_path()).count() == 0


def test_bpe_decodes_in_parts(monkeypatch):
    import pyarrow as pa

    with open(tokenizer_path(), encoding="utf-8") as f:
        tokenizer, words = bpe.tokenizer_of(f.read())
    ids = bpe.encode_column(pa.array(["the cat", None, "", "naïve"] * 5), words)
    whole = tokenizer.decode(ids).to_pylist()
    monkeypatch.setattr(bpe, "DECODED", 2)
    assert tokenizer.decode(ids).to_pylist() == whole == ["the</w> cat</w>", "", "", whole[3]] * 5


# licenses


def test_licenses(spark, docs, corpus, nothing):
    phrases = {t.label: t.text.split() for t in licenses.PHRASES}
    notice = "Permission is hereby granted, free of any charge, to any person obtaining a copy of this fine software!"
    more = [(700, "MIT License. x mit-license Apache license cc-by"), (701, "GNU General Public"), (702, notice), (703, "mit"), (704, "All rights reserved"), (700, "MIT")]
    rows = [*corpus, *more]
    frame = docs.select("doc_id", "text", "h").unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, h int"))
    got = Counter()
    for r in licenses.scanned(frame).collect():
        got[r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], str(r["base_labels"])] += 1
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
        if r["doc_id"] == 702:
            assert r["labels"] == ["mit"] and not r["base_labels"]
    wanted = Counter()
    for d, t in rows:
        own = WORD.findall((t or "").translate(LOW))
        at = [(i, label) for label, p in phrases.items() for i in range(len(own)) if own[i : i + len(p)] == p]
        first = [i for i, _ in sorted(at)]
        wanted[d, len(own), len(at), first[0] if at else None, first[-1] if at else None, str(sorted({x for _, x in at}))] += 1
    assert got == wanted
    assert licenses.scanned(nothing).count() == 0


def test_too_many_templates():
    with pytest.raises(ValueError):
        licenses.template_grams([licenses.Template("x", "a b " * 60_000)])


def test_brute_force_sees_groups(corpus):
    groups = defaultdict(set)
    for d, top in grouped(corpus, 3, 85).items():
        groups[top].add(d)
    assert sorted(map(len, groups.values()))[-1] > 10
