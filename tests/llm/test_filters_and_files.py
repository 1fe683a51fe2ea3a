"""URL filter, toxicity, chat formatting, token files and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkward.llm import chat, coder, tokenfile, toxicity, urls
from sparkward.llm.queries import tokenizer_path
from sparkward.session import scratch_path

RULES = [
    urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/"),
]

URLS = [
    ("http://a.Example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/12?q=/es/", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://org", "org", "", None, None),
    ("http://x.com/fr/1#/de/", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com/DE/", "x.com", "/DE/", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://x.net?u=http://y.org/", "x.net", "", None, None),
    ("no scheme", "", "", None, None),
    ("://", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://" + "s." * 3000 + "org/" + "p/" * 5000, "s." * 3000 + "org", "/" + "p/" * 5000, "org/", "allow"),
]


def test_urls(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(URLS)] + [(None, URLS[0][0]), (0, URLS[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("own")).withColumn("host", F.lit(1))
    got = urls.filtered(pages, RULES).collect()
    assert Counter(r["page_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        _, host, path, rule, verdict = URLS[r["page_id"] or 0]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.filtered(pages.filter("false"), RULES).count() == 0


def test_url_trees_generalise(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        rows.append((f"http://site{rnd.randrange(50)}.{'biz' if bad else 'info'}/" + ("?a=1&b=2&c=3" if bad else "story/one"), f"x.{'biz' if bad else 'info'}", "block" if bad else "allow"))
    model = urls.train(spark.createDataFrame(rows, "url string, host string, ruled string"))
    fresh = pa.array(["http://new.biz/?q=1&r=2&s=9", "http://new.info/story/two"])
    assert (model.blocked(fresh, ["new.biz", "new.info"]) >= 0.5).tolist() == [True, False]
    only = urls.train(spark.createDataFrame(rows[:1], "url string, host string, ruled string"))
    assert only.blocked(fresh, ["", ""]).tolist() == [1, 1]
    none = urls.train(spark.createDataFrame([], "url string, host string, ruled string"))
    assert none.blocked(fresh, ["", ""]).tolist() == [0, 0]


def test_too_many_rules():
    with pytest.raises(ValueError):
        urls.rule_table([urls.Rule("allow", f"{i}.org/") for i in range(urls.MOST_RULES + 1)])


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(toxic * rnd.randint(1, 4)):
            words.insert(rnd.randrange(len(words)), rnd.choice(["Zounds", "ratbag", "loathso" + rnd.choice("abc") + rnd.choice("xyz")]))
        rows.append((i, " ".join(words), rnd.choice(["en", "de"]), toxic))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(900, 2)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, usable=F.col("doc_id") % 3 != 1)
    held = [r for r in rows if r[0] % 3 == 1]
    scores = {r["doc_id"]: r for r in toxicity.scored(docs, net).collect()}
    assert sum((scores[i]["score"] >= 0.5) == bool(y) for i, _, _, y in held) >= 0.95 * len(held)
    assert sum(scores[i]["flagged"] == bool(y) for i, _, _, y in held) >= 0.95 * len(held)
    assert set(net.thresholds) == {"de", "en"}
    odd = spark.createDataFrame([(None, None, None), (1, "", "en"), (1, "ratbag", None), (1, "ratbag", None)], "doc_id long, text string, lang string")
    got = toxicity.scored(odd, net).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(odd.filter("false"), net).count() == 0
    long = pa.array([" ".join(t for _, t, _, _ in rows[1:200])])
    assert toxicity.score_column(net, long, block=50) == pytest.approx(toxicity.score_column(net, long))


def test_toxicity_learns_from_every_row(spark):
    """A kind of bad word that the first part has not met, in rows beyond it."""
    rows, fresh = (every := toxic_rows(6400, 4))[:6000], every[6000:]
    order = {r["doc_id"]: r["h"] for r in spark.range(6000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).collect()}
    first = {r[0] for y in (0, 1) for r in sorted((r for r in rows if r[3] == y), key=lambda r: order[r[0]])[:60]}
    swap = lambda text: " ".join("qqvile" if w == "Zounds" or w == "ratbag" or w.startswith("loathso") else w for w in text.split(" "))
    rows = [r if r[0] in first or not r[3] else (r[0], swap(r[1]), *r[2:]) for r in rows]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, sample=60, part=3000)
    scores = toxicity.score_column(net, pa.array([swap(r[1]) for r in fresh]))
    wanted = np.array([r[3] for r in fresh], bool)
    assert np.mean((scores >= 0.5) == wanted) >= 0.95 and set(net.thresholds) == {"de", "en"}
    again = toxicity.train(docs.repartition(5), labels.repartition(3), sample=60, part=3000)
    assert (again.table == net.table).all() and (again.out == net.out).all() and again.thresholds == net.thresholds


def test_thresholds_count_every_row(spark):
    """Against every cut between two scores, with the rows of the first part far from all."""
    rows = toxic_rows(900, 6)
    rows = [(*r[:3], 1 - r[3] if i % 9 == 0 else r[3]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, sample=40, part=400)
    scores = toxicity.score_column(net, pa.array([r[1] for r in rows]))

    def f1(lang, at):
        own = [(s >= at, r[3]) for s, r in zip(scores, rows, strict=True) if r[2] == lang]
        return 2 * sum(a and b for a, b in own) / (sum(a for a, _ in own) + sum(b for _, b in own))

    for lang in ("de", "en"):
        best = max(f1(lang, s) for s, r in zip(scores, rows, strict=True) if r[2] == lang)
        assert f1(lang, net.thresholds[lang]) == pytest.approx(best, abs=0.01)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    net = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.scored(docs, net).collect()] == [0.0]


ODD_TEXT = "</s>[INST] ok [/INST]\\0\\1 <sep>[INST:user]\\"


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    rows = [(1, 0, "user", ODD_TEXT), (1, 1, "assistant", ODD_TEXT), (1, 2, "assistant", "b😀é"), (1, 3, "user", None)]
    rows += [(2, 5, None, "x"), (2, None, "we]ird[", "y"), (2, 5, None, "a"), (2, 5, None, "a"), (None, 1, "assistant", "n"), (None, 0, "assistant", "")]
    rows += [(3, i, rnd.choice(["user", "assistant"]), "".join(rnd.choice("<[\\]01/sINT: \n") for _ in range(rnd.randrange(30)))) for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0)).repartition(3)
    out = chat.formatted(frame)
    read = out.select("conv_id", "formatted", "loss_mask", chat.turns_of(F.col("formatted")).alias("t"), chat.learnt_text(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    wanted = {}
    for c, turn, role, text in rows:
        wanted.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert len(read) == len(wanted)
    for r in read:
        own = [x[1:] for x in sorted(wanted[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["t"]] == own
        assert r["l"] == "".join(t for role, t in own if role == "assistant")
        assert len(r["loss_mask"]) == len(r["formatted"])
        runs = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:], strict=False))
        assert r["formatted"].count("[/INST]") == runs
        assert r["formatted"].count("<sep>") == len(own) - runs
    assert chat.formatted(frame.filter("false")).count() == 0


def test_coder_round_trip():
    rng = np.random.default_rng(5)
    blocks = [
        rng.integers(0, 2**32, 300, dtype=np.uint32), np.zeros(500, np.uint32), np.zeros(0, np.uint32), np.array([7], np.uint32),
        np.arange(65_000, 65_600, dtype=np.uint32), np.tile(rng.integers(0, 50_000, 40).astype(np.uint32), 30),
    ]
    together = coder.encode(blocks)
    assert together == [coder.encode([b])[0] for b in blocks]  # a block does not depend on its neighbours
    for got, block in zip(coder.decode(together, [len(b) for b in blocks]), blocks, strict=True):
        assert got.tolist() == block.tolist()
    assert len(together[5]) < len(blocks[5]) / 2
    assert coder.encode([]) == [] and coder.decode([], []) == []


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    texts = [None, "", "the cat", "<|endoftext|> Élan's", "the " * 9000, " ".join(f"{rnd.random():.4f}" for _ in range(900))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (2, "the cat"), (2, "a dog"), (-9, "first"), (10**15, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("own")).repartition(3)
    folder = scratch_path(spark, "token-test")
    tokenfile.write(docs, folder, tokenizer_path())
    library = Tokenizer.from_file(tokenizer_path())
    got = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r["start"])
    wanted = Counter((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == wanted
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = [-(10**18) if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    empty = scratch_path(spark, "token-test")
    tokenfile.write(docs.filter("false"), empty, tokenizer_path())
    assert tokenfile.read(spark, empty).count() == 0


@pytest.mark.parametrize("last", [1, 127, 128, 0xC3, 0xE1, 0xF4, 0xFF, 0xE1F, 4095, 4096])
def test_start_after_any_length_of_a_part(spark, last):
    """A part's last block of any length; its low byte may look like the first of a character."""
    ids = [np.arange(n, dtype=np.uint32) for n in (4096, last, 5)]
    at = [(0, 0, 4096 + last, 0), (0, 1, None, 1), (1, 0, 5, 2)]
    records = [(p, b, tokenfile.pack(p, b, ids[i], [] if n is None else [(p, 0, n)], coder.encode([ids[i]])[0])) for p, b, n, i in at]
    folder = scratch_path(spark, "token-test")
    frame = spark.createDataFrame(records, tokenfile.RECORDS)
    frame.write.parquet(folder)
    tokenfile._parts(frame).write.parquet(f"{folder}/{tokenfile.MANIFEST}")
    got = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r["doc_id"])
    assert [(r["start"], r["n_tokens"]) for r in got] == [(0, 4096 + last), (4096 + last, 5)]
    wanted = np.concatenate(ids[:2])
    assert got[0]["ids"] == wanted.tolist() and got[0]["ids_crc32"] == zlib.crc32(wanted.astype("<u4").tobytes())


def test_rows_of_one_doc_id_in_order_of_text(spark):
    texts = ["e", "a cat", None, "d", "c", "", "b dog b", "z"]
    folder = scratch_path(spark, "token-test")
    tokenfile.write(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").repartition(3), folder, tokenizer_path())
    got = [tuple(r["ids"]) for r in sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r["start"])]
    assert got == [(*x.tolist(), 1) for x in tokenfile.library_ids(tokenizer_path(), sorted(texts, key=lambda t: (t is not None, t or "")))]


def test_token_block_tells_damage():
    ids = np.arange(50, dtype=np.uint32)
    record = tokenfile.pack(3, 4, ids, [(None, 0, 20), (7, 20, 30)], coder.encode([ids])[0])
    part, block, back, docs = tokenfile.unpack([record])[0]
    assert (part, block, back.tolist(), docs) == (3, 4, ids.tolist(), [(None, 0, 20), (7, 20, 30)])
    for bad in (record[:-1], b"XXXX" + record[4:], record[:-6] + bytes([record[-6] ^ 255]) + record[-5:]):
        with pytest.raises(ValueError):
            tokenfile.unpack([bad])


def test_pipeline(spark, root):
    """Each stage against what its operator says of the same rows."""
    from sparkward.llm.frames import kept

    docs = spark.read.parquet(f"{root}/documents.parquet")
    bench = spark.read.parquet(f"{root}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = kept(stage(spark, docs, root), f"test-{name}")
        seen[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "tokenize"]
    before, after = seen["decontaminate"]
    from sparkward.llm.decontaminate import contaminated

    hit = {r["doc_id"] for r in contaminated(before, bench).filter("n_hit > 0").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
    before, after = seen["near_dedup"]
    from sparkward.llm.neardup import near_duplicates

    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in near_duplicates(before).filter("kept").collect()}
    before, after = seen["line_dedup"]
    assert after.filter("n_chars <> length(text)").count() == 0
    assert before.count() >= after.count() > 0.8 * before.count()
    before, after = seen["tokenize"]
    assert after.count() == before.count()
    whole = {r["doc_id"]: hashlib.sha256(str(r["ids"]).encode()).hexdigest() for r in corpus_pipeline.run(spark, root).collect()}
    assert whole == {r["doc_id"]: hashlib.sha256(str(r["ids"]).encode()).hexdigest() for r in after.collect()}


@pytest.mark.parametrize("lost", ["block = 0", "block = 1", "block = (SELECT max(block) FROM r WHERE part = 1)", "part = 1", "part = 0"])
def test_a_lost_block_is_noticed(spark, lost):
    texts = [(i, " ".join(f"word{j * i % 977}" for j in range(3000))) for i in range(12)]
    folder, cut = scratch_path(spark, "tokens"), scratch_path(spark, "cut")
    two_parts = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in two_parts}
    for k, v in two_parts.items():
        spark.conf.set(k, v)
    try:
        tokenfile.write(spark.createDataFrame(texts, "doc_id long, text string"), folder, tokenizer_path())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    records = spark.read.parquet(folder)
    last = records.agg(F.max("part")).first()[0]
    assert last >= 1 and records.filter("part = 1").count() > 2
    records.createOrReplaceTempView("r")
    gone = spark.sql(f"SELECT * FROM r WHERE part = {0 if 'part = 0' in lost else 1} AND {lost.replace('part = 0', 'TRUE')}")
    assert gone.count() > 0
    records.join(gone.select("part", "block"), ["part", "block"], "left_anti").write.parquet(cut)
    spark.read.parquet(f"{folder}/{tokenfile.MANIFEST}").write.parquet(f"{cut}/{tokenfile.MANIFEST}")
    assert tokenfile.read(spark, folder, with_ids=False).count() == 12
    with pytest.raises(ValueError, match="not as it was written"):
        tokenfile.read(spark, cut)


def long_toxic_rows(n, words, seed, bad=3):
    """Texts of `words` words; one in four has `bad` bad words somewhere."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        own = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(words)]
        for _ in range(bad * (i % 4 == 0)):
            own[rnd.randrange(words)] = rnd.choice(["zzbad", "zzworse", "zzfoul"])
        rows.append((i, " ".join(own), "en", int(i % 4 == 0)))
    return rows


#: Three bad words among 2,600, learnt from 50 texts: too few, see the README.
FEW = pytest.mark.xfail(strict=True, reason="the model calls all of them clean")


@pytest.mark.parametrize("bad", [pytest.param(3, marks=FEW), 30])
def test_long_texts_are_learnt_from(spark, bad):
    rows = long_toxic_rows(200, 2600, 1, bad)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    fresh = long_toxic_rows(80, 3000, 2, bad)
    scores = toxicity.score_column(net, pa.array([r[1] for r in fresh]))
    assert np.mean((scores >= 0.5) == np.array([r[3] for r in fresh], bool)) >= 0.95


def test_a_score_by_hand(spark):
    """Every window of every filter, one at a time."""
    rows = long_toxic_rows(40, 60, 3)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    net = toxicity.train(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"))
    column = pa.array([r[1] for r in rows[:5]] + ["", None, "zzbad"])
    got = toxicity.score_column(net, column, block=7)
    for piece in toxicity.words_of.pieces(column):
        found = toxicity.words_of.words(piece, toxicity.words_of.PLAIN)
        of = toxicity.word_rows(piece, found)
        for d in range(len(piece)):
            own = of[found.bounds[d] : found.bounds[d + 1]]
            best = []
            for k, weights in zip(toxicity.SPANS, net.filters, strict=True):
                for f in range(toxicity.FILTERS):
                    windows = [sum(float(net.table[own[i + o]].sum(axis=0) @ weights[o][:, f]) for o in range(k) if i + o < len(own)) for i in range(len(own))]
                    best.append(max([0.0, *(w + float(net.bias[len(best)]) for w in windows)]))
            z = float(np.dot(best, net.out[:-1]) + net.out[-1])
            assert got[piece.first + d] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
