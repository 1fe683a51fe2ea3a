"""Toxicity by a small convolutional text classifier in numpy.

Words are runs of digits, letters and everything beyond ASCII, A-Z lower-cased. A word's
vector is the sum of three rows of a hashed embedding table: for the word, for its first
four and for its first six bytes, so new words of a known kind are recognised. Filters of
several widths slide over the words of the whole text; each filter's highest answer counts
(max pooling), and a logistic layer gives the score. A text without words gets the score
that no filter answers to.

Every labelled row that has words is learnt from. Training starts with Adam on a first part: at
most `sample` rows of each kind, those whose ids hash lowest, and of these as many, in that order,
as have `words` words together (one at least; of a longer one its first `words`). If that is not
all rows whole, passes over all rows follow: they are dealt out to parts by a hash, a task goes on
with the network over its part in small steps, and the networks are averaged by their rows, in
integers, so that no order matters. A text is learnt from whole, however long: in each epoch the
stretch of PIECE words that the filters answer most to stands for it, as it does in the pooling
of its score. Only text enters a score. Thresholds are then calibrated by language on all rows
learnt from: `flagged` tells whether the score reaches the threshold of the row's language.
Without labels of both kinds every score is the share of label 1, or 0. Null texts have no words;
rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.llm import text as words_of
from sparkward.llm.frames import discard, ids_schema, kept, map_batches
from sparkward.llm.sketch import may_hold, sketch

BUCKETS, WIDTH, FILTERS, SPANS = 1 << 15, 16, 12, (1, 2, 3)
PREFIXES = (4, 6)
SAMPLE, WORDS, EPOCHS = 1500, 2_000_000, 16
#: Words of a long text that take part in one step.
PIECE = 2000
#: Rows of a part in a pass over all rows, passes, and how far a step goes in them.
PART, PASSES, PASS_RATE, BATCH = 8192, 2, 0.005, 64
#: How many tasks add up the networks of the parts, and the unit they add in.
SUMS, UNIT = 4, 2.0**-20
#: Cells of log-odds that thresholds are told apart by.
CELLS = 1024
#: Training ends early once an epoch's mean loss is under this.
DONE = 0.005


def word_rows(piece: words_of.Piece, found: words_of.Words) -> np.ndarray:
    """[word, 3] rows of the embedding table: the word, its first four and its first six bytes."""
    out = [found.hash % np.uint64(BUCKETS)]
    for n, prefix in enumerate(PREFIXES):
        code = np.zeros(len(found.hash), np.uint64)
        for i in range(prefix):
            at = found.start + i
            inside = at < found.end
            code[inside] = code[inside] * np.uint64(257) + words_of.PLAIN.folded[piece.data[at[inside]]].astype(np.uint64) + np.uint64(1)
        out.append(words_of.mix(code + np.uint64(n + 1)) % np.uint64(BUCKETS))
    return np.stack(out, axis=1).astype(np.int32)


@dataclass
class Network:
    table: np.ndarray  # [BUCKETS, WIDTH]
    filters: list[np.ndarray]  # for each span [span, WIDTH, FILTERS]
    bias: np.ndarray  # [spans * FILTERS]
    out: np.ndarray  # [spans * FILTERS + 1], the last is the constant
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def params(self) -> list[np.ndarray]:
        return [self.table, *self.filters, self.bias, self.out]

    def packed(self) -> np.ndarray:
        """All parameters, in units."""
        return np.rint(np.concatenate([p.ravel() for p in self.params()]).astype(float) / UNIT).astype(np.int64)

    def unpacked(self, units: np.ndarray) -> Network:
        """The network of this shape with these parameters."""
        made, at = [], 0
        for p in self.params():
            made.append((units[at : at + p.size] * UNIT).astype(p.dtype).reshape(p.shape))
            at += p.size
        return Network(made[0], made[1:-2], made[-2], made[-1], self.constant)

    def answers(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(vectors, for each span the filters' answers at every word); missing words count as zero."""
        vectors = self.table[rows].sum(axis=1)
        end = np.repeat(bounds[1:], np.diff(bounds))
        found = []
        for k, weights in zip(SPANS, self.filters, strict=True):
            total = vectors @ weights[0]
            for o in range(1, k):
                has = np.flatnonzero(np.arange(len(rows)) + o < end)
                total[has] += vectors[has + o] @ weights[o]
            found.append(total)
        return vectors, found

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """[document, spans * FILTERS]: each filter's highest answer, at least 0."""
        out = np.zeros((len(bounds) - 1, len(self.bias)), np.float32)
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            _, found = self.answers(rows, bounds)
            best = np.concatenate([np.maximum.reduceat(f, bounds[full]) for f in found], axis=1)
            out[full] = np.maximum(best + self.bias, 0)
        return out

    def score(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        z = self.pooled(rows, bounds) @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def score_column(net: Network, column: pa.Array, block: int = 1 << 15) -> np.ndarray:
    """The score of each whole text. A long text is pooled by blocks of words that overlap by a filter's width."""
    scores = [np.zeros(0)]
    for piece in words_of.pieces(column, 1 << 18):
        found = words_of.words(piece, words_of.PLAIN)
        rows = word_rows(piece, found)
        if len(piece) > 1 or len(rows) <= block or net.constant is not None:
            scores.append(net.score(rows, found.bounds))
            continue
        scores.append(long_score(net, rows, block))
    return np.concatenate(scores)


def cut(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Stretches of `size` words, each with the words that a filter at its end reaches into."""
    return [rows[at : at + size + max(SPANS) - 1] for at in range(0, max(1, len(rows)), size)]


def long_score(net: Network, rows: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The score of one text, pooled over its blocks."""
    if net.constant is not None:
        return np.array([net.constant])
    best = np.maximum.reduce([net.pooled(p, np.array([0, len(p)])) for p in cut(rows, block)])
    z = best @ net.out[:-1] + net.out[-1]
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def loudest(net: Network, pieces: list[np.ndarray]) -> np.ndarray:
    """The stretch of a text with the highest score."""
    if len(pieces) == 1:
        return pieces[0]
    bounds = np.cumsum([0, *(len(p) for p in pieces)])
    return pieces[int(net.score(np.concatenate(pieces), bounds).argmax())]


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.01, seed: int = 1) -> Network:
    """texts: word_rows of each whole document."""
    pieces = [cut(t, PIECE) for t in texts]
    if len(set(y.tolist())) < 2:
        blank = Network(np.zeros((1, 1)), [], np.zeros(0), np.zeros(1))
        blank.constant = float(y[0]) if len(y) else 0.0
        return blank
    rng = np.random.default_rng(seed)
    width = len(SPANS) * FILTERS
    net = Network(
        rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32),
        [rng.normal(0, 0.3, (k, WIDTH, FILTERS)).astype(np.float32) for k in SPANS],
        np.zeros(width, np.float32),
        np.append(rng.normal(0, 0.3, width), 0).astype(np.float32),
    )
    learner, losses = Learner(net, rate, rng), [np.inf]
    for _ in range(epochs):
        if np.mean(losses) < DONE:
            break
        order, losses = rng.permutation(len(texts)), []
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            losses.append(learner.step([pieces[i] for i in picked], y[picked]))
    return net


class Learner:
    """Adam on a network, which it changes."""

    def __init__(self, net: Network, rate: float, rng: np.random.Generator):
        self.net, self.rate, self.rng, self.steps = net, rate, rng, 0
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.params()]

    def step(self, pieces: list[list[np.ndarray]], y: np.ndarray) -> float:
        """The mean loss before the step. pieces: each text, cut."""
        net, rate = self.net, self.rate
        loss, grads = _gradients(net, [_without_words(loudest(net, p), self.rng) for p in pieces], y)
        self.steps += 1
        for p, g, (m, v) in zip(net.params(), grads, self.moments, strict=True):
            if isinstance(g, tuple):  # rows of the table that took part
                rows, g = g
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.99 * v[rows] + 0.01 * g * g
                p[rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-6)
            else:
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)
        return loss


def _without_words(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the words are replaced by the row of an unknown word, so that their prefixes are learnt."""
    rows = rows.copy()
    rows[rng.random(len(rows)) < 0.5, 0] = 0
    return rows


def _gradients(net: Network, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, list]:
    """The mean loss, and the gradients of the mean logistic loss; only the word windows that won the pooling take part."""
    rows = np.concatenate(texts)
    bounds = np.cumsum([0, *(len(t) for t in texts)])
    vectors, found = net.answers(rows, bounds)
    n = len(texts)
    won = np.zeros((n, len(net.bias)), np.int64)
    best = np.zeros((n, len(net.bias)), np.float32)
    for d in range(n):
        a, b = bounds[d], bounds[d + 1]
        for s, f in enumerate(found):
            top = f[a:b].argmax(axis=0)
            cols = slice(s * FILTERS, (s + 1) * FILTERS)
            won[d, cols] = top + a
            best[d, cols] = f[a:b][top, np.arange(FILTERS)]
    best += net.bias
    pooled = np.maximum(best, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out[:-1] + net.out[-1], -30, 30)))
    error = ((p - y) / n).astype(np.float32)
    g_out = np.append(error @ pooled, error.sum()) + 1e-4 * net.out
    g_pool = error[:, None] * net.out[:-1] * (best > 0)
    g_filters, at_rows, at_grads = [], [], []
    for s, (k, weights) in enumerate(zip(SPANS, net.filters, strict=True)):
        cols = slice(s * FILTERS, (s + 1) * FILTERS)
        g, where = g_pool[:, cols], won[:, cols]
        g_w = np.zeros_like(weights)
        for o in range(k):
            place = where + o
            has = place < bounds[1:, None]
            place = np.where(has, place, 0)
            gh = g * has
            g_w[o] = np.einsum("df,dfw->wf", gh, vectors[place])
            live = np.nonzero(gh)
            back = gh[live][:, None] * weights[o][:, live[1]].T
            for c in range(rows.shape[1]):
                at_rows.append(rows[place[live], c])
                at_grads.append(back)
        g_filters.append(g_w)
    ids, inverse = np.unique(np.concatenate(at_rows), return_inverse=True)
    g_table = np.zeros((len(ids), WIDTH), np.float32)
    np.add.at(g_table, inverse, np.concatenate(at_grads))
    q = np.clip(np.where(y > 0.5, p, 1 - p), 1e-7, 1)
    return float(-np.log(q).mean()), [(ids, g_table), *g_filters, g_pool.sum(axis=0), g_out]


def labelled(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(doc_id, lang, _y, text): all rows that may be learnt from and have words. Kept; most texts without a label aren't shuffled."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("_y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & usable)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    bits = kept(sketch(known, "doc_id"), "toxicity-sketch")
    read = read.filter(may_hold(bits, "doc_id") & F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    rows = kept(read.join(known, "doc_id").select("doc_id", "lang", "_y", "text"), "toxicity-rows")
    discard(bits)
    return rows


def word_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """word_rows of each whole text."""
    for piece in words_of.pieces(column):
        found = words_of.words(piece, words_of.PLAIN)
        rows = word_rows(piece, found)
        for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
            yield rows[a:b]


def first_part(rows: DataFrame, sample: int, words: int) -> pa.Table:
    """(y, rows) of at most `sample` rows and about `words` words of each label."""
    first = lambda y: rows.select("doc_id", "_y").filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = first(0).unionByName(first(1)).distinct()

    def make():
        def run(batch: pa.RecordBatch) -> list:
            own = [t[:words].ravel() for t in word_lists(batch.column(2))]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            return [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *own]))]

        return run

    texts = rows.join(picked, ["doc_id", "_y"], "left_semi").select("doc_id", "_y", "text")
    joined = map_batches(texts, make, ids_schema("_y int, rows array<int>"))
    # A few thousand rows by now; counted in the order they were drawn in, so that no length is preferred.
    drawn = Window.partitionBy("_y").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("rows")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("rows") / (1 + len(PREFIXES))).over(drawn), F.lit(0.0))
    joined = joined.withColumn("_before", before).filter(F.col("_before") < words).drop("_before")
    return joined.orderBy("doc_id", "_y", F.xxhash64("rows")).limit(4 * sample).toArrow()


def passed(rows: DataFrame, n: int, net: Network, number: int, size: int = PART) -> Network:
    """The network after one pass over all `n` rows, learnt part by part and averaged."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value.packed()
        net = sent.value.unpacked(start)
        learner = Learner(net, PASS_RATE, np.random.default_rng([number, TaskContext.get().partitionId()]))
        seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                learner.step([cut(t, PIECE) for t in word_lists(some.column(1))], some.column(0).to_numpy().astype(np.float32))
                seen += some.num_rows
        if seen:  # what has changed: nothing for words that took no part, so that little is written
            moved = (net.packed() - start) * seen
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([moved.tobytes()], pa.binary())], ["n", "units"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, np.int64)
        for batch in batches:
            for own, units in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, total = n + own, np.frombuffer(units.as_buffer(), np.int64) + (total if n else 0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "units"])

    # an order of the rows alone, so that reruns agree
    dealt = rows.repartition(-(-n // size), "doc_id", "text").sortWithinPartitions(F.xxhash64("doc_id", F.lit(number)), "doc_id", "_y", "text")
    nets = kept(dealt.select("_y", "text").mapInArrow(learn, "n long, units binary"), "toxicity-parts")
    sums = nets.repartition(SUMS).mapInArrow(add, "n long, units binary").collect()
    discard(nets)
    moved = sum(np.frombuffer(r["units"], np.int64) for r in sums)
    return net.unpacked(net.packed() + np.rint(moved / sum(r["n"] for r in sums)))


def calibrated(rows: DataFrame, net: Network) -> dict[str, float]:
    """For each language with both labels the threshold with the highest F1 over all rows; the middle of the gap it lies in.

    Rows are counted by cells of log-odds; thresholds lie between cells.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def make():
        return lambda batch: [batch.column(0), batch.column(1), score_column(sent.value, batch.column(2))]

    scores = map_batches(rows.select("lang", "_y", "text"), make, T.StructType.fromDDL("lang string, y int, score double"))
    cell = F.floor(F.log(F.col("score") / (1 - F.col("score"))) * CELLS)
    cells = scores.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"), F.min("score").alias("least"), F.max("score").alias("most"))
    down = Window.partitionBy("lang").orderBy(F.desc("cell"))
    every = Window.partitionBy("lang")
    run = down.rowsBetween(Window.unboundedPreceding, 0)
    told = cells.select(
        "lang",
        "cell",
        F.sum("hits").over(every).alias("ones"),
        F.sum("n").over(every).alias("rows"),
        (2 * F.sum("hits").over(run) / (F.sum("n").over(run) + F.sum("hits").over(every))).alias("f1"),
        ((F.col("least") + F.coalesce(F.lead("most").over(down), F.lit(0.0))) / 2).alias("threshold"),
    ).filter("0 < ones AND ones < rows")
    best = told.groupBy("lang").agg(F.max(F.struct("f1", "cell", "threshold"))["threshold"].alias("threshold"))
    return {r["lang"]: r["threshold"] for r in best.orderBy("lang").collect()}


def known_share(labels: DataFrame, usable: Column) -> float:
    """The share of label 1 among the rows that may be learnt from."""
    one, every = labels.filter(F.col("toxic").isin(0, 1) & usable).agg(F.sum(F.col("toxic").cast("long")), F.count("*")).first()
    return (one + 1) / (every + 2)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, words: int = WORDS, part: int = PART) -> Network:
    """usable: which label rows may be learnt from, by doc_id; sample, words: what the first part holds; part: rows of the others."""
    usable = F.lit(True) if usable is None else usable
    rows = labelled(docs, labels, usable)
    table = first_part(rows, sample, words)
    texts = [np.asarray(r.values.to_numpy(zero_copy_only=False)).reshape(-1, 1 + len(PREFIXES)) for r in table.column("rows")]
    y = table.column("_y").to_numpy().astype(np.float32)
    net = fit(texts, y)
    if net.constant is None:
        # the first part holds as many of each kind; the score is to hold for labels as they come
        share = known_share(labels, usable)
        net.out[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
        n, size = rows.count(), np.array([len(t) for t in texts])
        if n > len(texts) or max(size[y == 0].sum(), size[y == 1].sum()) >= words:
            for number in range(PASSES):
                net = passed(rows, n, net, number, part)
        net.thresholds = calibrated(rows, net)
    discard(rows)
    return net


def scored(docs: DataFrame, net: Network, default: float = 0.7) -> DataFrame:
    """(doc_id, score, flagged) for every row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))

    def make():
        def run(batch: pa.RecordBatch) -> list:
            net = sent.value
            score = score_column(net, batch.column(1))
            least = [net.thresholds.get(code, default) for code in batch.column(2).to_pylist()]
            return [batch.column(0), score, score >= np.array(least)]

        return run

    return map_batches(read, make, T.StructType.fromDDL("doc_id long, score double, flagged boolean"))
