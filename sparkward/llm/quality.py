"""Quality rules: fixed rules first, then boosted trees over document statistics.

Words are what stands between white space. The statistics are of the whole text. A
document fails the base rules with fewer than `LEAST_WORDS` words, or if more than
`MOST_REPEATED` percent of its words stand in three-word windows that occur twice or
more. The others are scored by trees fitted to `labels.quality`; a document is
rejected if its score is under `KEEP_FROM`. The score can't rise with symbols,
capitals, repeated words, repeated lines or exclamation marks (monotonic constraints).

The trees are fitted on at most `sample` labelled documents, those whose ids hash
lowest; without labels of both kinds the trees reject nothing. A null text has no
words. Rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm import text as words_of
from sparkward.llm import trees
from sparkward.llm.frames import filter_texts, ids_and_texts, ids_schema, map_batches

LEAST_WORDS, MOST_REPEATED, KEEP_FROM = 50, 50, 0.5
SAMPLE = 6000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_digits", "n_marks")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "distinct", "capitals", "digits", "marks")
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, -1, 0, -1])


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOLS, _CAPITALS, _DIGITS, _MARKS = (_table(c) for c in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!"))


def _per_doc(piece: words_of.Piece, table: np.ndarray) -> np.ndarray:
    """How many bytes of each document the table marks."""
    out = np.zeros(len(piece), np.int64)
    for at in range(0, len(piece.data), words_of.SEGMENT):
        marked = np.concatenate([[0], np.cumsum(table[piece.data[at : at + words_of.SEGMENT]])])
        edge = np.clip(piece.offsets - at, 0, len(marked) - 1)
        out += marked[edge[1:]] - marked[edge[:-1]]
    return out


def _distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique of (document, hash): first places, inverse and counts."""
    key = words_of.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, count


def statistics(column: pa.Array) -> np.ndarray:
    """COUNTS for each text of an Arrow column."""
    head = np.arange(256) & 0xC0 != 0x80
    out = [np.zeros((0, len(COUNTS)), np.int64)]
    for piece in words_of.pieces(column):
        n = len(piece)
        found = words_of.words(piece, words_of.SPACED)
        n_words = np.diff(found.bounds)
        chars = _per_doc(piece, head & words_of.SPACED.letters)
        first, _, _ = _distinct(found.doc, found.hash)
        distinct = np.bincount(found.doc[first], minlength=n)
        hashes, doc, at = words_of.windows(found, 3)
        _, inverse, count = _distinct(doc, hashes)
        twice = at[count[inverse] >= 2]
        cover = np.zeros(len(found.hash) + 4, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 3, -1)
        covered = np.flatnonzero(np.cumsum(cover)[: len(found.hash)])
        repeated = np.bincount(found.doc[covered], minlength=n)
        lines = words_of.words(piece, words_of.LINES)
        full = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
        line_doc = lines.doc[full]
        n_lines = np.bincount(line_doc, minlength=n)
        first, _, _ = _distinct(line_doc, lines.hash[full])
        dup = n_lines - np.bincount(line_doc[first], minlength=n)
        parts = [n_words, chars, _per_doc(piece, _SYMBOLS), dup, repeated, n_lines, distinct]
        out.append(np.stack([*parts, *(_per_doc(piece, t) for t in (_CAPITALS, _DIGITS, _MARKS))], axis=1))
    return np.concatenate(out)


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeated = counts[:, 0], counts[:, 4]
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def features(counts: np.ndarray) -> np.ndarray:
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    n, chars, lines = (np.maximum(1, c[k]) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / n,
            np.log1p(n / lines), c["n_distinct"] / n, c["n_capitals"] / chars, c["n_digits"] / chars, c["n_marks"] / chars,
        ],
        axis=1,
    )


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""

    def make():
        return lambda batch: [batch.column(0), *statistics(batch.column(1)).T]

    return map_batches(ids_and_texts(docs), make, ids_schema(", ".join(f"{c} long" for c in COUNTS)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> trees.Boosted | None:
    """Trees fitted on at most `sample` labelled documents that pass the base rules."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_label"))
    known = known.filter("doc_id IS NOT NULL AND _label IN (0, 1)")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)
    picked = ids_and_texts(docs).join(known, "doc_id", "left_semi")
    rows = counted(picked).join(known, "doc_id").orderBy("doc_id", *COUNTS, "_label").limit(2 * sample).collect()
    counts = np.array([[r[c] for c in COUNTS] for r in rows], np.int64).reshape(-1, len(COUNTS))
    y = np.array([r["_label"] for r in rows], float)
    judged = ~base_failed(counts)
    if len(set(y[judged])) < 2:
        return None
    return trees.fit(features(counts[judged]), y[judged], MONOTONE)


def verdicts(counts: np.ndarray, model: trees.Boosted | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept)."""
    failed = base_failed(counts)
    score = np.ones(len(counts)) if model is None else model.score(features(counts))
    return failed, score, ~failed & (score >= KEEP_FROM)


def judged(docs: DataFrame, model: trees.Boosted | None) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept for every row of `docs`."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            counts = statistics(batch.column(1))
            return [batch.column(0), *counts.T, *verdicts(counts, model)]

        return run

    rest = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return map_batches(ids_and_texts(docs), make, ids_schema(rest))


def drop_bad(docs: DataFrame, model: trees.Boosted | None) -> DataFrame:
    """`docs` without the rows that the rules reject; all columns as they were."""
    return filter_texts(docs, lambda: lambda texts: verdicts(statistics(texts), model)[2])
