"""Benchmark passages in documents: one Aho-Corasick automaton, whole texts scanned once.

Words are runs of digits, letters and everything beyond ASCII, A-Z lower-cased. A
window is `size` consecutive words of an item; an item of fewer words, but not none,
is one window. A document word inside any occurrence of a window is hit. Spans are
ranges of code points of the original text, adjacent hits merged.

The benchmark is measured before it is sent out. What fits `automaton_bytes` is one
automaton; a larger benchmark is cut into blocks by item, each with an automaton of
its own, and the documents pass them one after another: no text is shuffled.

Null texts have no words. Items without id or without words are left out. Equal
texts of several items report every item. Rows of `docs` are answered one by one,
whatever their doc_id; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkward.llm.frames import filter_texts, ids_and_texts, ids_schema, map_batches

WINDOW = 10
AUTOMATON_BYTES = 16 << 20

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> bytes:
    """The words of a text, lower-cased, with one space before, between and after."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()
    return b" " + b" ".join(found) + b" " if found else b""


def item_windows(text: str | None, size: int) -> Iterator[str]:
    found = normalised(text).decode("utf-8", "surrogatepass").split(" ")[1:-1]
    for at in range(max(1, len(found) - size + 1) if found else 0):
        yield f" {' '.join(found[at : at + size])} "


def automaton(items: list[tuple[int, str]], size: int) -> ahocorasick.Automaton:
    """Each window with its number of words and the items that hold it."""
    holders: dict[str, set[int]] = {}
    for item, text in items:
        for window in item_windows(text, size):
            holders.setdefault(window, set()).add(item)
    machine = ahocorasick.Automaton()
    for window, ids in holders.items():
        machine.add_word(window, (len(window), window.count(" ") - 1, sorted(ids)))
    if holders:
        machine.make_automaton()
    return machine


def scan(machine: ahocorasick.Automaton, text: str | None) -> tuple[int, list[list[int]], set[int]]:
    """(number of words, merged runs [first, last] of hit words, items) of one text."""
    plain = normalised(text)
    n = max(0, plain.count(b" ") - 1)
    runs: list[list[int]] = []
    items: set[int] = set()
    if not n or not len(machine):
        return n, runs, items
    joined = plain.decode("utf-8", "surrogatepass")
    hits = list(machine.iter(joined))
    if hits:
        ends = np.array([end for end, _ in hits])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.searchsorted(np.flatnonzero(code == 32), ends) - 1
        for k, (_, (_, count, ids)) in zip(last.tolist(), hits, strict=True):
            runs.append([k - count + 1, k])
            items.update(ids)
    return n, merged(runs), items


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def original_spans(text: str, runs: list[list[int]]) -> list[dict]:
    """Runs of words as ranges of code points of the text itself."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b][1]} for a, b in runs]


def blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about `limit` bytes of text, one after another; one at least."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    parts = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        yield [(r["item_id"], r["text"]) for r in parts.filter(F.col("_block") == b).collect()]


def _named(benchmark: DataFrame) -> DataFrame:
    named = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return named.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of `docs`."""
    spark = docs.sparkSession
    state = "text string, n_words long, runs array<array<int>>, items array<long>"
    frame = ids_and_texts(docs).selectExpr(
        "doc_id", "text", "0L AS n_words", "cast(array() AS array<array<int>>) AS runs", "cast(array() AS array<long>) AS items"
    )
    for block in blocks(_named(benchmark), automaton_bytes):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            machine = automaton(sent.value, size)

            def run(batch: pa.RecordBatch) -> list:
                found = [scan(machine, t.as_py()) for t in batch.column(1)]
                before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
                runs, items = [], []
                for (old, ids), (_, new, more) in zip(before, found, strict=True):
                    runs.append(merged([*old, *new]))
                    items.append(sorted({*ids, *more}))
                return [batch.column(0), batch.column(1), [n for n, _, _ in found], runs, items]

            return run

        frame = map_batches(frame, make, ids_schema(state))

    def finish():
        def run(batch: pa.RecordBatch) -> list:
            texts, runs = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            spans = [original_spans(t, r) if r else [] for t, r in zip(texts, runs, strict=True)]
            hit = [sum(b - a + 1 for a, b in r) for r in runs]
            return [batch.column(0), batch.column(2), hit, batch.column(4), spans]

        return run

    out = ids_schema("n_words long, n_hit long, items array<long>, spans array<struct<start: int, end: int>>")
    return map_batches(frame, finish, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """`docs` without the rows in which a window occurs; all columns as they were."""
    frame = docs
    for block in blocks(_named(benchmark), automaton_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            machine = automaton(sent.value, size)
            return lambda texts: [not scan(machine, t.as_py())[1] for t in texts]

        frame = filter_texts(frame, make)
    return frame
