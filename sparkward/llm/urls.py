"""URL filter: allow and block rules, and boosted trees on lexical features for the rest.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then
up to `?`, `#` or the end. A null url, or one without `://`, has an empty host and path.
A rule fits its host and all subdomains if the path starts with the rule's path; the
longest rule that fits decides. The trees decide the urls that no rule fits.

The trees are fitted to labelled urls: by default those that a rule decides, on at most
`sample` of each verdict, the urls that hash lowest. Rule hosts and paths are no
features; the suffix statistics (how often a suffix is allowed or blocked, smoothed) are
counted over all labelled urls. With labels of one kind only, the rest get that verdict;
with none, they are allowed.

Rules are a short list that goes to every task; `rule_table` refuses more than MOST_RULES.
Rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.llm import text as words_of
from sparkward.llm import trees
from sparkward.llm.frames import map_batches

MOST_RULES, SAMPLE, BLOCK_FROM = 100_000, 5000, 0.5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "longest_run", "secure", "suffix_blocked")


class Rule(NamedTuple):
    verdict: str
    rule: str


def rule_table(rules: Sequence[Rule]) -> dict[str, list[tuple[str, str, str]]]:
    """Host to (path, rule, verdict), longest path first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; this filter sends at most {MOST_RULES} to every task")
    table: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        table.setdefault(host, []).append((slash + path, rule, verdict))
    return {h: sorted(v, key=lambda x: (-len(x[0]), x)) for h, v in table.items()}


def decide(table: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits."""
    best: tuple[str | None, str | None] = (None, None)
    while host:
        for start, rule, verdict in table.get(host, ()):
            if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                best = rule, verdict
        host = host.partition(".")[2]
    return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def _suffix(host: str) -> str:
    return host.rpartition(".")[2]


def lexical(column: pa.Array, suffix_blocked: np.ndarray) -> np.ndarray:
    """FEATURES of each url of an Arrow column."""
    out = [np.zeros((0, len(FEATURES)))]
    for piece in words_of.pieces(column):
        n, row = len(piece), np.repeat(np.arange(len(piece)), np.diff(piece.offsets))
        seen = np.zeros((n, 256))
        np.add.at(seen, (row, piece.data), 1)
        length = seen.sum(axis=1)
        share = seen / np.maximum(1, length)[:, None]
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        digit = (piece.data >= 48) & (piece.data <= 57)
        runs = words_of.words(piece, _ALNUM)
        longest = np.zeros(n)
        np.maximum.at(longest, runs.doc, runs.end - runs.start)
        host = words_of.words(piece, _AUTHORITY)
        second = host.bounds[:-1] + 1  # the run after the scheme
        has = second < host.bounds[1:]
        host_length, labels = np.zeros(n), np.zeros(n)
        dots = np.concatenate([[0], np.cumsum(piece.data == ord("."))])
        start, end = host.start[second[has]], host.end[second[has]]
        host_length[has], labels[has] = end - start, dots[end] - dots[start] + 1
        secure = np.array([bytes(piece.data[a : a + 6]) == b"https:" for a in piece.offsets[:-1]], float)
        digits = np.bincount(row[digit], minlength=n)
        parameters = seen[:, ord("=")] + seen[:, ord("&")]
        out.append(
            np.stack(
                [length, host_length, length - host_length, seen[:, ord("/")], labels, digits / np.maximum(1, length), entropy, parameters, seen[:, ord("-")], longest, secure],
                axis=1,
            )
        )
    basic = np.concatenate([o[:, : len(FEATURES) - 1] for o in out])
    return np.column_stack([basic, suffix_blocked])


_ALNUM = words_of.Charset(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]), np.arange(256, dtype=np.uint8))
_AUTHORITY = words_of.Charset(~np.isin(np.arange(256), [ord(c) for c in "/?#"]), np.arange(256, dtype=np.uint8))


class Model(NamedTuple):
    """What the trees need: suffix statistics, and the trees or the one verdict known."""

    suffixes: dict[str, float]
    rest: float
    boosted: trees.Boosted | None
    only: float

    def blocked(self, urls: pa.Array, hosts: list[str]) -> np.ndarray:
        """The probability that each url is to be blocked."""
        if self.boosted is None:
            return np.full(len(urls), self.only)
        known = np.array([self.suffixes.get(_suffix(h), self.rest) for h in hosts])
        return self.boosted.score(lexical(urls, known))


def parsed(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, ruled) for every row."""
    host, path = host_and_path(F.col(url).cast("string"))
    read = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    table = rule_table(rules)

    def make():
        def run(batch: pa.RecordBatch) -> list:
            found = [decide(table, h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return [*batch.columns, [r for r, _ in found], [v for _, v in found]]

        return run

    return map_batches(read, make, T.StructType.fromDDL("page_id long, url string, host string, path string, rule string, ruled string"))


#: Suffixes whose statistics are kept, the most frequent; all others share one statistic.
MOST_SUFFIXES = 5000


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to rows (url, host, ruled), ruled 'allow' or 'block'."""
    known = labelled.filter("ruled IN ('allow', 'block')").select("url", "host", (F.col("ruled") == "block").cast("int").alias("y"))
    counts = known.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.sum("y").alias("blocked"), F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "suffix").limit(MOST_SUFFIXES).collect()
    whole = known.agg(F.sum("y"), F.count("*")).first()
    rate = (whole[0] or 0) / whole[1] if whole[1] else 0.0
    suffixes = {r["suffix"]: (r["blocked"] + 10 * rate) / (r["n"] + 10) for r in top}
    if rate in (0.0, 1.0):
        return Model(suffixes, rate, None, rate)
    rows = []
    for y in (0, 1):
        rows += known.filter(F.col("y") == y).orderBy(F.xxhash64("url"), "url").limit(sample).collect()
    urls = pa.array([r["url"] for r in rows])
    model = Model(suffixes, rate, None, rate)
    statistic = np.array([model.suffixes.get(_suffix(r["host"]), rate) for r in rows])
    # a third of the rows see no statistic of their suffix, so the other features are learned too
    statistic[::3] = rate
    boosted = trees.fit(lexical(urls, statistic), np.array([r["y"] for r in rows], float), trees=40)
    return model._replace(boosted=boosted)


def filtered(pages: DataFrame, rules: Sequence[Rule], model: Model | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of `pages`; score: the trees' probability of block."""
    ruled = parsed(pages, rules, key, url)
    model = train(ruled) if model is None else model

    def make():
        def run(batch: pa.RecordBatch) -> list:
            hosts, known = batch.column(2).to_pylist(), batch.column(5).to_pylist()
            score = model.blocked(batch.column(1), hosts)
            verdict = [v or ("block" if s >= BLOCK_FROM else "allow") for v, s in zip(known, score, strict=True)]
            return [batch.column(0), hosts, batch.column(3), batch.column(4), verdict, score]

        return run

    return map_batches(ruled, make, T.StructType.fromDDL("page_id long, host string, path string, rule string, verdict string, score double"))
