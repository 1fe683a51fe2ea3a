"""License scans by diagonal voting.

Words are runs of digits, letters and everything beyond ASCII, A-Z lower-cased. Rolling
hashes of all two-word grams of all documents are joined with the grams of the license
templates. A match at word i of a text and word j of a template votes for the diagonal
i - j; votes of neighbouring diagonals (words put in or left out) are merged. A span
with enough votes is verified on the words themselves: a phrase must stand there word for
word, a notice must agree with the text in order for at least `LEAST` of its words.

The templates are a short list, refused beyond MOST_GRAMS grams, so their side of the
join is sent to every task and the grams of the documents are not shuffled. Only votes are shuffled, and the texts that have a
candidate. A null text has no words. Rows are told apart by doc_id and text: equal rows
are answered alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkward.llm import text as words_of
from sparkward.llm.decontaminate import normalised
from sparkward.llm.frames import ids_and_texts, kept, map_batches
from sparkward.llm.sketch import may_hold, sketch

K, LEAST, SLACK, MOST_GRAMS = 2, 0.75, 4, 100_000


class Template(NamedTuple):
    """exact: a phrase that counts wherever its words stand; else a notice, found by likeness."""

    label: str
    text: str
    exact: bool = False


PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
NOTICES = (
    Template("agpl", "under the terms of the gnu affero general public license"),
    Template("apache", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl", "subject to the terms of the mozilla public license"),
    Template("reserved", "all rights reserved"),
)


def template_words(template: Template) -> list[str]:
    return normalised(template.text).decode().split()


def template_grams(templates: Sequence[Template]) -> list[tuple[int, int, int]]:
    """(hash, template, place) of every gram."""
    if sum(len(template_words(t)) for t in templates) > MOST_GRAMS:
        raise ValueError(f"templates of more than {MOST_GRAMS} words would not fit every task")
    out = []
    for number, template in enumerate(templates):
        if len(template_words(template)) < K:
            raise ValueError(f"a template needs {K} words: {template.text!r}")
        for piece in words_of.pieces(pa.array([template.text])):
            hashes, _, place = words_of.windows(words_of.words(piece, words_of.PLAIN), K)
            out += [(h, number, p) for h, p in zip(hashes.view(np.int64).tolist(), place.tolist(), strict=True)]
    return out


def grams(docs: DataFrame) -> DataFrame:
    """(doc_id, h: hash of the text, n_words, grams: rolling hashes, one for each word but the last) of every row."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            n_words, hashes, ends = [], [], [0]
            for piece in words_of.pieces(batch.column(2)):
                found = words_of.words(piece, words_of.PLAIN)
                count = np.diff(found.bounds)
                n_words += count.tolist()
                h, doc, _ = words_of.windows(found, K)
                full = (count >= K)[doc]
                hashes.append(h[full].view(np.int64))
                ends.append(np.cumsum(np.where(count >= K, count - K + 1, 0)) + (ends[-1][-1] if len(ends) > 1 else 0))
            offsets = np.concatenate([np.atleast_1d(e) for e in ends]).astype(np.int32)
            return [batch.column(0), batch.column(1), n_words, pa.ListArray.from_arrays(offsets, np.concatenate(hashes) if hashes else np.zeros(0, np.int64))]

        return run

    return map_batches(_keyed(docs), make, T.StructType.fromDDL("doc_id long, h long, n_words long, grams array<long>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return ids_and_texts(docs).select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")


def candidates(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, h, n_words, template, start, votes, rows): merged diagonals with enough votes.

    Each document is there once more with template -1, and `rows` telling how often it occurs.
    """
    spark = docs.sparkSession
    here = spark.createDataFrame([(0, -1, 0), *template_grams(templates)], "gram long, template int, place int")
    # every row also carries the gram 0, which no template has: so rows without a match stay
    dealt = grams(docs).select("doc_id", "h", "n_words", F.posexplode(F.array_append("grams", F.lit(0).cast("long"))).alias("at", "gram"))
    votes = dealt.join(F.broadcast(here), "gram").groupBy(
        "doc_id", "h", "n_words", "template", F.when(F.col("template") < 0, 0).otherwise(F.col("at") - F.col("place")).alias("diagonal")
    ).agg(F.countDistinct("place").alias("votes"), F.count("*").alias("rows"))
    size = {i: len(template_words(t)) - K + 1 for i, t in enumerate(templates)}
    notices = [i for i, t in enumerate(templates) if not t.exact]
    need = F.create_map(*(F.lit(x) for i, n in {-1: 1, **size}.items() for x in (i, n)))[F.col("template")]
    exact = votes.filter(~F.col("template").isin(notices) & (F.col("votes") == need))
    rest = votes.filter(F.col("template").isin(notices))
    # diagonals a few words apart vote together, for the middle of their band
    band = F.explode(F.array(F.floor(F.col("diagonal") / SLACK), F.floor(F.col("diagonal") / SLACK) + 1))
    near = rest.withColumn("band", band).groupBy("doc_id", "h", "n_words", "template", "band").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("diagonal"), F.max("rows").alias("rows")
    )
    near = near.filter(F.col("votes") >= F.greatest(F.lit(2), F.floor(need * LEAST / 2))).drop("band")
    return exact.unionByName(near.select(*exact.columns)).withColumnRenamed("diagonal", "start")


def in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def likeness(template: list[str], found: list[str], start: int, exact: bool) -> float:
    """The share of the template's words that stand at `start`, in order."""
    if exact:
        return float(found[max(0, start) : start + len(template)] == template and start >= 0)
    return in_order(template, found[max(0, start - SLACK) : start + len(template) + 2 * SLACK]) / len(template)


def scanned(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES)) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of `docs`; labels as sorted arrays."""
    found = kept(candidates(docs, templates), "license-votes")
    places = kept(
        found.filter("template >= 0").groupBy("doc_id", "h").agg(F.collect_set(F.struct("template", "start")).alias("places")), "license-places"
    )
    hit = may_hold(kept(sketch(places, "h"), "license-sketch"), "h")
    side = places.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "places")
    texts = _keyed(docs).filter(hit)
    joined = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "text", "places")
    wanted = [(t.label, template_words(t), t.exact) for t in templates]

    def make():
        def run(batch: pa.RecordBatch) -> list:
            out = []
            for text, here in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                own = normalised(text.as_py()).decode("utf-8", "surrogatepass").split(" ")[1:-1]
                hits = []
                for place in here:
                    label, template, exact = wanted[place["template"]]
                    like = likeness(template, own, place["start"], exact)
                    if like >= (1 if exact else LEAST):
                        hits.append((label, exact, place["start"], like))
                base = sorted(start for _, exact, start, _ in hits if exact)
                out.append(
                    (
                        len(base), base[0] if base else None, base[-1] if base else None, sorted({x for x, exact, _, _ in hits if exact}),
                        sorted({x for x, *_ in hits}), max((like for *_, like in hits), default=0.0),
                    )
                )
            return [batch.column(0), batch.column(1), *([row[i] for row in out] for i in range(6))]

        return run

    rest = "n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
    verified = map_batches(joined, make, T.StructType.fromDDL(f"doc_id long, h long, {rest}")).distinct()
    verified = verified.withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    copies = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_copy")
    every = found.filter("template < 0").select("doc_id", "h", "n_words", copies)
    out = every.join(verified, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
