"""The registered queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@_query("op2_minhash")
def op2(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, root, "documents"), k=3, percent=85)


def _folded(text: str) -> str:
    """DuckDB: the words of a text, A-Z lower-cased, for the operators that split at every other ASCII sign."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_folded("text")} AS ws FROM documents),
b AS (SELECT DISTINCT item_id, {_folded("text")} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
      FROM b, unnest(range(1, greatest(2, len(ws) - 8))) AS r(i) WHERE len(ws) > 0),
g AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
      FROM d, (SELECT DISTINCT k FROM w), unnest(range(1, len(ws) - k + 2)) AS r(i)),
m AS (SELECT doc_id, i, k, item_id FROM g JOIN w USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(0, k)) AS r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@_query("op1_decontaminate", _OP1_SQL)
def op1(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.decontaminate import contaminated

    ids = F.array_sort(F.col("items").cast("array<string>"))
    return contaminated(_table(spark, root, "documents"), _table(spark, root, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op4_quality")
def op4(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.quality import judged, train

    docs = _table(spark, root, "documents")
    out = judged(docs, train(docs, _table(spark, root, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@_query("op5_lines")
def op5(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.lines import dedup_lines

    out = dedup_lines(_table(spark, root, "documents").select("doc_id", "text"), by_word=True, folded=True)
    return out.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_left"),
        F.size("_removed").cast("long").alias("n_removed"),
        F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed"),
        "text",
    )


@_query("op6_bpe")
def op6(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.bpe import encoded

    return encoded(_table(spark, root, "documents"), tokenizer_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def tokenizer_path() -> str:
    """The public tokenizer the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op3_urls")
def op3(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.urls import Rule, filtered

    rules = [
        Rule("allow", "org/"),
        Rule("block", "example.org/es/"),
        Rule("block", "example.org/en/1"),
        Rule("allow", "com/fr/"),
        Rule("block", "com/de/"),
    ]
    return filtered(_table(spark, root, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "score")


_OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
        length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) AS n_text,
        length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) AS n_role
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(n_text + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 ELSE 7 + n_role END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@_query("op9_chat", _OP9_SQL)
def op9(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.chat import formatted, learnt_text, turns_of

    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = formatted(rows).select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        turns_of(F.col("formatted")).alias("turns"),
        learnt_text(F.col("formatted"), F.col("loss_mask")).alias("learnt"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _op7_sql() -> str:
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    listed = ", ".join(f"('{label}', '{text}', {len(text.split())})" for label, text in phrases.items())
    return f"""
WITH d AS (SELECT doc_id, {_folded("text")} AS ws FROM documents),
p(label, phrase, k) AS (VALUES {listed}),
m AS (SELECT doc_id, label, i - 1 AS place FROM d, p, unnest(range(1, len(ws) - k + 2)) AS r(i)
      WHERE array_to_string(ws[i:i + k - 1], ' ') = phrase)
SELECT doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(place) AS n_base,
  CAST(min(place) AS BIGINT) AS first_word, CAST(max(place) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN m USING (doc_id) GROUP BY doc_id
"""


@_query("op7_licenses")
def op7(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.licenses import scanned

    return scanned(_table(spark, root, "documents")).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@_query("op8_toxicity")
def op8(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.toxicity import scored, train

    docs = _table(spark, root, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    net = train(docs, _table(spark, root, "labels"), usable=~held_out)
    return scored(docs, net).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "flagged",
    )


@_query("op10_tokenfile")
def op10(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm import tokenfile
    from sparkward.session import scratch_path

    folder = scratch_path(spark, "token-files")
    tokenfile.write(_table(spark, root, "documents"), folder, tokenizer_path())
    return tokenfile.read(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


_OP13_SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda v, b: list_reduce(list_concat([xor(v, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda w, z: xor(w >> 1, 3988292384 * (w & 1))))) % 6 AS h FROM ids),
l AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS xs
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT g.c, list_concat(coalesce(b.xs, l.xs[1:0])[1:g.h], l.xs[g.h + 1:]) AS xs
      FROM g JOIN l USING (c) LEFT JOIN l AS b ON b.c = g.c - g.c % 100),
m AS (SELECT c, len(xs) AS n, d, xs[1:d] AS path FROM r, unnest(range(0, len(xs) + 1)) AS u(d)),
v AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf,
        (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END) AS saved,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
      FROM m GROUP BY d, path)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, any_value(p.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs,
  count(*) FILTER (b.d = a.d + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves,
  CAST(sum(b.saved) AS BIGINT) AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM v AS a JOIN v AS b ON b.d >= a.d AND b.path[1:a.d] = a.path LEFT JOIN v AS p ON p.d = a.d - 1 AND p.path = a.path[1:a.d - 1]
GROUP BY a.conv_id, a.d
"""


@_query("op13_trie", _OP13_SQL)
def op13(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.frames import kept
    from sparkward.llm.trie import trie, turn_ids, with_shared_heads

    turns = kept(turn_ids(_table(spark, root, "conversations")), "turn-ids")
    heads = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    return trie(*with_shared_heads(turns, 100, heads, 5))


_OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size,
        -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
          / greatest(0.05::DOUBLE, 1::DOUBLE - (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(size, 1)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM d GROUP BY source),
o AS (SELECT *, sum(2 * source_size) OVER a - 2 * source_size AS full_words, sum(w) OVER b AS open_weight, row_number() OVER a AS r,
        (SELECT sum(source_size) FROM s) * 150 / 100.0::DOUBLE AS all_words
      FROM s WINDOW a AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING),
        b AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT (all_words - full_words::DOUBLE) / open_weight::DOUBLE AS share FROM o
      WHERE 2 * source_size >= w * (all_words - full_words::DOUBLE) / open_weight::DOUBLE ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, w::DOUBLE * coalesce((SELECT share FROM f), 0)) AS target FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (SELECT k.*, p.source_size, p.target, p.epochs, CAST(round(p.target) AS BIGINT) - p.epochs * p.source_size AS budget,
        sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, budget - before)) AS BIGINT) AS taken FROM x
"""


@_query("op11_mix", _OP11_SQL)
def op11(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.mix import planned

    return planned(_table(spark, root, "documents"), weights=(5, 2, 1), percent=150, most=2).drop("source")


_OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r AS a JOIN r AS b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


@_query("op12_negatives", _OP12_SQL)
def op12(spark: SparkSession, root: str) -> DataFrame:
    from sparkward.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, root, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(spark, rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)
