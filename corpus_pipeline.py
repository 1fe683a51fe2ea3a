"""The training-data pipeline: five stages over `documents`, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of `documents`; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm.bpe import encoded
from sparkward.llm.decontaminate import drop_contaminated
from sparkward.llm.frames import free_name, kept
from sparkward.llm.lines import dedup_lines
from sparkward.llm.neardup import drop_near_duplicates
from sparkward.llm.quality import drop_bad, train
from sparkward.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return drop_bad(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; a document that loses all its words goes too."""
    gone = F.size(free_name(docs.columns, "_removed"))
    out = dedup_lines(docs).filter(F.col("text").isNull() | (gone == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    size = F.when(gone > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of what is left."""
    return encoded(docs, tokenizer_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]
#: SQL expresses neither the trained verdicts nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
