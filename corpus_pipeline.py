"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

Quality, exact copies, near copies (five-word shingles, similarity 0.8 or more; of each group the smallest doc_id stays),
passages of the benchmark, then tokens. All stages but the last return the columns of documents; the last returns
doc_id, n_tokens, ids and decoded for every document that is left. Stages are written as Parquet in the shared folder and read again.

Nulls, empty and long texts, ties and empty tables are treated as the operators define it. A stage that gets an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laxity.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from laxity.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, bpe.default_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontaminate", benchmark_passages),
    ("bpe", tokens),
]
#: A trained model's decisions cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
