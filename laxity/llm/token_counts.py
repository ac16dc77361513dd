"""Token counts from an exact length histogram.

Documents are aggregated by encoded length into a histogram; suffix sums over it answer, for each length that occurs as a context
limit, the documents and tokens in all, those beyond the limit, and the totals after truncation, and give exact quantiles.
The histogram has one row for each length that occurs; its suffix sums are added up from blocks of BLOCK lengths, so
that no task holds all of it.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives an empty histogram, and at_limit() and
quantile() a row of nulls; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import counts, default_path
from .common import stored, table

BLOCK = 4096


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of hist: docs_longer, tokens_longer (documents over L), truncated_tokens (sum of least(length, L)), total_docs, total_tokens, quantile (share of documents up to L)."""
    hist = stored(hist, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = hist.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("b_tokens"))
    after = W.orderBy("block").rowsBetween(1, W.unboundedFollowing)  # a row for each BLOCK lengths
    everything = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = sums.select(
        F.col("block").alias("_b"), F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("a_docs"), F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("a_tokens"),
        F.sum("b_docs").over(everything).alias("total_docs"), F.sum("b_tokens").over(everything).alias("total_tokens"),
    )
    own = W.partitionBy("block").orderBy("n_tokens").rowsBetween(1, W.unboundedFollowing)
    rows = hist.withColumn("o_docs", F.coalesce(F.sum("docs").over(own), F.lit(0))).withColumn("o_tokens", F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(own), F.lit(0)))
    rows = rows.join(blocks, F.col("block") == F.col("_b"))
    longer, tokens = F.col("a_docs") + F.col("o_docs"), F.col("a_tokens") + F.col("o_tokens")
    return rows.select(
        "n_tokens", "docs", longer.alias("docs_longer"), tokens.alias("tokens_longer"), (F.col("total_tokens") - tokens + longer * F.col("n_tokens")).alias("truncated_tokens"),
        "total_docs", "total_tokens", ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length with at least a share q of the documents up to it."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Totals for any context limit, from the largest length that it covers: docs_longer, truncated_tokens, total_tokens."""
    best = sums.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("docs_longer", "tokens_longer", "total_docs", "total_tokens"), "n_tokens").alias("s"))
    whole = sums.agg(F.first("total_docs").alias("td"), F.first("total_tokens").alias("tt"))
    longer, tokens, total = F.coalesce("s.docs_longer", F.col("td")), F.coalesce("s.tokens_longer", F.col("tt")), F.col("tt")
    return best.join(whole).select(F.lit(limit).alias("limit"), longer.alias("docs_longer"), (total - tokens + longer * limit).alias("truncated_tokens"), total.alias("total_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(counts(table(spark, sf_dir, "documents"), default_path())))
