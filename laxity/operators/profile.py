"""Column profiles: value dictionaries, statistics, decimal digits, overlap of two columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import kind_of
from ..spec import NUMBER, Attribute, thresholds_for
from ..work import materialised


def value_index(df: DataFrame, column: str) -> DataFrame:
    """value, rows: the distinct values with their row counts."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def value_rows(df: DataFrame, column: str, key: str, shard: int | None = None) -> DataFrame:
    """value, part, rows: the keys of the rows that hold each value, by shards of `shard` keys so that no list grows without bound."""
    part = F.lit(0).cast("long") if shard is None else F.floor(F.col(key) / shard).cast("long")
    return df.groupBy(F.col(column).alias("value"), part.alias("part")).agg(F.sort_array(F.collect_list(key)).alias("rows"))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows that hold a value (null-safe)."""
    return df.where(F.col(column).eqNullSafe(F.lit(value)))


def codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: dense codes from 0 in the order of values, numbered within ranges of values."""
    values = materialised(df.select(F.col(column).alias("value")).distinct().repartitionByRange("value").withColumn("_p", F.spark_partition_id()))
    sizes = values.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    rank = F.row_number().over(W.partitionBy("_p").orderBy(F.col("value").asc_nulls_first())) - 1
    return values.withColumn("_r", rank).join(F.broadcast(before), F.col("_p") == F.col("_q")).select("value", (F.col("_before") + F.col("_r")).alias("code"))


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column: rows, distinct values, low, high and average of numbers, shortest and longest of strings. One pass."""
    columns = columns or df.columns
    aggs = []
    for i, c in enumerate(columns):
        num = kind_of(df, c) == NUMBER
        v, s = F.col(c).cast("double"), F.col(c).cast("string")
        none = F.lit(None).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("attribute"), F.lit(num).alias("is_number"), F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(c)).alias("distinct_values"),
                (F.min(v) if num else none).alias("low"), (F.max(v) if num else none).alias("high"), (F.avg(v) if num else none).alias("average"),
                (F.lit(None).cast("int") if num else F.min(F.length(s))).alias("shortest"), (F.lit(None).cast("int") if num else F.max(F.length(s))).alias("longest"),
            ).alias(f"c{i}")
        )
    return df.agg(*aggs).select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("s")).select("s.*")


def decimal_digits(df: DataFrame, columns: list[str]) -> DataFrame:
    """attribute, digits: the most decimals that a value of the column has, by its own shortest text with the exponent counted in."""

    def decimals(c: str) -> Column:
        text = F.col(c).cast("string")
        behind = F.length(F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)", 1), "0+$", ""))
        exponent = F.coalesce(F.regexp_extract(text, r"E([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        return F.when(F.col(c) == 0, 0).otherwise(F.greatest(behind - exponent, F.lit(0)))

    digits = [F.coalesce(F.max(decimals(c)), F.lit(0)).alias(c) for c in columns]
    return df.agg(*digits).select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("int").alias("digits")) for c in columns])).alias("d")).select("d.*")


def shared_share(a: DataFrame, column: str, b: DataFrame, other: str) -> DataFrame:
    """shared: over the values of the first column, the smaller of both row counts by the larger."""
    left, right = value_index(a, column), value_index(b, other).select(F.col("value").alias("_v"), F.col("rows").alias("_n"))
    both = left.join(right, F.col("value").eqNullSafe(F.col("_v")), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return both.agg((F.sum(F.least("rows", "_n")) / F.sum(F.greatest("rows", "_n"))).alias("shared"))


def attributes(df: DataFrame, columns: list[str], share: float = 0.5, stages: int = 3) -> list[Attribute]:
    """Attributes with grids worked out from the data: one row of statistics for each column comes to the driver."""
    numbers = [c for c in columns if kind_of(df, c) == NUMBER]
    digits = {r["attribute"]: r["digits"] for r in decimal_digits(df, numbers).collect()} if numbers else {}
    out = []
    for r in statistics(df, columns).collect():
        kind = kind_of(df, r["attribute"])
        out.append(Attribute(r["attribute"], kind, thresholds_for(kind, r.asDict(), share, stages), digits.get(r["attribute"], 0)))
    return out


def all_of(conditions):
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
