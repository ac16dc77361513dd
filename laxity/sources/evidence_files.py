"""Evidence sets as files: levels and a count on each line, without a header, or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Attribute


def schema(attributes: Sequence[Attribute]) -> T.StructType:
    return T.StructType([*[T.StructField(f"lv_{a.name}", T.ByteType()) for a in attributes], T.StructField("cnt", T.LongType())])


def save(evidence: DataFrame, path: str, form: str = "csv") -> None:
    getattr(evidence.write, form)(path)


def load(spark: SparkSession, path: str, attributes: Sequence[Attribute], form: str = "csv") -> DataFrame:
    return getattr(spark.read.schema(schema(attributes)), form)(path)


def readable(evidence: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """evidence as text: the distance band of each attribute, and the count."""

    def band(a: Attribute):
        col = F.lit("")
        for lv in range(a.levels, -1, -1):
            low = f"({a.threshold(lv + 1):g}," if lv < a.levels else "[0,"
            high = f"{a.threshold(lv):g}]" if lv else "inf)"
            col = F.when(F.col(f"lv_{a.name}") == lv, f"{a.name} {low}{high}").otherwise(col)
        return col

    return evidence.select(F.concat_ws(" ", *[band(a) for a in attributes]).alias("evidence"), "cnt")
