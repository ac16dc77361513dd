"""Utility of rules, the k best of each right-hand attribute or of all, and rules as text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..spec import Attribute, usable


def _weight(attributes: Sequence[Attribute]) -> Column:
    """Sum of level + 1 over the attributes but the right-hand one."""
    return reduce(lambda s, a: s + F.when(F.col("rhs") == a.name, F.lit(0)).otherwise(F.col(f"x_{a.name}") + 1), attributes, F.lit(0)).cast("double")


def log_utility(attributes: Sequence[Attribute]) -> Column:
    return F.when(F.col("support") > 0, F.col("r") * F.log(F.col("support").cast("double")) / _weight(attributes)).otherwise(F.lit(0.0))


def normalised_utility(attributes: Sequence[Attribute]) -> Column:
    top = reduce(lambda acc, a: F.when(F.col("rhs") == a.name, F.lit(a.levels + 2)).otherwise(acc), attributes, F.lit(None)).cast("double")
    return F.when(F.col("total") > 0, F.col("r") / top * (F.col("support") / F.col("total")) / _weight(attributes)).otherwise(F.lit(0.0))


UTILITIES = {"log": log_utility, "normalised": normalised_utility}


def ranked(rules: DataFrame, attributes: Sequence[Attribute], utility: str = "log") -> DataFrame:
    return rules.withColumn("utility", UTILITIES[utility](usable(attributes)))


def _order(attributes: Sequence[Attribute]) -> list[Column]:
    """Utility first; ties by the attribute, then the smallest left-hand levels, then the right-hand level."""
    return [F.round("utility", 12).desc(), F.col("rhs"), *[F.col(f"x_{a.name}") for a in usable(attributes)], F.col("r")]


def top_k(rules: DataFrame, attributes: Sequence[Attribute], k: int, utility: str = "log", scope: str = "per_rhs") -> DataFrame:
    """The k best rules of each right-hand attribute (per_rhs) or of all (global)."""
    scored = ranked(rules, attributes, utility)
    if scope == "global":
        return scored.orderBy(*_order(attributes)).limit(k)
    place = F.row_number().over(W.partitionBy("rhs").orderBy(*_order(attributes)))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("place")


def rendered(rules: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """A column rule: [A(<=1)], [B(<=2)] --> [C(<=0)], with utility where it is known."""
    attributes = usable(attributes)

    def term(a: Attribute, level: Column) -> Column:
        col = F.lit(None).cast("string")
        for lv in range(1, a.levels + 1):
            col = F.when(level == lv, F.lit(f"[{a.name}(<={a.threshold(lv):g})]")).otherwise(col)
        return col

    left = F.concat_ws(", ", *[F.when(F.col("rhs") != a.name, term(a, F.col(f"x_{a.name}"))) for a in attributes])
    right = F.concat_ws("", *[F.when(F.col("rhs") == a.name, term(a, F.col("r"))) for a in attributes])
    text = F.concat_ws(" ", F.when(left != "", left), F.lit("-->"), right)
    if "utility" in rules.columns:
        text = F.concat(text, F.lit("  utility: "), F.round("utility", 9).cast("string"))
    return rules.withColumn("rule", text)
