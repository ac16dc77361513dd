"""Support, violations and error of candidates, from an evidence set or straight from row pairs.

A candidate has a level for each left-hand attribute (0: absent) and a level r from 1 for the right-hand one. A pair violates it if it reaches all
left-hand levels and stays under r on the right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evidence import evidence_by_row
from ..operators.profile import all_of
from ..spec import Attribute, usable


def pair_count(rows: int) -> int:
    return rows * (rows - 1) // 2


def budget(total: Column, error: float) -> Column:
    """Pairs that may violate a rule."""
    return F.floor(total * F.lit(float(error))).cast("long")


def reaches(lhs: dict[str, int]) -> Column:
    """All left-hand levels are reached, in columns lv_<attribute>."""
    return all_of(F.col(f"lv_{name}") >= x for name, x in lhs.items() if x > 0)


def measure(evidence: DataFrame, lhs: dict[str, int], rhs: str, level: int) -> DataFrame:
    """One row for one candidate: support, violations, total, g1."""
    hit = reaches(lhs)
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0)).cast("long")
    out = evidence.agg(add(hit).alias("support"), add(hit & (F.col(f"lv_{rhs}") < level)).alias("violations"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"))
    return out.withColumn("g1", F.when(F.col("total") > 0, F.col("violations") / F.col("total")).otherwise(F.lit(0.0)))


def measure_pairs(df: DataFrame, attributes: Sequence[Attribute], key: str, lhs: dict[str, int], rhs: str, level: int) -> DataFrame:
    """The same, without an evidence set of all attributes: only the candidate's own attributes are compared, pair by pair."""
    own = [a for a in usable(attributes) if a.name == rhs or lhs.get(a.name, 0) > 0]
    return measure(evidence_by_row(df, own, key), lhs, rhs, level)


def by_level(evidence: DataFrame, rhs: Attribute) -> DataFrame:
    """Evidence that leaves some right-hand level open, by that level and falling count."""
    return evidence.where(F.col(f"lv_{rhs.name}") < rhs.levels).orderBy(f"lv_{rhs.name}", F.desc("cnt"))


def cover_targets(evidence: DataFrame, attributes: Sequence[Attribute], rhs: Attribute, error: float) -> DataFrame:
    """level, open_pairs, target: for each right-hand level the pairs under it, and how many of them a left-hand side has to exclude."""
    total = evidence.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"))
    per = evidence.groupBy(F.col(f"lv_{rhs.name}").cast("int").alias("_l")).agg(F.sum("cnt").alias("_n"))
    levels = total.select("total", F.explode(F.sequence(F.lit(1), F.lit(rhs.levels))).alias("level"))
    open_pairs = levels.join(F.broadcast(per), F.col("_l") < F.col("level"), "left").groupBy("level", "total").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("open_pairs"))
    return open_pairs.select("level", "open_pairs", F.greatest(F.lit(0), F.col("open_pairs") - budget(F.col("total"), error)).cast("long").alias("target"))


