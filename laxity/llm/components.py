"""Connected components by alternating large-star and small-star steps; each round of both is written to the shared folder once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, compact, drop_stored, gathered, stored

SALTS = 64


def _least(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v) with m, the smallest neighbour of u. A hub's edges are dealt out by a salt."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    if small:
        return edges.join(F.broadcast(least), F.col("u") == F.col("_u"))
    salt: Column = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    least = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("s", salt).join(least, (F.col("u") == F.col("_u")) & (F.col("s") == F.col("_s")))


def components(edges: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """edges (a, b), any order -> node, root: the smallest node of its component. Nodes without edges do not occur."""
    now = stored(gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), "edges")
    measure = F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")
    sign = tuple(now.agg(*measure).first())
    while True:
        small = 2 * sign[0] <= bound  # both ways; neither step makes more edges than that
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, small).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        found = _least(large, small)
        after = found.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = stored(compact(after, 2 * sign[0]), "small")
        seen = tuple(after.agg(*measure).first())
        drop_stored(now)
        now = after
        if seen == sign:
            break
        sign = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
