"""The evidence set: how many row pairs have each vector of levels.

Rows with equal values on all attributes are one tuple with a multiplicity, so that duplicates cost nothing: a pair of tuples counts the product of theirs, and a
tuple with itself m (m - 1) / 2 at the tightest levels. Tuples are dealt to blocks, and each pair of blocks is one join key; the join
then has equal keys, works in pieces of bounded size on all executors and broadcasts nothing. Pairs are counted where they are made.

From SWEEP_TUPLES tuples on, tables whose values all have codes are swept along a number instead (sweep.py), with the same counts; tables with more groups
of the other attributes' values than the sweep takes, or with values that have no codes, are joined as above.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import clean, level
from ..spec import NUMBER, Attribute, usable
from ..work import materialised
from .sweep import Code, swept

#: Tuples in a block: a block pair makes the square of it at most.
BLOCK_TUPLES = 2000
#: Distinct strings up to which levels come from a table.
CODES = 128
#: Tuples from which a sweep is tried.
SWEEP_TUPLES = 1000


def names(attributes: Sequence[Attribute]) -> list[str]:
    return [f"lv_{a.name}" for a in attributes]


def tuples(df: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """Distinct tuples with their multiplicity m."""
    cols = [clean(F.col(a.name), a).alias(a.name) for a in attributes]
    return df.select(*cols).groupBy(*[a.name for a in attributes]).agg(F.count(F.lit(1)).alias("m"))


def _blocks(rows: int, block: int) -> int:
    """Blocks of at most about `block` rows; 16 at least, for 136 pairs of blocks, where there are rows enough."""
    return max(-(-rows // block), min(16, 1 + rows // 64))


def _block_pairs(rows: DataFrame, blocks: int, place: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join over block pairs lo <= hi: columns lo, hi, r (the row)."""
    rows = rows.withColumn("_b", place)
    row = F.struct(*[c for c in rows.columns if c != "_b"]).alias("r")
    left = rows.select(F.col("_b").alias("lo"), F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))).alias("hi"), row)
    right = rows.select(F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("lo"), F.col("_b").alias("hi"), row)
    return left, right


def _pairs(rows: DataFrame, blocks: int, order: Sequence[str], place: Column) -> DataFrame:
    """a, b: every unordered pair of different rows, once. order: columns that tell rows apart."""
    left, right = _block_pairs(rows, blocks, place)
    # Given by number: small tables would be joined to one task, but a pair costs more than its bytes.
    spark = rows.sparkSession
    parts = min(blocks * (blocks + 1) // 2, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left, right = left.repartition(parts, "lo", "hi"), right.repartition(parts, "lo", "hi").withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    a = left.select("lo", "hi", F.col("r").alias("a"))
    b = right.select("lo2", "hi2", F.col("r").alias("b"))
    key = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in order])
    once = (F.col("lo") < F.col("hi")) | (key("a") < key("b"))
    return a.join(b.hint("shuffle_hash"), (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2")) & once).select("a", "b")


def recoded(rows: DataFrame, attributes: Sequence[Attribute]) -> tuple[DataFrame, list[Code | None]]:
    """rows with values that compare fast, and how they compare; None for values that stay as they are.

    Numbers that keep to their column's digits become whole numbers, so that no pair is rounded; strings of at most CODES distinct values become
    codes, with the levels of all pairs of values worked out once in a table of CODES ** 2 entries at most."""
    checks = []
    for i, x in enumerate(attributes):
        if x.kind == NUMBER and x.digits > 300:  # beyond a double's powers of ten
            checks.append(F.lit(0).alias(f"k{i}"))
        elif x.kind == NUMBER:
            scaled = F.col(x.name) * 10.0**x.digits
            checks.append(F.min(((F.abs(scaled - F.round(scaled)) < 1e-6) & (F.abs(scaled) < 2.0**50)).cast("int")).alias(f"k{i}"))
        else:
            checks.append(F.approx_count_distinct(x.name).alias(f"k{i}"))
    seen, codes = rows.agg(*checks).first(), []
    for i, x in enumerate(attributes):
        code = None
        if x.kind == NUMBER and seen[f"k{i}"] == 1:
            rows = rows.withColumn(x.name, F.round(F.col(x.name) * 10.0**x.digits).cast("long"))
            code = Code(x.levels, tuple(math.floor(min(t * 10.0**x.digits, 2.0**52) + 1e-6) for t in x.thresholds))  # 2 ** 52: beyond any difference
        elif x.kind != NUMBER and seen[f"k{i}"] <= CODES:
            values = rows.select(x.name).distinct().limit(2 * CODES + 1)
            texts = sorted(r[0] for r in values.collect())  # at most 2 * CODES + 1
            if 0 < len(texts) <= 2 * CODES:
                lit = F.array(*[F.lit(t) for t in texts])
                each = rows.sparkSession.range(1).select(F.explode(lit).alias("u"), lit.alias("all")).select(F.transform("all", lambda v: level(F.col("u"), v, x).cast("int")).alias("l"), F.array_position("all", F.col("u")).alias("i"))
                table = [n for r in sorted(each.collect(), key=lambda r: r["i"]) for n in r["l"]]
                rows = rows.withColumn(x.name, (F.array_position(lit, F.col(x.name)) - 1).cast("int"))
                code = Code(x.levels, (), len(texts), tuple(table))
        codes.append(code)
    return rows, codes


def pair_levels(attributes: Sequence[Attribute], codes: Sequence[Code | None]) -> list[Column]:
    """The levels of a pair a, b of recoded rows."""
    levels = []
    for x, code in zip(attributes, codes):
        a, b = F.col(f"a.{x.name}"), F.col(f"b.{x.name}")
        if code is None:
            found = level(a, b, x)
        elif code.size:
            found = F.element_at(F.expr(f"array({','.join(map(str, code.table))})"), a * code.size + b + 1).cast("byte")
        else:
            found = reduce(lambda p, q: p + q, [(F.abs(a - b) <= t).cast("int") for t in code.limits]).cast("byte")
        levels.append(found.alias(f"lv_{x.name}"))
    return levels


def merge(parts: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """Evidence rows with equal levels added up."""
    return parts.groupBy(*names(attributes)).agg(F.sum("cnt").cast("long").alias("cnt"))


def evidence(df: DataFrame, attributes: Sequence[Attribute], block: int = BLOCK_TUPLES) -> DataFrame:
    """lv_<attribute> for each attribute with thresholds, cnt."""
    attributes = usable(attributes)
    rows = materialised(tuples(df, attributes))
    count = rows.count()
    blocks = _blocks(count, block)
    cols = [a.name for a in attributes]
    place = F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")
    fast, codes = recoded(rows, attributes)
    if count >= SWEEP_TUPLES and (found := swept(fast, attributes, codes)) is not None:
        return found
    cross = _pairs(fast, blocks, cols, place).select(*pair_levels(attributes, codes), (F.col("a.m") * F.col("b.m")).alias("cnt"))
    own = rows.where("m > 1").select(*[F.lit(a.levels).cast("byte").alias(f"lv_{a.name}") for a in attributes], F.expr("m * (m - 1) div 2").alias("cnt"))
    return merge(cross.unionByName(own), attributes)


def evidence_by_row(df: DataFrame, attributes: Sequence[Attribute], key: str) -> DataFrame:
    """The same from pairs of rows, without tuples: every pair of rows by a unique key."""
    attributes = usable(attributes)
    rows = df.select(F.col(key).alias("_key"), *[clean(F.col(a.name), a).alias(a.name) for a in attributes])
    blocks = _blocks(df.count(), BLOCK_TUPLES)
    rows, codes = recoded(rows, attributes)
    return merge(_pairs(rows, blocks, ["_key"], F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int")).select(*pair_levels(attributes, codes), F.lit(1).cast("long").alias("cnt")), attributes)


def evidence_blocked(df: DataFrame, attributes: Sequence[Attribute], key: str, shard: int = 10_000) -> DataFrame:
    """The same from pairs of row shards: rows are dealt to shards of about `shard` rows, and each pair of shards is worked off by itself.

    Rows that can be swept are dealt along the swept number, equal ones as one tuple: the pairs within a shard are counted at its points, those with
    the shards before it by the sums of these for each group."""
    attributes = usable(attributes)
    alike = materialised(tuples(df, attributes))
    if alike.count() >= SWEEP_TUPLES:
        fast, codes = recoded(alike, attributes)
        if (found := swept(fast, attributes, codes, shard)) is not None:
            return found
    rows = df.select(F.col(key).alias("_key"), *[clean(F.col(a.name), a).alias(a.name) for a in attributes])
    shards = max(1, -(-df.count() // shard))
    rows, codes = recoded(rows, attributes)
    pairs = _pairs(rows, shards, ["_key"], F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("int"))
    return merge(pairs.select(*pair_levels(attributes, codes), F.lit(1).cast("long").alias("cnt")), attributes)


def evidence_added(old: DataFrame, new: DataFrame, attributes: Sequence[Attribute], block: int = BLOCK_TUPLES) -> DataFrame:
    """Evidence of the pairs that rows `new` bring to a table `old`: new with old, and new among themselves."""
    attributes = usable(attributes)
    a = tuples(old, attributes)
    b = tuples(new, attributes)
    a, b = materialised(a), materialised(b)
    many, few = (max(1, -(-x.count() // block)) for x in (a, b))  # a task for each pair of blocks
    own = lambda blocks: F.pmod(F.xxhash64(*[x.name for x in attributes]), F.lit(blocks))
    left = a.select(F.struct(*a.columns).alias("a"), own(many).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("_j"))
    right = b.select(F.struct(*b.columns).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("_k"), own(few).alias("_l"))
    both = left.join(right, (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l"))).select(*[level(F.col(f"a.{x.name}"), F.col(f"b.{x.name}"), x).alias(f"lv_{x.name}") for x in attributes], (F.col("a.m") * F.col("b.m")).alias("cnt"))
    return merge(both.unionByName(evidence(new, attributes, block)), attributes)


def sorted_evidence(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("cnt"), *[c for c in found.columns if c != "cnt"])


def value_pairs(df: DataFrame, attribute: Attribute) -> DataFrame:
    """a, b, distance, level: pairs a < b of distinct values that are within the loosest threshold, each distance worked out once."""
    from .simjoin import band_pairs, similar_pairs

    values = df.select(clean(F.col(attribute.name), attribute).alias("v")).distinct()
    if attribute.kind == "number":
        found = band_pairs(values, "v", attribute.thresholds[-1], attribute.digits)
    else:
        found = similar_pairs(values, "v", int(attribute.thresholds[-1]))
    return found.withColumn("level", level(F.col("a"), F.col("b"), attribute))
