"""The evidence set without pairs: a sweep along the number with the most values, exact and over all rows.

The values of the other attributes make groups, whose levels with each other are worked out once. For each threshold t of the swept number, every tuple is
a point at its value v and a row at v - t; the pairs within t then follow from how many rows of each group lie at or below each point. Points and rows are dealt to
ranges of values. A range counts its own from a running sum for each group, taken up from one piece of rows to the next; rows of earlier ranges lie
below all points of a range and are counted by products of group counts. A tuple thus meets groups instead of tuples: the work is tuples times groups.

Where a second number makes more than NEAR_GROUPS groups, only the pairs that are within its loosest threshold are counted so, in bands of that number as wide
as the threshold, with the two bands beside each; the others are those of the evidence without this number, less the pairs within.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import NUMBER, Attribute
from ..work import materialised

#: Groups up to which tuples are swept, and vectors of levels of these groups.
GROUPS, KINDS = 8192, 1 << 16
#: Groups from which a second number is banded, and the most tuples and groups of a band for that; a task holds three bands.
NEAR_GROUPS, BAND_ROWS, BAND_GROUPS = 512, 500_000, 1024
#: Counts of groups that a task holds at once for one piece of rows.
CELLS = 1_000_000
#: Rows of a range, at most about so many.
RANGE_ROWS = 200_000


@dataclass(frozen=True)
class Code:
    """How the whole numbers that stand for a column's values compare: by limits on their difference, or by a table of the levels of `size` strings."""

    levels: int
    limits: tuple[int, ...] = ()
    size: int = 0
    table: tuple[int, ...] = ()

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Levels of every a with every b."""
        if self.size:
            return np.array(self.table, np.uint16).reshape(self.size, self.size)[a[:, None], b[None]]
        apart = np.abs(a[:, None] - b[None])
        return reduce(np.add, [(apart <= t).astype(np.uint16) for t in self.limits])


def kinds_of(values: Sequence[np.ndarray], codes: Sequence[Code], size: int) -> np.ndarray:
    """The vector of levels of each pair of groups, as one number."""
    out = np.zeros((size, size), np.uint16)
    step = max(1, CELLS // size)
    for i in range(0, size, step):
        for x, c in zip(values, codes):
            out[i : i + step] = out[i : i + step] * np.uint16(c.levels + 1) + c.between(x[i : i + step], x)
    return out


def by_kind(kinds: np.ndarray, sums: np.ndarray, count: int) -> np.ndarray:
    """Sums added up by kind, exactly."""
    if int(sums.max(initial=0)) * sums.size < 2**53:
        return np.bincount(kinds.ravel(), sums.ravel(), count).astype(np.int64)
    out = np.zeros(count, np.int64)
    np.add.at(out, kinds.ravel(), sums.ravel())
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of counts, exactly; in floating point as long as that is exact."""
    if int(a.sum()) * int(b.max(initial=0)) < 2**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def below(v: np.ndarray, g: np.ndarray, m: np.ndarray, row: np.ndarray, kinds: np.ndarray, count: int, step: int) -> np.ndarray:
    """By kind of the groups: pairs of a point with a row that lies at or below it, `step` points and rows at a time."""
    order = np.lexsort((~row, v))  # rows before points of the same value
    out, run = np.zeros(count, np.int64), np.zeros(len(kinds), np.int64)
    for i in range(0, len(order), step):
        part = order[i : i + step]
        rows, points = np.flatnonzero(row[part]), np.flatnonzero(~row[part])
        grid = np.zeros((len(part), len(kinds)), np.int64)
        grid[rows, g[part][rows]] = m[part][rows]
        grid[0] += run
        np.cumsum(grid, 0, out=grid)
        run = grid[-1].copy()
        if len(points):
            points = points[np.argsort(g[part][points], kind="stable")]
            who, first = np.unique(g[part][points], return_index=True)
            out += by_kind(kinds[who], np.add.reduceat(grid[points] * m[part][points][:, None], first, axis=0), count)
    return out


def swept(rows: DataFrame, attributes: Sequence[Attribute], codes: Sequence[Code | None], piece: int | None = None) -> DataFrame | None:
    """Evidence of coded tuples with their multiplicity m, or None where the tuples can't be swept: values that stay as they are, no number, or too many
    groups for it to be less work than all pairs. piece: rows that a task counts at a time."""
    import pandas as pd

    numbers = [i for i, (a, c) in enumerate(zip(attributes, codes)) if a.kind == NUMBER and c is not None]
    if None in codes or not numbers:
        return None
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(attributes[i].name).alias(f"k{i}") for i in numbers]).first()
    at = max(numbers, key=lambda i: seen[f"k{i}"])
    rest = [i for i in range(len(attributes)) if i != at]
    own, limits, others = codes[at], codes[at].limits, [codes[i] for i in rest]
    count = math.prod(c.levels + 1 for c in others)
    if count > KINDS:
        return None
    points = rows.select(F.col(attributes[at].name).cast("long").alias("v"), *[F.col(attributes[i].name).cast("long").alias(f"o{i}") for i in rest], "m")
    names = [f"o{i}" for i in rest]
    found = points.groupBy(*names).agg(F.sum("m").alias("m")).limit(GROUPS + 1).collect()  # at most GROUPS + 1
    size = len(found)
    if size > NEAR_GROUPS and (near := banded(rows, attributes, codes, at, max((i for i in numbers if i != at), key=lambda i: seen[f"k{i}"], default=None), points, rest, piece)) is not None:
        return near
    if size > GROUPS or 2 * len(limits) * size > seen["n"]:
        return None

    spark = rows.sparkSession
    weights = np.array([r["m"] for r in found], np.int64)
    values = [np.array([r[c] for r in found], np.int64) for c in names]
    if names:
        groups = spark.createDataFrame([(i, *[r[c] for c in names]) for i, r in enumerate(found)], ", ".join(["g int", *[f"{c} long" for c in names]]))
        points = points.join(F.broadcast(groups), names)
    else:
        points = points.withColumn("g", F.lit(0))
    moved = [F.struct(F.lit(0).alias("k"), F.col("v").alias("v")), *[F.struct(F.lit(k).alias("k"), (F.col("v") - F.lit(t)).alias("v")) for k, t in enumerate(limits, 1)]]
    placed = points.select("g", "m", F.explode(F.array(*moved)).alias("e")).select("e.k", "e.v", "g", "m")
    total = seen["n"] * len(moved)
    parts = max(min(2 * spark.sparkContext.defaultParallelism, 1 + total // 4000), -(-total // RANGE_ROWS))
    step = max(1, min(CELLS // size, piece or CELLS))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """of 0: pairs within the range by kind; of 1: its points (k 0) and rows (k from 1 on) by group."""
        part = [b for b in batches if len(b)]
        if not part:
            return
        k, v, g, m = (np.concatenate([b[c].to_numpy() for b in part]) for c in ("k", "v", "g", "m"))
        kinds, low = kinds_of(values, others, size), v.min()
        for of in (0, 1):
            for j in range(1 - of, len(limits) + 1):
                mine = k == j
                if of:
                    sums = np.zeros(size, np.int64)
                    np.add.at(sums, g[mine], m[mine])
                else:
                    some = mine | (k == 0)
                    sums = below(v[some], g[some], m[some], mine[some], kinds, count, step)
                ids = np.flatnonzero(sums)
                yield pd.DataFrame({"of": np.full(len(ids), of, np.int32), "low": np.full(len(ids), low), "k": np.full(len(ids), j, np.int32), "id": ids.astype(np.int32), "cnt": sums[ids]})

    def across(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Points of each range with the rows of earlier ranges, for one threshold; k 0: all pairs."""
        kinds = kinds_of(values, others, size)
        lows, place = np.unique(part["low"].to_numpy(), return_inverse=True)
        both = np.zeros((2, len(lows), size), np.int64)
        both[(part["k"].to_numpy() > 0).astype(int), place, part["id"].to_numpy()] = part["cnt"].to_numpy()
        before = np.cumsum(both[1], 0) - both[1]
        out = []
        for j, a, b in [(key[0], both[0], before), *([(0, weights[None], weights[None])] if key[0] == 1 else [])]:
            sums, some = np.zeros(count, np.int64), max(1, CELLS // size)
            for i in range(0, size, some):
                sums += by_kind(kinds[i : i + some], product(np.ascontiguousarray(a[:, i : i + some].T), b), count)
            ids = np.flatnonzero(sums)
            out.append(pd.DataFrame({"k": np.full(len(ids), j, np.int32), "id": ids.astype(np.int32), "cnt": sums[ids]}))
        return pd.concat(out)

    local = materialised(placed.repartitionByRange(parts, "v").mapInPandas(ranges, "of int, low long, k int, id int, cnt long"))
    each = F.when(F.col("k") > 0, F.array("k")).otherwise(F.sequence(F.lit(1), F.lit(len(limits))))
    apart = local.where("of = 1").withColumn("t", F.explode(each)).groupBy("t").applyInPandas(across, "k int, id int, cnt long")
    return levels_of(local.where("of = 0").select("k", "id", "cnt").unionByName(apart), attributes, codes, at, int(weights.sum()))


def levels_of(parts: DataFrame, attributes: Sequence[Attribute], codes: Sequence[Code], at: int, rows: int) -> DataFrame:
    """Evidence from counts by threshold k of the swept number (0: all pairs) and kind id."""
    rest, top = [i for i in range(len(attributes)) if i != at], codes[at].levels
    count = math.prod(codes[i].levels + 1 for i in rest)
    sums = parts.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("cnt"))), F.lit(0)).alias(f"s{k}") for k in range(top + 1)])
    # Ordered pairs, a row with itself too, at level l or a tighter one: those not above t, both ways, less all pairs.
    reach = [F.col("s0"), *[2 * F.col(f"s{top - lv + 1}") - F.col("s0") for lv in range(1, top + 1)], F.lit(0)]
    itself = F.when(F.col("id") == count - 1, F.lit(rows)).otherwise(F.lit(0))
    exact = [F.struct(F.lit(lv).alias("lv"), (reach[lv] - reach[lv + 1] - (itself if lv == top else F.lit(0))).alias("cnt")) for lv in range(top + 1)]
    sums = sums.select("id", F.explode(F.array(*exact)).alias("e")).where("e.cnt > 0")
    columns, left = {at: F.col("e.lv")}, count
    for i in rest:
        left //= codes[i].levels + 1
        columns[i] = F.expr(f"id div {left} % {codes[i].levels + 1}")
    return sums.select(*[columns[i].cast("byte").alias(f"lv_{a.name}") for i, a in enumerate(attributes)], F.expr("e.cnt div 2").alias("cnt"))


def banded(rows: DataFrame, attributes: Sequence[Attribute], codes: Sequence[Code], at: int, by: int | None, points: DataFrame, rest: Sequence[int], piece: int | None) -> DataFrame | None:
    """Evidence by bands of the number `by`, or None if a band is too large or the rest can't be swept. points: v, the others as o<number>, m."""
    import pandas as pd

    if by is None:
        return None
    width, names = codes[by].limits[-1] + 1, [f"o{i}" for i in rest]
    points = points.withColumn("band", F.expr(f"(o{by} - pmod(o{by}, {width})) div {width}"))
    sizes = points.groupBy("band", *names).agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")).groupBy("band").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum("m").alias("m"))
    most = sizes.agg(F.max("n").alias("n"), F.max("g").alias("g"), F.sum("m").alias("m")).first()
    if most["n"] > BAND_ROWS or most["g"] > BAND_GROUPS:
        return None
    kept = [i for i in range(len(attributes)) if i != by]
    less = rows.groupBy(*[attributes[i].name for i in kept]).agg(F.sum("m").alias("m"))
    whole = swept(materialised(less), [attributes[i] for i in kept], [codes[i] for i in kept], piece)
    if whole is None:
        return None
    limits, others = codes[at].limits, [codes[i] for i in rest]
    count = math.prod(c.levels + 1 for c in others)

    def within(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Pairs of the points of a band with the rows of it and those beside it."""
        v, m, row = part["v"].to_numpy(), part["m"].to_numpy(), part["row"].to_numpy()
        found, g = np.unique(part[names].to_numpy(), axis=0, return_inverse=True)
        g, size = g.ravel(), len(found)
        out = {"k": [], "id": [], "cnt": []}
        if not row.all():
            kinds = kinds_of(list(found.T), others, size)
            step = max(1, min(CELLS // size, piece or CELLS))
            each = np.zeros((2, size), np.int64)
            np.add.at(each, (row.astype(int), g), m)
            for k in range(len(limits) + 1):
                sums = below(v - row * limits[k - 1], g, m, row, kinds, count, step) if k else by_kind(kinds, product(each[0][:, None], each[1][None]), count)
                ids = np.flatnonzero(sums)
                out = {"k": [*out["k"], *[k] * len(ids)], "id": [*out["id"], *ids], "cnt": [*out["cnt"], *sums[ids]]}
        return pd.DataFrame(out).astype({"k": np.int32, "id": np.int32, "cnt": np.int64})

    beside = [F.struct((F.col("band") + d).alias("band"), F.lit(row).alias("row")) for d, row in ((0, False), (-1, True), (0, True), (1, True))]
    spread = points.select("v", *names, "m", F.explode(F.array(*beside)).alias("s")).select("s.band", "s.row", "v", *names, "m")
    near = levels_of(spread.groupBy("band").applyInPandas(within, "k int, id int, cnt long"), attributes, codes, at, most["m"])
    level = f"lv_{attributes[by].name}"
    near = materialised(near.where(F.col(level) > 0))
    far = whole.withColumn(level, F.lit(0).cast("byte")).unionByName(near.withColumn(level, F.lit(0).cast("byte")).withColumn("cnt", -F.col("cnt")))
    lvs = [f"lv_{a.name}" for a in attributes]
    return far.unionByName(near).groupBy(*lvs).agg(F.sum("cnt").cast("long").alias("cnt")).where("cnt > 0").select(*lvs, "cnt")
