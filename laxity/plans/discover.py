"""All valid and minimal rules from an evidence set.

A candidate is valid if its violations stay within the budget. Tighter left-hand levels and a looser right-hand level never add
violations; so a valid candidate is minimal exactly if none of its direct neighbours - one left-hand level looser, or the right-hand level one tighter - is
valid. Dominated candidates are therefore found by an equal-key anti join, not by comparing all pairs.

Four ways give the same rules: `grid` measures all candidates in one query; `lattice` goes up level by level and leaves out what a
valid candidate dominates; `separate` works off each right-hand attribute in a task of its own, over a dense array; `pruned` does so
by a search that goes on from a left-hand side only as long as its violations are over the budget at some right-hand level, and is for
wide tables, whose grid cannot be laid out. discover() takes it by itself where the grid has more than GRID_CELLS candidates or the array more than DENSE_CELLS cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import all_of
from ..spec import Attribute, usable
from ..work import BROADCAST_ROWS, materialised
from .validate import budget

#: Cells of the candidate grid up to which it is laid out as a whole.
GRID_CELLS = 2_000_000
#: Cells of the dense array of one right-hand attribute.
DENSE_CELLS = 4_000_000
#: Comparisons of left-hand sides with evidence that a task makes at once.
STEP = 2_000_000


def _x(attributes: Sequence[Attribute]) -> list[str]:
    return [f"x_{a.name}" for a in attributes]


def schema(attributes: Sequence[Attribute]) -> str:
    return ", ".join(["rhs string", *[f"`x_{a.name}` int" for a in attributes], "r int", "violations long", "support long", "total long"])


def is_small(evidence: DataFrame) -> bool:
    return evidence.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def measured(candidates: DataFrame, evidence: DataFrame, attributes: Sequence[Attribute], small: bool | None = None) -> DataFrame:
    """candidates (rhs, x_<attribute>, r) with violations, support, total. The evidence set is small: its rows are bounded by the grid; it is
    broadcast when counted within the bound. small: whether it is, if it has been counted."""
    small = is_small(evidence) if small is None else small
    total = evidence.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"))
    rhs_level = reduce(lambda acc, a: F.when(F.col("rhs") == a.name, F.col(f"lv_{a.name}")).otherwise(acc), attributes, F.lit(None).cast("byte"))
    on = all_of((F.col(f"lv_{a.name}") >= F.col(f"x_{a.name}")) for a in attributes)
    joined = candidates.join(F.broadcast(evidence) if small else evidence, on, "left").withColumn("_low", rhs_level < F.col("r"))
    out = joined.groupBy("rhs", *_x(attributes), "r").agg(F.coalesce(F.sum(F.when(F.col("_low"), F.col("cnt"))), F.lit(0)).cast("long").alias("violations"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("support"))
    return out.join(F.broadcast(total))


def all_candidates(evidence: DataFrame, attributes: Sequence[Attribute], rhs: Attribute) -> DataFrame:
    """rhs, x_<attribute> (0 for the right-hand one), r."""
    out = evidence.sparkSession.range(1).select(F.lit(rhs.name).alias("rhs"))
    for a in attributes:
        out = out.withColumn(f"x_{a.name}", F.lit(0) if a.name == rhs.name else F.explode(F.sequence(F.lit(0), F.lit(a.levels))))
    return out.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rhs.levels)))).repartition("rhs", *_x(attributes))


def grid_cells(attributes: Sequence[Attribute], rhs: str | None = None) -> int:
    """Candidates of the whole grid."""
    return sum(a.levels * math.prod(b.levels + 1 for b in attributes if b.name != a.name) for a in attributes if rhs in (None, a.name))


def valid(evidence: DataFrame, attributes: Sequence[Attribute], error: float, rhs: str | None = None) -> DataFrame:
    """Every valid candidate of the grid, measured."""
    attributes = usable(attributes)
    chosen = [a for a in attributes if rhs in (None, a.name)]
    if (cells := grid_cells(attributes, rhs)) > GRID_CELLS:
        raise ValueError(f"the grid has {cells} candidates; use lattice or pruned")
    parts = [all_candidates(evidence, attributes, a) for a in chosen]
    found = measured(reduce(DataFrame.unionByName, parts), evidence, attributes)
    return found.where(F.col("violations") <= budget(F.col("total"), error))


def minimal(found: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """Those of all valid candidates that no other one dominates, by their direct neighbours."""
    attributes = usable(attributes)
    xs = _x(attributes)
    key = F.struct(*[F.col(x) for x in xs], F.col("r")).alias("k")
    above = []
    for a in attributes:  # one left-hand level tighter
        cells = [F.struct(*[(F.col(x) + (1 if x == f"x_{a.name}" else 0)).alias(x) for x in xs], F.col("r").alias("r"))]
        above.append(F.when(F.col("rhs") != a.name, cells[0]))
    above.append(F.struct(*[F.col(x).alias(x) for x in xs], (F.col("r") - 1).alias("r")))
    worse = found.select(F.col("rhs").alias("_rhs"), F.explode(F.array(*above)).alias("k2")).where("k2 is not null").distinct()
    kept = found.withColumn("k", key).join(worse, (F.col("rhs") == F.col("_rhs")) & (F.col("k") == F.col("k2")), "left_anti")
    return kept.drop("k")


def grid(evidence: DataFrame, attributes: Sequence[Attribute], error: float, rhs: str | None = None) -> DataFrame:
    return minimal(valid(evidence, attributes, error, rhs), attributes)


def lattice(evidence: DataFrame, attributes: Sequence[Attribute], error: float, rhs: str | None = None) -> DataFrame:
    """Level by level from the empty left-hand side and the tightest right-hand level: valid candidates leave, the others expand by one step;
    what a found one dominates is left out. Each level is measured, written and read again as one table; the evidence is counted once."""
    attributes = usable(attributes)
    xs = _x(attributes)
    levels = {a.name: a.levels for a in attributes}
    root = reduce(DataFrame.unionByName, [evidence.sparkSession.range(1).select(F.lit(a.name).alias("rhs"), *[F.lit(0).alias(x) for x in xs], F.lit(a.levels).alias("r")) for a in attributes if rhs in (None, a.name)])
    queue, found, small = root, None, is_small(evidence)
    while True:
        now = measured(queue, evidence, attributes, small)
        now = materialised(now.withColumn("ok", F.col("violations") <= budget(F.col("total"), error)))
        if found is not None and now.isEmpty():
            break
        new = now.where("ok").drop("ok")
        found = new if found is None else found.unionByName(new)
        steps = [F.when((F.col("rhs") != a.name) & (F.col(f"x_{a.name}") < levels[a.name]), F.struct(*[(F.col(x) + (1 if x == f"x_{a.name}" else 0)).alias(x) for x in xs], F.col("r").alias("r"))) for a in attributes]
        steps.append(F.when(F.col("r") > 1, F.struct(*[F.col(x).alias(x) for x in xs], (F.col("r") - 1).alias("r"))))
        ahead = now.where("not ok").select("rhs", F.explode(F.array(*steps)).alias("s")).where("s is not null").select("rhs", "s.*").distinct()
        best = found.select(F.col("rhs").alias("_rhs"), *[F.col(x).alias(f"_{x}") for x in xs], F.col("r").alias("_r"))
        under = (F.col("rhs") == F.col("_rhs")) & all_of(F.col(f"_{x}") <= F.col(x) for x in xs) & (F.col("_r") >= F.col("r"))
        queue = ahead.join(best, under, "left_anti")
    # A candidate of a later level can be better than none found before, but never dominates one; the others go here.
    a, b = found.alias("a"), found.alias("b")
    differ = reduce(lambda p, q: p | q, [F.col(f"a.{c}") != F.col(f"b.{c}") for c in [*xs, "r"]])
    worse = (F.col("a.rhs") == F.col("b.rhs")) & all_of(F.col(f"b.{x}") <= F.col(f"a.{x}") for x in xs) & (F.col("b.r") >= F.col("a.r")) & differ
    return a.join(b, worse, "left_anti")


def separate(evidence: DataFrame, attributes: Sequence[Attribute], error: float, rhs: str | None = None) -> DataFrame:
    """One task for each right-hand attribute: a dense array of counts, summed up from the tight end of each left-hand attribute."""
    import pandas as pd

    attributes = usable(attributes)
    cols = [a.name for a in attributes]
    sizes = [a.levels for a in attributes]
    chosen = [c for c in cols if rhs in (None, c)]
    rows = evidence.withColumn("rhs", F.explode(F.array(*[F.lit(c) for c in chosen])))

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at = cols.index(key[0])
        cube = np.zeros([k + 1 for k in sizes], np.int64)
        np.add.at(cube, tuple(part[f"lv_{c}"].to_numpy().astype(int) for c in cols), part["cnt"].to_numpy())
        total = int(cube.sum())
        for axis in range(len(cols)):
            if axis != at:
                cube = np.flip(np.cumsum(np.flip(cube, axis), axis), axis)
        support = cube.sum(at, keepdims=True)
        low = np.cumsum(cube, at)  # pairs with a right-hand level up to l
        low = np.moveaxis(np.delete(low, sizes[at], at), at, -1)  # last axis: r - 1
        support = np.moveaxis(np.broadcast_to(support, cube.shape), at, -1)[..., : sizes[at]]
        ok = low <= np.floor(total * float(error))
        best = ok.copy()
        best[..., :-1] &= ~ok[..., 1:]
        for axis in range(len(cols) - 1):
            tight = [slice(None)] * ok.ndim
            loose = list(tight)
            tight[axis], loose[axis] = slice(1, None), slice(None, -1)
            best[tuple(tight)] &= ~ok[tuple(loose)]
        where = np.argwhere(best)
        out = {"rhs": np.array([key[0]] * len(where), dtype=object)}
        others = [c for c in cols if c != key[0]]
        for c in cols:
            out[f"x_{c}"] = where[:, others.index(c)] if c != key[0] else np.zeros(len(where), int)
        out |= {"r": where[:, -1] + 1, "violations": low[best], "support": support[best], "total": [total] * len(where)}
        return pd.DataFrame(out)

    return rows.groupBy("rhs").applyInPandas(search, schema(attributes))


def search(levels: np.ndarray, own: np.ndarray, cnt: np.ndarray, most: list[int], own_most: int, error: float) -> list[tuple]:
    """Minimal (x, r, violations, support). levels: of each evidence on the left-hand attributes; own: on the right-hand one; most: the tightest levels.

    A left-hand side's best right-hand level only rises as the side gets tighter, and ends at own_most; sides beyond that are not looked at."""
    budget, out = int(np.floor(int(cnt.sum()) * float(error))), []
    by_own = np.zeros((len(cnt), own_most + 1), np.int64)
    by_own[np.arange(len(cnt)), own] = cnt
    front, before = np.zeros((1, len(most)), np.int64), {}  # before: the best level of each side of the last round that is to go on
    while len(front):
        ahead, found = [], {}
        for i in range(0, len(front), max(1, STEP // max(1, levels.size))):
            some = front[i : i + max(1, STEP // max(1, levels.size))]
            sums = (levels[None] >= some[:, None]).all(2).astype(np.int64) @ by_own
            low = np.cumsum(sums, 1)  # low[r - 1]: violations at level r
            best = (low[:, :-1] <= budget).sum(1)
            for x, r, v, s in zip(some, best, low, sums.sum(1)):
                looser = [before.get((*x[:c], x[c] - 1, *x[c + 1 :]), own_most) for c in np.flatnonzero(x)]
                if own_most in looser:  # a looser side has the tightest level already
                    continue
                if r > max(looser, default=0):
                    out.append((tuple(x.tolist()), int(r), int(v[r - 1]), int(s)))
                if r < own_most:
                    found[tuple(x.tolist())] = int(r)
                    ahead += [x + step for step in np.eye(len(most), dtype=np.int64) if (x + step <= most).all()]
        before, front = found, np.unique(np.array(ahead), axis=0) if ahead else np.zeros((0, len(most)), np.int64)
    return out


def pruned(evidence: DataFrame, attributes: Sequence[Attribute], error: float, rhs: str | None = None) -> DataFrame:
    """One task for each right-hand attribute: search() over its evidence, whose vectors the task holds."""
    import pandas as pd

    attributes = usable(attributes)
    cols, sizes = [a.name for a in attributes], [a.levels for a in attributes]
    rows = evidence.withColumn("rhs", F.explode(F.array(*[F.lit(c) for c in cols if rhs in (None, c)])))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at = cols.index(key[0])
        found = part[[f"lv_{c}" for c in cols]].to_numpy().astype(np.int8)
        total = int(part["cnt"].sum())
        best = search(np.delete(found, at, 1), found[:, at], part["cnt"].to_numpy(), sizes[:at] + sizes[at + 1 :], sizes[at], error)
        rules = [(key[0], *x[:at], 0, *x[at:], r, v, s, total) for x, r, v, s in best]
        return pd.DataFrame(rules, columns=["rhs", *_x(attributes), "r", "violations", "support", "total"])

    return rows.groupBy("rhs").applyInPandas(run, schema(attributes))


METHODS = {"grid": grid, "lattice": lattice, "separate": separate, "pruned": pruned}


def discover(evidence: DataFrame, attributes: Sequence[Attribute], error: float = 0.01, method: str = "grid", rhs: str | None = None) -> DataFrame:
    """Valid and minimal rules: rhs, x_<attribute>, r, violations, support, total, g1, utility columns come by plans.topk."""
    some = usable(attributes)
    if (method == "grid" and grid_cells(some, rhs) > GRID_CELLS) or (method == "separate" and math.prod(a.levels + 1 for a in some) > DENSE_CELLS):
        method = "pruned"
    out = METHODS[method](evidence, attributes, error, rhs)
    return out.withColumn("g1", F.when(F.col("total") > 0, F.col("violations") / F.col("total")).otherwise(F.lit(0.0)))
