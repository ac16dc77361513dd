import itertools
import math
import random
import threading

import numpy as np
import pytest

from laxity import queries
from laxity.operators import evidence as ev
from laxity.operators import sweep
from laxity.spec import Attribute

from .test_rules import ATTRIBUTES, as_dict, edits, frame, plain_evidence, plain_rules, sample

#: Customers whose pairs, 5 * 10 ** 9, no run gets through within LIMIT seconds.
MANY, LIMIT = 100_000, 100


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with the table, and its evidence by binary search from group to group."""
    rnd, folder = np.random.default_rng(1), tmp_path_factory.mktemp("many")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    nation, cents, segment = rnd.integers(0, 25, MANY), rnd.integers(-99_999, 999_999, MANY), rnd.integers(0, 5, MANY)
    import pandas as pd

    rows = pd.DataFrame({"c_custkey": np.arange(MANY), "c_nationkey": nation.astype(np.int32), "c_acctbal": cents / 100, "c_mktsegment": np.array(names, object)[segment]})
    rows.to_parquet(folder / "customer.parquet")
    by = {(n, s): np.sort(cents[(nation == n) & (segment == s)]) for n in range(25) for s in range(5)}
    near = [[sum(edits(a, b) <= t for t in (0, 4, 6)) for b in names] for a in names]
    out = {}
    for (n, s), a in by.items():
        for (o, u), b in by.items():
            within = [int((np.searchsorted(b, a + t, "right") - np.searchsorted(b, a - t)).sum()) for t in (100, 10_000, 100_000)] + [len(a) * len(b)]
            for lv, low, high in ((3, 0, within[0]), *[(2 - i, within[i], within[i + 1]) for i in range(3)]):
                key = (sum(abs(n - o) <= t for t in (0, 1, 2)), lv, near[s][u])
                out[key] = out.get(key, 0) + high - low
    out[3, 3, 3] -= MANY
    return str(folder), {k: c // 2 for k, c in out.items() if c}


def in_time(spark, query, folder):
    """The query's rows; its jobs are cancelled after LIMIT seconds."""
    timer = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return queries.QUERIES[query](spark, folder).collect()
    finally:
        timer.cancel()


def test_evidence_of_many_tuples(spark, many):
    folder, want = many
    rows = in_time(spark, "evidence_customer", folder)
    assert {tuple(r)[:3]: r["cnt"] for r in rows} == want and sum(want.values()) == MANY * (MANY - 1) // 2


def test_blocked_evidence_of_many_rows(spark, many):
    folder, found = many
    want = {}
    for (n, v, _), c in found.items():
        want[n, v] = want.get((n, v), 0) + c
    assert {tuple(r)[:2]: r["cnt"] for r in in_time(spark, "evidence_blocked", folder)} == want


def levels_below(found):
    """Pairs and vectors by level of the segment, the tightest level left out."""
    want = {}
    for (*_, level), c in found.items():
        if level < 3:
            pairs, vectors = want.get(level, (0, 0))
            want[level] = pairs + c, vectors + 1
    return sorted((level, *x) for level, x in want.items())


def minimal_rules(found, error):
    return sorted((rhs, *x, r, bad) for rhs, x, r, bad in plain_rules(found, queries.CUSTOMER, error))


def valid_rules(found, error):
    out, total = [], sum(found.values())
    for b, rhs in enumerate(queries.CUSTOMER):
        for x in itertools.product(*[range(1) if c == b else range(a.levels + 1) for c, a in enumerate(queries.CUSTOMER)]):
            for r in range(1, rhs.levels + 1):
                bad = sum(n for e, n in found.items() if all(e[c] >= x[c] for c in range(3) if c != b) and e[b] < r)
                out += [(rhs.name, *x, r, bad)] if bad <= int(total * error) else []
    return sorted(out)


def best_rules(found, k, each, utility):
    """The k best rules, of each right-hand attribute or of all, with their utility."""
    total, names, scored = sum(found.values()), [a.name for a in queries.CUSTOMER], []
    for rhs, x, r, _ in plain_rules(found, queries.CUSTOMER, queries.ERROR):
        b = names.index(rhs)
        support = sum(n for e, n in found.items() if all(e[c] >= x[c] for c in range(3) if c != b))
        weight = sum(x[c] + 1 for c in range(3) if c != b)
        scored.append((-round(utility(r, support, weight, queries.CUSTOMER[b].levels, total), 12), rhs, *x, r))
    chosen = [row for rhs in names for row in sorted(s for s in scored if s[1] == rhs)[:k]] if each else sorted(scored)[:k]
    return sorted((*row, round(-u, 6)) for u, *row in chosen)


def rows_of(rows, *more):
    return sorted((r["rhs"], *[r[f"x_{a.name}"] for a in queries.CUSTOMER], r["r"], *[round(r[c], 6) for c in more]) for r in rows)


def with_violations(rows):
    return rows_of(rows, "violations")


def with_utility(rows):
    return rows_of(rows, "utility")


#: What each query that reads the evidence of all customers must give, and what of its rows is held against it.
READERS = {
    "evidence_by_rhs_level": (levels_below, lambda rows: sorted(map(tuple, rows))),
    "rules_customer_exact": (lambda found: minimal_rules(found, 0.0), with_violations),
    "rules_customer_lattice": (lambda found: minimal_rules(found, queries.ERROR), with_violations),
    "rules_customer_separate": (lambda found: minimal_rules(found, queries.ERROR), with_violations),
    "top_k_global": (lambda found: best_rules(found, 5, False, lambda r, s, w, n, total: r / (n + 2) * (s / total) / w), with_utility),
    "top_k_per_rhs": (lambda found: best_rules(found, 3, True, lambda r, s, w, n, total: r * math.log(s) / w if s else 0.0), with_utility),
    "valid_candidates": (lambda found: valid_rules(found, queries.ERROR), with_violations),
    "rules_customer_grid": (lambda found: minimal_rules(found, queries.ERROR), with_violations),
}


@pytest.mark.parametrize("query", READERS)
def test_readers_of_the_evidence_of_many_tuples(spark, many, query):
    folder, found = many
    want, got = READERS[query]
    assert got(in_time(spark, query, folder)) == want(found)


@pytest.mark.parametrize("seed,at_once", [(1, 1), (2, 40), (3, 100_000)])
def test_sweep_equals_all_pairs(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr(ev, "SWEEP_TUPLES", 0)
    monkeypatch.setattr(sweep, "CELLS", at_once)
    attributes = [Attribute("b", "string", (0, 1)), Attribute("c", "number", (0.1, 0.2, 1e300), 1), Attribute("a", "number", (0, 2))]
    rnd = random.Random(seed)
    rows = [(rnd.choice([0, 1, 2, None]), rnd.choice(["", "x", None, "abc"]), rnd.choice([None, *[i / 10 for i in range(-60, 60)]])) for _ in range(150)]
    want = plain_evidence([(b, c, a) for a, b, c in rows], attributes)
    fast, codes = ev.recoded(ev.tuples(frame(spark, rows), attributes), attributes)
    assert as_dict(sweep.swept(fast, attributes, codes), attributes) == want
    assert as_dict(ev.evidence(frame(spark, rows), attributes), attributes) == want
    assert as_dict(ev.evidence_blocked(frame(spark, rows), attributes, "id", 7), attributes) == want
    one = [attributes[1]]
    assert as_dict(ev.evidence(frame(spark, rows), one), one) == plain_evidence([(c,) for _, _, c in rows], one)


@pytest.mark.parametrize("seed", [5, 6])
def test_bands_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ev, "SWEEP_TUPLES", 0)
    monkeypatch.setattr(sweep, "NEAR_GROUPS", 3)
    calls, banded = [], sweep.banded
    monkeypatch.setattr(sweep, "banded", lambda *args: calls.append(banded(*args)) or calls[-1])
    attributes = [Attribute("n", "number", (0, 1, 3)), Attribute("c", "number", (0.1, 2), 1), Attribute("b", "string", (0, 1))]
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(-20, 20)]), rnd.randint(-90, 90) / 10, rnd.choice(["", "x", None, "abc"])) for _ in range(200)]
    df = spark.createDataFrame(rows + rows[:9], "n int, c double, b string")
    want = plain_evidence(rows + rows[:9], attributes)
    assert as_dict(ev.evidence(df, attributes), attributes) == want and calls[0] is not None
    monkeypatch.setattr(sweep, "BAND_ROWS", 3)
    assert as_dict(ev.evidence(df, attributes), attributes) == want and calls[-1] is None


def test_tables_that_cannot_be_swept_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ev, "SWEEP_TUPLES", 0)
    for rows in ([], [(0, 1, "x", 0.1)], [(i, i % 3, "x", float("nan") if i == 2 else 0.1 * i) for i in range(9)]):
        df = spark.createDataFrame(rows, "id long, a int, b string, c double")
        found = as_dict(ev.evidence(df, ATTRIBUTES))
        assert sum(found.values()) == len(rows) * (len(rows) - 1) // 2
    monkeypatch.setattr(sweep, "GROUPS", 2)
    rows = sample(4)
    assert as_dict(ev.evidence(frame(spark, rows), ATTRIBUTES)) == plain_evidence(rows, ATTRIBUTES)
