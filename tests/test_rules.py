import itertools
import random

import pytest
from pyspark.sql import functions as F

from laxity.functions.distance import edits_allowed, similar, tokens_needed
from laxity.operators import evidence as ev
from laxity.operators import profile
from laxity.operators.simjoin import similar_exists, similar_pairs
from laxity.plans import discover as dis
from laxity.plans import topk, validate
from laxity.plans.modes import rules
from laxity.sources import evidence_files, tables
from laxity.spec import Attribute, from_lines, number_grid, string_grid, usable
from laxity.streaming.incremental import EvidenceStream


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_level(a, b, x):
    if x.kind == "number":
        d = round(abs((a or 0) - (b or 0)) + 1e-12, x.digits)
    else:
        d = edits(a or "", b or "")
    return sum(d <= t for t in x.thresholds)


def plain_evidence(rows, attributes):
    out = {}
    for p, q in itertools.combinations(rows, 2):
        key = tuple(plain_level(p[i], q[i], x) for i, x in enumerate(attributes))
        out[key] = out.get(key, 0) + 1
    return out


def plain_rules(evidence, attributes, error):
    total, out = sum(evidence.values()), []
    for b, rhs in enumerate(attributes):
        space = [range(1) if c == b else range(x.levels + 1) for c, x in enumerate(attributes)]
        ok = []
        for x in itertools.product(*space):
            for r in range(1, rhs.levels + 1):
                bad = sum(n for e, n in evidence.items() if all(e[c] >= x[c] for c in range(len(x)) if c != b) and e[b] < r)
                if bad <= int(total * error):
                    ok.append((x, r, bad))
        for x, r, bad in ok:
            if not any((y, s) != (x, r) and s >= r and all(p <= q for p, q in zip(y, x)) for y, s, _ in ok):
                out.append((rhs.name, x, r, bad))
    return sorted(out)


ATTRIBUTES = [Attribute("a", "number", (0, 1, 2)), Attribute("b", "string", (0, 1)), Attribute("c", "number", (0.1, 0.2), 1)]


def sample(seed, n=24):
    rnd = random.Random(seed)
    return [(rnd.choice([0, 1, 2, 5, None]), rnd.choice(["", "x", "xy", "yx", None, "abc"]), rnd.choice([0.1, 0.3, 0.4, None])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a int, b string, c double")


def as_dict(df, attributes=ATTRIBUTES):
    return {tuple(r[f"lv_{x.name}"] for x in attributes): r["cnt"] for r in df.collect()}


def as_rules(df, attributes=ATTRIBUTES):
    return sorted((r["rhs"], tuple(r[f"x_{x.name}"] for x in attributes), r["r"], r["violations"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_evidence_all_ways(spark, seed):
    rows = sample(seed)
    df, want = frame(spark, rows), plain_evidence(rows, ATTRIBUTES)
    assert as_dict(ev.evidence(df, ATTRIBUTES)) == want
    assert as_dict(ev.evidence(df, ATTRIBUTES, block=3)) == want
    assert as_dict(ev.evidence_by_row(df, ATTRIBUTES, "id")) == want
    assert as_dict(ev.evidence_blocked(df, ATTRIBUTES, "id", 5)) == want
    assert sum(want.values()) == validate.pair_count(len(rows))
    parts = ev.evidence(df.where("id < 15"), ATTRIBUTES).unionByName(ev.evidence_added(df.where("id < 15"), df.where("id >= 15"), ATTRIBUTES))
    assert as_dict(ev.merge(parts, ATTRIBUTES)) == want


@pytest.mark.parametrize("seed,error", [(3, 0.0), (4, 0.05), (5, 0.2)])
def test_rules_all_methods(spark, seed, error):
    rows = sample(seed, 12)
    found = ev.evidence(frame(spark, rows), ATTRIBUTES).cache()
    want = plain_rules(plain_evidence(rows, ATTRIBUTES), ATTRIBUTES, error)
    for method in dis.METHODS:
        assert as_rules(dis.discover(found, ATTRIBUTES, error, method)) == want, method


def test_joint_levels_keep_the_best_right_side(spark):
    attributes = [Attribute("a", "number", (0, 1)), Attribute("b", "number", (0, 1, 2))]
    found = spark.createDataFrame([(2, 3, 1), (1, 2, 2), (1, 1, 3), (1, 0, 1), (1, 3, 3)], "lv_a int, lv_b int, cnt long")
    for method in dis.METHODS:
        got = {(r["x_a"], r["r"]) for r in dis.discover(found, attributes, 0.0, method, rhs="b").collect()}
        assert (2, 3) in got, method


def test_boundaries(spark):
    x = Attribute("v", "number", (0.2,), 1)
    assert as_dict(ev.evidence(spark.createDataFrame([(0.1,), (0.3,)], "v double"), [x]), [x]) == {(1,): 1}
    x = Attribute("v", "number", (1.6,))
    assert as_dict(ev.evidence(spark.createDataFrame([(3,), (4,), (5,)], "v int"), [x]), [x]) == {(1,): 2, (0,): 1}
    x = Attribute("v", "string", (0, 1))
    assert as_dict(ev.evidence(spark.createDataFrame([("",), (None,), ("a",)], "v string"), [x]), [x]) == {(2,): 1, (1,): 2}
    same = spark.createDataFrame([("k",)] * 7, "v string")
    assert as_dict(ev.evidence(same, [x]), [x]) == {(2,): 21}


def test_one_row_and_no_rows(spark):
    for rows in ([], [(0, 1, "x", 0.1)]):
        df = spark.createDataFrame(rows, "id long, a int, b string, c double")
        found = ev.evidence(df, ATTRIBUTES)
        assert found.collect() == []
        got = as_rules(dis.discover(found, ATTRIBUTES, 0.1, "grid"))
        assert got == plain_rules({}, ATTRIBUTES, 0.1)


def test_attribute_without_thresholds_is_left_out(spark):
    attributes = [ATTRIBUTES[0], Attribute("b", "string", ()), ATTRIBUTES[2]]
    assert ev.evidence(frame(spark, sample(6)), attributes).columns == ["lv_a", "lv_c", "cnt"]
    assert [a.name for a in usable(attributes)] == ["a", "c"]


def test_similar_strings(spark):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    for most in (0, 1, 3):
        want = {(a, b, edits(a, b)) for a, b in itertools.combinations(words, 2) if edits(a, b) <= most}
        assert {tuple(r) for r in similar_pairs(df, "w", most).collect()} == want
    some = words[::7]
    got = {r[0] for r in similar_exists(df, "w", df.where(F.col("w").isin(some)), "w", 1).collect()}
    assert got == {w for w in words if any(edits(w, s) <= 1 for s in some)}


def test_modes_and_top_k(spark):
    rows = sample(7, 16)
    df, want = frame(spark, rows), plain_rules(plain_evidence(rows, ATTRIBUTES), ATTRIBUTES, 0.1)
    for mode in (1, 2, 3, 8):
        assert as_rules(rules(df, ATTRIBUTES, mode, 0.1, key="id", shard=6)) == want
    best = rules(df, ATTRIBUTES, 5, 0.1, k=3).collect()
    assert len(best) == min(3, len(want)) and [r["utility"] for r in best] == sorted((r["utility"] for r in best), reverse=True)
    with pytest.raises(ValueError):
        rules(df, ATTRIBUTES, 8)
    text = topk.rendered(dis.grid(ev.evidence(df, ATTRIBUTES), ATTRIBUTES, 0.1), ATTRIBUTES).select("rule").collect()
    assert len(text) == len(want) and all(" --> [" in f" {r[0]}" for r in text)


def test_grids():
    assert number_grid(-5, -1) == pytest.approx((2 / 3, 4 / 3, 2))
    assert string_grid(4) == (1.0, 2.0) and string_grid(20) == (4.0, 7.0, 10.0) and string_grid(1) == ()
    got = from_lines(["1,0,1", ""], [("a", "number", 0), ("b", "string", 0), ("c", "number", 1)])
    assert [a.thresholds for a in got] == [(0.0, 1.0), (), ()]
    with pytest.raises(ValueError):
        Attribute("a", "number", (-1,))


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id(Integer),name(String),x,y\n1,a,3,0.5\n2,,4,\n3,7,5,2\n")
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), rows=2, key="id")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "bigint"), ("y", "double")] and df.count() == 2
    (tmp_path / "t.txt").write_text("\n0,1\n1,2\n0.5\n")
    got = tables.read_thresholds(spark, str(tmp_path / "t.txt"), df, {"y": 1})
    assert [(a.kind, a.thresholds, a.digits) for a in got] == [("number", (), 0), ("string", (0.0, 1.0), 0), ("number", (1.0, 2.0), 0), ("number", (0.5,), 1)]
    found = ev.evidence(frame(spark, sample(8)), ATTRIBUTES)
    for form in ("csv", "parquet"):
        path = str(tmp_path / form)
        evidence_files.save(found, path, form)
        assert as_dict(evidence_files.load(spark, path, ATTRIBUTES, form)) == as_dict(found)
    assert "inf)" in "".join(r[0] for r in evidence_files.readable(found, ATTRIBUTES).collect())


def test_digits_of_small_and_long_numbers(spark):
    rows = [(1e-10, 0.1234567890125, 25.0, 0.1, 0.0, 5e-324), (3e-10, 2.0, 1e20, None, 0.0, 0.0), (0.0, -7.5, 1234567.5, float("nan"), None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d float, e double, f double").withColumn("g", F.lit("0.120000000000").cast("decimal(20,12)"))
    assert {r[0]: r[1] for r in profile.decimal_digits(df, list("abcdefg")).collect()} == {"a": 10, "b": 13, "c": 1, "d": 1, "e": 0, "f": 325, "g": 2}  # f: 4.9E-324
    small = [Attribute("a", "number", (1e-10,), 10)]
    assert as_dict(ev.evidence(df.select("a"), small), small) == {(1,): 1, (0,): 2}
    tiny = [Attribute("f", "number", (0.5,), 325)]
    assert as_dict(ev.evidence(df.select("f"), tiny), tiny) == {(1,): 1, (0,): 2}


def test_stream_adds_up(spark, tmp_path):
    rows = sample(10, 18)
    for i in range(3):
        frame(spark, rows[i * 6 : i * 6 + 6]).drop("id").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, b string, c double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    kept = EvidenceStream(str(tmp_path / "state"), ATTRIBUTES)
    query = kept.start(stream, str(tmp_path / "cp"))
    query.awaitTermination()
    assert as_dict(kept.current(spark)) == plain_evidence(rows, ATTRIBUTES)


def test_edit_policies(spark):
    pairs = [("abcdefghij", "abcdefghxx"), ("abc", "abd"), ("a b c", "a b d"), ("", ""), ("abcdefghij", "abcdefgxyz")]
    a, b = F.col("a"), F.col("b")
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    row = frame.select("i", edits_allowed(a, b, "absolute", 3), edits_allowed(a, b, "normalised", 0.8), edits_allowed(a, b, "hybrid", 0.8), tokens_needed(a, b, 0.8), *[similar(a, b, p, t) for p, t in (("absolute", 1), ("normalised", 0.8), ("hybrid", 0.8), ("token", 0.5), ("token", 0.8))]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in row] == [
        (3, 2, 2, 1, False, True, True, False, False),
        (3, 0, 1, 1, True, False, True, False, False),
        (3, 1, 1, 3, True, True, True, True, False),
        (3, 0, 1, 0, True, True, True, True, True),
        (3, 2, 2, 1, False, False, False, False, False),
    ]
    with pytest.raises(ValueError):
        edits_allowed(a, b, "other", 1)


def test_wide_tables_are_searched_with_pruning(spark, monkeypatch):
    rnd = random.Random(11)
    attributes = [Attribute(f"c{i}", "number", (0, 2, 5)) for i in range(4)]
    rows = [tuple(float(rnd.randint(0, 9)) for _ in attributes) for _ in range(30)]
    frame = spark.createDataFrame(rows, ", ".join(f"{x.name} double" for x in attributes))
    want = sorted(map(tuple, rules(frame, attributes, 6, 0.2, k=3).select("rhs", *[f"x_{x.name}" for x in attributes], "r").collect()))
    monkeypatch.setattr(dis, "GRID_CELLS", 10)
    monkeypatch.setattr(dis, "DENSE_CELLS", 10)
    monkeypatch.setattr(dis, "STEP", 50)
    assert sorted(map(tuple, rules(frame, attributes, 6, 0.2, k=3).select("rhs", *[f"x_{x.name}" for x in attributes], "r").collect())) == want
    found = {m: sorted(map(tuple, dis.discover(ev.evidence(frame, attributes), attributes, 0.2, m).drop("g1").collect())) for m in ("separate", "lattice")}
    assert found["separate"] == found["lattice"] and len(found["separate"]) > 4


def test_a_value_of_another_type_fails(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a(Integer),b\n1,x\n,y\nz,w\n")
    with pytest.raises(Exception, match="not Integer"):
        tables.read_csv(spark, str(tmp_path / "t.csv")).collect()


def test_added_evidence_in_blocks(spark):
    rnd = random.Random(12)
    attributes = [Attribute("a", "number", (0, 3)), Attribute("b", "string", (0, 1))]
    rows = [(float(rnd.randint(0, 20)), rnd.choice(["ab", "b", "abc"])) for _ in range(40)]
    old, new = (spark.createDataFrame(r, "a double, b string") for r in (rows[:25], rows[25:]))
    both = ev.merge(ev.evidence(old, attributes).unionByName(ev.evidence_added(old, new, attributes, block=4)), attributes)
    assert {tuple(r)[:-1]: r["cnt"] for r in both.collect()} == plain_evidence(rows, attributes)


def test_lattice_writes_each_level_once(spark, monkeypatch):
    monkeypatch.setattr(dis, "materialised", lambda df, own=dis.materialised: written.append(own(df)) or written[-1])
    written, rows = [], [(0, 0, 0, 4), (1, 2, 1, 3), (2, 1, 1, 2), (1, 1, 0, 1)]
    found = spark.createDataFrame(rows, "lv_a byte, lv_b byte, lv_c byte, cnt long")
    some = [Attribute("a", "number", (0, 1)), Attribute("b", "number", (0, 1)), Attribute("c", "number", (0,))]
    want = sorted(map(tuple, dis.grid(found, some, 0.3).collect()))
    assert sorted(map(tuple, dis.lattice(found, some, 0.3).collect())) == want and want
    assert len(written) <= 1 + sum(a.levels + 1 for a in some)
