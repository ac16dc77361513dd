"""The queries of the driver contract, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import clean, edits_allowed, similar, tokens_needed
from .operators import evidence as ev
from .operators import profile, simjoin
from .plans import discover as dis
from .plans import topk, validate
from .plans.modes import rules
from .sources.evidence_files import load, readable, save
from .sources.tables import read_csv, read_thresholds
from .spec import NUMBER, STRING, Attribute, number_grid, string_grid, usable
from .work import materialised, shared_folder

CUSTOMER = [Attribute("c_nationkey", NUMBER, (0, 1, 2)), Attribute("c_acctbal", NUMBER, (1, 100, 1000), 2), Attribute("c_mktsegment", STRING, (0, 4, 6))]
LINEITEM = [Attribute("l_discount", NUMBER, (0, 0.01, 0.03), 2), Attribute("l_tax", NUMBER, (0, 0.02), 2), Attribute("l_returnflag", STRING, (0,)), Attribute("l_linestatus", STRING, (0,))]
PART = [Attribute("p_brand", STRING, (0, 1)), Attribute("p_type", STRING, (0, 4, 6)), Attribute("p_size", NUMBER, (0, 2, 5))]
SUPPLIER = [Attribute("s_nationkey", NUMBER, (0, 2)), Attribute("s_acctbal", NUMBER, (100, 1000), 2)]
ERROR = 0.1


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL texts


def _value(a: Attribute) -> str:
    return f"coalesce({a.name}, 0)" if a.kind == NUMBER else f"coalesce({a.name}, '')"


def _level(a: Attribute) -> str:
    dist = f"round(abs(CAST(a.{a.name} AS DOUBLE) - CAST(b.{a.name} AS DOUBLE)), {a.digits})" if a.kind == NUMBER else f"levenshtein(a.{a.name}, b.{a.name})"
    return " + ".join(f"CAST({dist} <= {t:g} AS INTEGER)" for t in a.thresholds)


def _evidence(name: str, attributes: Sequence[Attribute]) -> str:
    """CTEs t and ev: tuples with multiplicity, and the evidence set."""
    cols, vals = ", ".join(a.name for a in attributes), ", ".join(f"{_value(a)} AS {a.name}" for a in attributes)
    lv = ", ".join(f"{_level(a)} AS lv_{a.name}" for a in attributes)
    lvs = ", ".join(f"lv_{a.name}" for a in attributes)
    own = ", ".join(f"{a.levels} AS lv_{a.name}" for a in attributes)
    return f"""t AS (SELECT row_number() OVER () AS id, * FROM (SELECT {cols}, count(*) AS m FROM (SELECT {vals} FROM {name}) GROUP BY {cols})),
ev AS (SELECT {lvs}, CAST(sum(cnt) AS BIGINT) AS cnt FROM (
  SELECT {lv}, a.m * b.m AS cnt FROM t a JOIN t b ON a.id < b.id
  UNION ALL SELECT {own}, m * (m - 1) // 2 FROM t WHERE m > 1) GROUP BY {lvs})"""


def _rules(attributes: Sequence[Attribute], error: float, rhs: Sequence[str]) -> str:
    """CTEs ok (all valid) and best (the minimal ones), over ev."""
    xs = [f"x_{a.name}" for a in attributes]
    parts = []
    for b in (a for a in attributes if a.name in rhs):
        froms = ", ".join(f"range({1 if a is b else a.levels + 1}) g{i}(x_{a.name})" for i, a in enumerate(attributes))
        on = " AND ".join(f"lv_{a.name} >= x_{a.name}" for a in attributes if a is not b) or "true"
        parts.append(
            f"SELECT '{b.name}' AS rhs, {', '.join(xs)}, r, coalesce(sum(cnt) FILTER (lv_{b.name} < r), 0) AS violations, coalesce(sum(cnt), 0) AS support"
            f" FROM (SELECT * FROM {froms}, range(1, {b.levels + 1}) gr(r)) c LEFT JOIN ev ON {on} GROUP BY {', '.join(xs)}, r"
        )
    same = " AND ".join(f"p.{x} <= o.{x}" for x in xs)
    differ = " OR ".join(f"p.{x} <> o.{x}" for x in [*xs, "r"])
    return f"""tot AS (SELECT coalesce(sum(cnt), 0) AS total FROM ev),
cand AS ({' UNION ALL '.join(parts)}),
ok AS (SELECT rhs, {', '.join(f'CAST({x} AS INTEGER) AS {x}' for x in xs)}, CAST(r AS INTEGER) AS r, CAST(violations AS BIGINT) AS violations, CAST(support AS BIGINT) AS support, CAST(total AS BIGINT) AS total
  FROM cand, tot WHERE violations <= floor(total * CAST({error} AS DOUBLE))),
best AS (SELECT * FROM ok o WHERE NOT EXISTS (SELECT 1 FROM ok p WHERE p.rhs = o.rhs AND {same} AND p.r >= o.r AND ({differ})))"""


def _weight(attributes: Sequence[Attribute]) -> str:
    return "(" + " + ".join(f"CASE WHEN rhs = '{a.name}' THEN 0 ELSE x_{a.name} + 1 END" for a in attributes) + ")"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _stats_sql(name: str, columns: Sequence[tuple[str, str]]) -> str:
    parts = []
    for c, kind in columns:
        num = kind == NUMBER
        parts.append(
            f"SELECT '{c}' AS attribute, {str(num).lower()} AS is_number, count(*) AS rows, count(DISTINCT {c}) AS distinct_values,"
            + (f" CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 6) AS average, CAST(NULL AS DOUBLE) AS shortest, CAST(NULL AS DOUBLE) AS longest" if num else f" CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS average, CAST(min(length({c})) AS DOUBLE) AS shortest, CAST(max(length({c})) AS DOUBLE) AS longest")
            + f" FROM {name}"
        )
    return " UNION ALL ".join(parts)


@_query("column_stats", _stats_sql("part", [("p_brand", STRING), ("p_type", STRING), ("p_size", NUMBER), ("p_retailprice", NUMBER)]))
def column_stats(spark, d):
    return profile.statistics(_t(spark, d, "part"), ["p_brand", "p_type", "p_size", "p_retailprice"]).withColumns({"average": F.round("average", 6), "shortest": F.col("shortest").cast("double"), "longest": F.col("longest").cast("double")})


@_query("value_index", "SELECT c_mktsegment AS value, count(*) AS rows FROM customer GROUP BY 1")
def value_index(spark, d):
    return profile.value_index(_t(spark, d, "customer"), "c_mktsegment")


@_query("value_index_sharded", "SELECT c_nationkey AS value, CAST(floor(c_custkey / 500) AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS rows, min(c_custkey) AS first_row FROM customer GROUP BY 1, 2")
def value_index_sharded(spark, d):
    out = profile.value_rows(_t(spark, d, "customer"), "c_nationkey", "c_custkey", 500)
    return out.select("value", "part", F.size("rows").cast("long").alias("rows"), F.col("rows")[0].alias("first_row"))


@_query("value_lookup", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def value_lookup(spark, d):
    return profile.lookup(_t(spark, d, "supplier"), "s_nationkey", 7).select("s_suppkey", "s_name")


@_query("dictionary_codes", "SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_name AS value FROM part)")
def dictionary_codes(spark, d):
    return profile.codes(_t(spark, d, "part"), "p_name").select("value", F.col("code").cast("long").alias("code"))


@_query("decimal_digits", "SELECT 'l_discount' AS attribute, 2 AS digits UNION ALL SELECT 'l_quantity', max(CASE WHEN l_quantity = floor(l_quantity) THEN 0 ELSE length(regexp_extract(CAST(l_quantity AS VARCHAR), '[.]([0-9]+)$', 1)) END) FROM lineitem".replace("2 AS digits", "CAST(max(CASE WHEN l_discount = floor(l_discount) THEN 0 ELSE length(regexp_extract(CAST(l_discount AS VARCHAR), '[.]([0-9]+)$', 1)) END) AS INTEGER) AS digits FROM lineitem").replace("SELECT 'l_quantity', max(", "SELECT 'l_quantity', CAST(max(").replace("END) FROM lineitem", "END) AS INTEGER) FROM lineitem", 1))
def decimal_digits(spark, d):
    return profile.decimal_digits(_t(spark, d, "lineitem"), ["l_discount", "l_quantity"])


@_query("shared_share", "WITH a AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS v, count(*) AS n FROM customer GROUP BY 1) SELECT round(CAST(sum(least(a.n, coalesce(b.n, 0))) AS DOUBLE) / sum(greatest(a.n, coalesce(b.n, 0))), 9) AS shared FROM a LEFT JOIN b USING (v)")
def shared_share(spark, d):
    return profile.shared_share(_t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer"), "c_custkey").select(F.round("shared", 9).alias("shared"))


@_query("auto_thresholds", "SELECT 'p_retailprice' AS attribute, CAST(i AS INTEGER) AS step, round((max(p_retailprice) - min(p_retailprice)) * 0.5 * i / 3, 6) AS threshold FROM part, range(1, 4) r(i) GROUP BY i UNION ALL SELECT 'p_type', CAST(i AS INTEGER), CAST(CASE WHEN reach <= 3 THEN i ELSE reach - (3 - i) * (reach // 3) END AS DOUBLE) FROM (SELECT CAST(floor(max(length(p_type)) * 0.5) AS INTEGER) AS reach FROM part), range(1, 4) r(i) WHERE i <= reach")
def auto_thresholds(spark, d):
    stats = profile.statistics(_t(spark, d, "part"), ["p_retailprice", "p_type"])
    rows = []
    for r in stats.collect():  # a row for each column
        grid = number_grid(r["low"], r["high"]) if r["is_number"] else string_grid(r["longest"])
        rows += [F.struct(F.lit(r["attribute"]).alias("attribute"), F.lit(i + 1).alias("step"), F.round(F.lit(float(t)), 6).alias("threshold")) for i, t in enumerate(grid)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@_query("levels_number", f"WITH v AS (SELECT DISTINCT s_acctbal FROM supplier) SELECT a.s_acctbal AS a, b.s_acctbal AS b, round(b.s_acctbal - a.s_acctbal, 2) AS distance, CAST({_level(SUPPLIER[1])} AS INTEGER) AS level FROM v a JOIN v b ON a.s_acctbal < b.s_acctbal AND round(b.s_acctbal - a.s_acctbal, 2) <= 1000")
def levels_number(spark, d):
    return ev.value_pairs(_t(spark, d, "supplier"), SUPPLIER[1]).withColumn("level", F.col("level").cast("int"))


@_query("value_pair_levels", f"WITH v AS (SELECT DISTINCT p_type FROM part) SELECT a.p_type AS a, b.p_type AS b, CAST(levenshtein(a.p_type, b.p_type) AS INTEGER) AS distance, CAST({_level(PART[1])} AS INTEGER) AS level FROM v a JOIN v b ON a.p_type < b.p_type AND levenshtein(a.p_type, b.p_type) <= 6")
def value_pair_levels(spark, d):
    return ev.value_pairs(_t(spark, d, "part"), PART[1]).withColumn("level", F.col("level").cast("int"))


_TOKENS = "list_distinct(string_split({}.p_name, ' '))"
_COMMON = f"len(list_intersect({_TOKENS.format('a')}, {_TOKENS.format('b')}))"
_NEEDED = f"CAST(ceil(round((len({_TOKENS.format('a')}) + len({_TOKENS.format('b')})) * (0.5 / 1.5), 9)) AS INTEGER)"
_SHARE = "CAST(floor(round(greatest(length(a.p_name), length(b.p_name)) * 0.25, 9)) AS INTEGER)"


@_query(
    "edit_policies",
    f"WITH v AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance, {_SHARE} AS edits, {_NEEDED} AS tokens,"
    f" levenshtein(a.p_name, b.p_name) <= 3 AS absolute, levenshtein(a.p_name, b.p_name) <= {_SHARE} AS normalised, levenshtein(a.p_name, b.p_name) <= greatest({_SHARE}, 1) AS hybrid, {_COMMON} >= {_NEEDED} AS token"
    " FROM v a JOIN v b ON a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 8",
)
def edit_policies(spark, d):
    a, b = F.col("a"), F.col("b")
    limits = {"absolute": 3, "normalised": 0.75, "hybrid": 0.75, "token": 0.5}
    found = simjoin.similar_pairs(_t(spark, d, "part"), "p_name", 8)
    return found.select("a", "b", "distance", edits_allowed(a, b, "normalised", 0.75).alias("edits"), tokens_needed(a, b, 0.5).alias("tokens"), *[similar(a, b, p, t).alias(p) for p, t in limits.items()])


@_query("band_pairs", "WITH v AS (SELECT DISTINCT s_acctbal AS v FROM supplier) SELECT a.v AS a, b.v AS b, round(b.v - a.v, 2) AS distance FROM v a JOIN v b ON a.v < b.v AND round(b.v - a.v, 2) <= 100")
def band_pairs(spark, d):
    return simjoin.band_pairs(_t(spark, d, "supplier"), "s_acctbal", 100, 2)


@_query("band_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 5")
def band_join(spark, d):
    return simjoin.band_join(_t(spark, d, "supplier"), "s_acctbal", _t(spark, d, "customer"), "c_acctbal", 5).select("s_suppkey", "c_custkey")


@_query("similar_strings", "WITH v AS (SELECT DISTINCT p_name AS v FROM part) SELECT a.v AS a, b.v AS b, CAST(levenshtein(a.v, b.v) AS INTEGER) AS distance FROM v a JOIN v b ON a.v < b.v AND levenshtein(a.v, b.v) <= 3")
def similar_strings(spark, d):
    return simjoin.similar_pairs(_t(spark, d, "part"), "p_name", 3)


@_query("similar_exists", "SELECT DISTINCT p_brand FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_size = 1 AND levenshtein(p.p_brand, q.p_brand) <= 1)")
def similar_exists(spark, d):
    p = _t(spark, d, "part")
    return simjoin.similar_exists(p, "p_brand", p.where("p_size = 1"), "p_brand", 1)


def _written(spark: SparkSession, df: DataFrame, form: str, **options) -> str:
    path = f"{shared_folder(spark)}/laxity-file-{uuid.uuid4().hex}"
    df.write.options(**options).format(form).save(path)
    return path


@_query("csv_table", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_nationkey END AS DOUBLE) AS s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 60")
def csv_table(spark, d):
    """Typed and open headers, empty values, and the first rows by a key, from a file written here. Empty values count as 0 or the empty string."""
    key, gap = F.col("s_suppkey"), lambda k, c: F.when(F.col("s_suppkey") % k != 0, F.col(c))
    rows = _t(spark, d, "supplier").select(key.alias("s_suppkey(Integer)"), gap(3, "s_name").alias("s_name(String)"), gap(5, "s_acctbal").alias("s_acctbal(Double)"), gap(7, "s_nationkey").alias("s_nationkey"))
    found = read_csv(spark, _written(spark, rows, "csv", header=True), 60, "s_suppkey")
    kinds = {"s_name": STRING, "s_acctbal": NUMBER, "s_nationkey": NUMBER}
    return found.select("s_suppkey", *[clean(F.col(c), Attribute(c, k, (0,))).alias(c) for c, k in kinds.items()])


@_query("threshold_file", "SELECT attribute, level, CAST(threshold AS DOUBLE) AS threshold, levels FROM (VALUES ('s_suppkey', 1, 5.0, 3), ('s_suppkey', 2, 1.0, 3), ('s_suppkey', 3, 0.0, 3), ('s_acctbal', 1, 1000.0, 2), ('s_acctbal', 2, 0.5, 2)) t(attribute, level, threshold, levels)")
def threshold_file(spark, d):
    """Attributes from a threshold file of one line for each column; empty lines leave columns out, thresholds are sorted and distinct."""
    lines = spark.range(1).select(F.lit("5,0,1,1\n\n\n1000, 0.5\n").alias("value"))
    found = usable(read_thresholds(spark, _written(spark, lines, "text"), _t(spark, d, "supplier"), {"s_acctbal": 2}))
    rows = [F.struct(F.lit(a.name).alias("attribute"), F.lit(lv).alias("level"), F.lit(float(a.threshold(lv))).alias("threshold"), F.lit(a.levels).alias("levels")) for a in found for lv in range(1, a.levels + 1)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def _as_ints(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("int").alias(c) if c.startswith("lv_") else F.col(c) for c in df.columns])


def _evidence_query(name: str, table: str, attributes: Sequence[Attribute], fn):
    QUERIES[name] = lambda spark, d: _as_ints(fn(_t(spark, d, table)))
    SQL[name] = f"WITH {_evidence(table, attributes)} SELECT {', '.join(f'CAST(lv_{a.name} AS INTEGER) AS lv_{a.name}' for a in attributes)}, cnt FROM ev"


_evidence_query("evidence_customer", "customer", CUSTOMER, lambda df: ev.evidence(df, CUSTOMER))
_evidence_query("evidence_lineitem", "lineitem", LINEITEM, lambda df: ev.evidence(df, LINEITEM))
_evidence_query("evidence_part", "part", PART, lambda df: ev.evidence(df, PART))
_evidence_query("evidence_by_row", "supplier", SUPPLIER, lambda df: ev.evidence_by_row(df, SUPPLIER, "s_suppkey"))
_evidence_query("evidence_blocked", "customer", CUSTOMER[:2], lambda df: ev.evidence_blocked(df, CUSTOMER[:2], "c_custkey", 500))


def _customer(spark, d):
    return materialised(ev.evidence(_t(spark, d, "customer"), CUSTOMER))


_CUSTOMER = f"WITH {_evidence('customer', CUSTOMER)}"


@_query("evidence_by_rhs_level", f"{_CUSTOMER} SELECT CAST(lv_c_mktsegment AS INTEGER) AS level, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS vectors FROM ev WHERE lv_c_mktsegment < 3 GROUP BY 1")
def evidence_by_rhs_level(spark, d):
    found = validate.by_level(_customer(spark, d), CUSTOMER[2])
    return found.groupBy(F.col("lv_c_mktsegment").cast("int").alias("level")).agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("vectors"))


@_query("cover_targets", f"{_CUSTOMER}, s AS (SELECT sum(cnt) AS total FROM ev) SELECT CAST(l AS INTEGER) AS level, CAST(coalesce(sum(cnt) FILTER (lv_c_mktsegment < l), 0) AS BIGINT) AS open_pairs, CAST(greatest(0, coalesce(sum(cnt) FILTER (lv_c_mktsegment < l), 0) - floor(any_value(total) * 0.1)) AS BIGINT) AS target FROM ev, s, range(1, 4) r(l) GROUP BY l")
def cover_targets(spark, d):
    return validate.cover_targets(_customer(spark, d), CUSTOMER, CUSTOMER[2], ERROR)


_MEASURE = "SELECT CAST(coalesce(sum(cnt) FILTER (lv_{0} >= {1}), 0) AS BIGINT) AS support, CAST(coalesce(sum(cnt) FILTER (lv_{0} >= {1} AND lv_{2} < {3}), 0) AS BIGINT) AS violations, CAST(sum(cnt) AS BIGINT) AS total, round(CAST(coalesce(sum(cnt) FILTER (lv_{0} >= {1} AND lv_{2} < {3}), 0) AS DOUBLE) / sum(cnt), 9) AS g1 FROM ev"


@_query("evidence_saved", f"WITH {_evidence('supplier', SUPPLIER)} SELECT {', '.join(f'CAST(lv_{a.name} AS INTEGER) AS lv_{a.name}' for a in SUPPLIER)}, cnt FROM ev")
def evidence_saved(spark, d):
    """An evidence set written as lines of levels and a count, and read again."""
    path = f"{shared_folder(spark)}/laxity-file-{uuid.uuid4().hex}"
    save(ev.evidence(_t(spark, d, "supplier"), SUPPLIER), path)
    return _as_ints(load(spark, path, SUPPLIER))


def _band(a: Attribute) -> str:
    cases = [f"WHEN lv_{a.name} = {lv} THEN '{a.name} " + (f"({a.threshold(lv + 1):g}," if lv < a.levels else "[0,") + (f"{a.threshold(lv):g}]" if lv else "inf)") + "'" for lv in range(a.levels + 1)]
    return f"CASE {' '.join(cases)} END"


@_query("evidence_readable", f"WITH {_evidence('supplier', SUPPLIER)} SELECT {" || ' ' || ".join(map(_band, SUPPLIER))} AS evidence, cnt FROM ev")
def evidence_readable(spark, d):
    return readable(ev.evidence(_t(spark, d, "supplier"), SUPPLIER), SUPPLIER)


@_query("measure_candidate", f"{_CUSTOMER} {_MEASURE.format('c_nationkey', 2, 'c_mktsegment', 3)}")
def measure_candidate(spark, d):
    return validate.measure(_customer(spark, d), {"c_nationkey": 2}, "c_mktsegment", 3).withColumn("g1", F.round("g1", 9))


@_query("measure_pairs", f"WITH {_evidence('supplier', SUPPLIER)} {_MEASURE.format('s_nationkey', 1, 's_acctbal', 2)}")
def measure_pairs(spark, d):
    return validate.measure_pairs(_t(spark, d, "supplier"), SUPPLIER, "s_suppkey", {"s_nationkey": 1}, "s_acctbal", 2).withColumn("g1", F.round("g1", 9))


def _rule_sql(table: str, attributes: Sequence[Attribute], error: float, what: str = "best") -> str:
    return f"WITH {_evidence(table, attributes)}, {_rules(attributes, error, [a.name for a in attributes])} SELECT * FROM {what}"


@_query("valid_candidates", _rule_sql("customer", CUSTOMER, ERROR, "ok"))
def valid_candidates(spark, d):
    return dis.valid(_customer(spark, d), CUSTOMER, ERROR)


def _minimal(name: str, table: str, attributes: Sequence[Attribute], error: float, method: str):
    def run(spark, d):
        return dis.discover(materialised(ev.evidence(_t(spark, d, table), attributes)), attributes, error, method).drop("g1")

    QUERIES[name], SQL[name] = run, _rule_sql(table, attributes, error)


_minimal("rules_customer_grid", "customer", CUSTOMER, ERROR, "grid")
_minimal("rules_customer_lattice", "customer", CUSTOMER, ERROR, "lattice")
_minimal("rules_customer_separate", "customer", CUSTOMER, ERROR, "separate")
_minimal("rules_customer_exact", "customer", CUSTOMER, 0.0, "grid")
_minimal("rules_part", "part", PART, 0.05, "separate")
_minimal("rules_lineitem", "lineitem", LINEITEM, 0.2, "grid")


#: Twelve attributes: those of supplier and remainders of its key.
WIDE = [Attribute("s_nationkey", NUMBER, (2,)), Attribute("s_acctbal", NUMBER, (1000,), 2), Attribute("s_name", STRING, (1,)), *[Attribute(f"m{k}", NUMBER, (0,)) for k in range(2, 11)]]
_WIDE = f"w AS (SELECT s_nationkey, s_acctbal, s_name, {', '.join(f's_suppkey % {k} AS m{k}' for k in range(2, 11))} FROM supplier), {_evidence('w', WIDE)}, {_rules(WIDE, 0.2, [a.name for a in WIDE])}"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_nationkey", "s_acctbal", "s_name", *[(F.col("s_suppkey") % k).alias(f"m{k}") for k in range(2, 11)])


@_query("rules_wide", f"WITH {_WIDE} SELECT * FROM best")
def rules_wide(spark, d):
    return dis.discover(materialised(ev.evidence(_wide(spark, d), WIDE)), WIDE, 0.2, "pruned").drop("g1")


_minimal("rules_supplier_exact", "supplier", [Attribute("s_suppkey", NUMBER, (0,)), Attribute("s_name", STRING, (0,)), Attribute("s_nationkey", NUMBER, (0, 2))], 0.0, "separate")


def _mode(mode: int, **more):
    def run(spark, d):
        return rules(_t(spark, d, "supplier"), SUPPLIER, mode, ERROR, key="s_suppkey", shard=40, **more).drop("g1")

    QUERIES[f"mode_{mode}"], SQL[f"mode_{mode}"] = run, _rule_sql("supplier", SUPPLIER, ERROR)


for _m in (1, 2, 3, 4, 7, 8):
    _mode(_m)

_ORDER = ", ".join(f"x_{a.name}" for a in CUSTOMER)
_LOG = f"CASE WHEN support > 0 THEN r * ln(support) / {_weight(CUSTOMER)} ELSE 0 END"
_NORM = "r / (CASE " + " ".join(f"WHEN rhs = '{a.name}' THEN {a.levels + 2}.0" for a in CUSTOMER) + f" END) * (CAST(support AS DOUBLE) / total) / {_weight(CUSTOMER)}"
_RULES = f"{_CUSTOMER}, {_rules(CUSTOMER, ERROR, [a.name for a in CUSTOMER])}"


@_query("top_k_per_rhs", f"{_RULES}, u AS (SELECT *, {_LOG} AS u FROM best) SELECT rhs, {_ORDER}, r, round(u, 9) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY rhs ORDER BY round(u, 12) DESC, {_ORDER}, r) AS p FROM u) WHERE p <= 3")
def top_k_per_rhs(spark, d):
    return rules(_t(spark, d, "customer"), CUSTOMER, 6, ERROR, k=3).select("rhs", *[f"x_{a.name}" for a in CUSTOMER], "r", F.round("utility", 9).alias("utility"))


@_query("top_k_global", f"{_RULES}, u AS (SELECT *, {_NORM} AS u FROM best) SELECT rhs, {_ORDER}, r, round(u, 9) AS utility FROM u ORDER BY round(u, 12) DESC, rhs, {_ORDER}, r LIMIT 5")
def top_k_global(spark, d):
    return rules(_t(spark, d, "customer"), CUSTOMER, 5, ERROR, k=5).select("rhs", *[f"x_{a.name}" for a in CUSTOMER], "r", F.round("utility", 9).alias("utility"))


def _term(a: Attribute, column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {lv} THEN '[{a.name}(<={a.threshold(lv):g})]'" for lv in range(1, a.levels + 1)) + " END"


_LEFT = "concat_ws(', ', " + ", ".join(f"CASE WHEN rhs <> '{a.name}' THEN {_term(a, f'x_{a.name}')} END" for a in CUSTOMER) + ")"
_RIGHT = "concat_ws('', " + ", ".join(f"CASE WHEN rhs = '{a.name}' THEN {_term(a, 'r')} END" for a in CUSTOMER) + ")"


@_query("rules_rendered", f"{_RULES} SELECT CASE WHEN {_LEFT} <> '' THEN {_LEFT} || ' ' ELSE '' END || '--> ' || {_RIGHT} AS rule FROM best")
def rules_rendered(spark, d):
    return topk.rendered(dis.grid(_customer(spark, d), CUSTOMER, ERROR), CUSTOMER).select("rule")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimal rules of customer, with their utility and as text."""
    found = dis.discover(_customer(spark, sf_dir), CUSTOMER, ERROR, "grid")
    return topk.rendered(topk.ranked(found, CUSTOMER, "log"), CUSTOMER)


