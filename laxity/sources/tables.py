"""Tables from CSV files with typed headers, and threshold files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import NUMBER, STRING, Attribute, from_lines

#: A header may carry its type in brackets.
TYPED = re.compile(r"^(.*?)\((.*)\)\s*$")
NUMERIC = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def read_csv(spark: SparkSession, path: str, rows: int | None = None, key: str | None = None) -> DataFrame:
    """A table whose header may say Integer, Double or String; other columns are numbers if every value is one.

    rows limits the table to its first rows by `key`, which has to be given with it. Broken files fail, and so do values that
    are not of the type that their column's header says; empty values are null.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    kinds = {c: next((k for k in ("Integer", "Double", "String") if k in c), None) for c in raw.columns}
    open_columns = [c for c, k in kinds.items() if k is None]
    if open_columns:
        checks = raw.agg(*[F.min(F.coalesce(F.col(f"`{c}`").rlike(NUMERIC) | (F.col(f"`{c}`") == ""), F.lit(True)).cast("int")).alias(f"n{i}") for i, c in enumerate(open_columns)], *[F.max(F.col(f"`{c}`").rlike("[.eE]").cast("int")).alias(f"d{i}") for i, c in enumerate(open_columns)]).first()
        for i, c in enumerate(open_columns):
            kinds[c] = "String" if checks[f"n{i}"] == 0 else "Double" if checks[f"d{i}"] else "Integer"
    to = {"Integer": "bigint", "Double": "double", "String": "string"}
    cols = [(F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != ""), F.coalesce(F.col(f"`{c}`").try_cast(to[k]), F.raise_error(F.concat(F.lit(f"{c}: not {k}: "), F.col(f"`{c}`"))).cast(to[k]))) if k != "String" else F.col(f"`{c}`")).alias(m[1].strip() if (m := TYPED.match(c)) else c) for c, k in kinds.items()]
    out = raw.select(*cols)
    if rows is not None and rows > 0:
        if key is None:
            raise ValueError("a row limit needs a key to order by")
        out = out.orderBy(key).limit(rows)
    return out


def kind_of(df: DataFrame, name: str) -> str:
    return STRING if dict(df.dtypes)[name] == "string" else NUMBER


def read_thresholds(spark: SparkSession, path: str, df: DataFrame, digits: dict[str, int]) -> list[Attribute]:
    """Attributes of df from a threshold file of one line for each column."""
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()]  # one line a column
    return from_lines("".join(lines).splitlines(), [(c, kind_of(df, c), digits.get(c, 0)) for c in df.columns])
