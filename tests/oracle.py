"""Compares a query with its SQL in DuckDB over the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(pairs, names):
    return sorted(repr([r[names.index(n)] for n in sorted(names)]) for r in pairs)


def same(spark, con, query, sql, folder):
    got, want = query(spark, folder), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in got.collect()], got.columns) == rows_of(want.fetchall(), want.columns)
