import pytest

import __spark_entry__ as entry
from laxity import queries

from .oracle import database, same

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    same(spark, con, queries.QUERIES[name], queries.SQL[name], SMALL)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all("-->" in r["rule"] for r in rows)


def test_every_query_of_the_core_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)
