"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from findingflow.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def spelled(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    relation = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    at = [relation.columns.index(c) for c in columns]
    mine = sorted(tuple(spelled(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(spelled(r[i]) for i in at) for r in relation.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
