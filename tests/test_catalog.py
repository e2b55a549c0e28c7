"""Every query that has an SQL form gives the rows that DuckDB gives for it; the others give a stable schema."""

import os

import duckdb
import pytest

from riskweave.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(map(tuple, got.collect()), got.columns) == ordered(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    got = QUERIES[name](spark, DATA)
    assert got.columns
    got.collect()
