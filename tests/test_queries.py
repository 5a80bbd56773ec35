"""Every query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans.queries import QUERIES, SQL


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda x: str(round(x, 5) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
