"""Every registered query of the subpackage by name: against its SQL where there is one, and on a table without rows."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import registry


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda x: str(round(x, 5) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = registry.QUERIES[name](spark, sf), con.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), want.columns)


@pytest.fixture(scope="module")
def bare(spark, sf, tmp_path_factory):
    """Empty tables with two columns more, whose names the operators use."""
    folder = tmp_path_factory.mktemp("bare")
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).selectExpr("*", "1 as _key", "'x' as size").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [*sorted(registry.QUERIES), "pipeline"])
def test_empty_tables(spark, bare, name):
    run = corpus_pipeline.run if name == "pipeline" else registry.QUERIES[name]
    assert run(spark, bare).count() == 0
