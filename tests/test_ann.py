"""Approximate vector search against exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.api import Engine
from quarry.operators import ann, vector


def found(hits):
    return [r.id for r in hits.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 32)) * 4
    rows = [(i, (centres[i % 24] + rng.normal(size=32)).astype(np.float32).tolist(), i % 5) for i in range(6000)]
    return spark.createDataFrame([*rows, (9000, None, 1), (9001, [0.0] * 32, 1)], "vec_id long, embedding array<float>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def cells(clustered, tmp_path_factory):
    return ann.Cells.build(clustered, str(tmp_path_factory.mktemp("ann") / "index"), attributes=["label"])


def test_every_row_is_indexed(clustered, cells, spark):
    assert cells.rows().count() == 6001 and cells.figures.cells == 77 and cells.figures.parts == 4
    assert cells.figures.probe < cells.figures.cells / 4
    again = ann.Cells.open(spark, cells.path)
    assert again.figures == cells.figures


def test_recall_of_a_batch(clustered, cells):
    asked = clustered.where("vec_id % 100 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near, exact = ({(r.query_id, r.id): (r.rank, r.score) for r in x.collect()} for x in (cells.search_many(asked), vector.search_many(clustered, asked)))
    assert len(near) == len(exact) and len(near.keys() & exact.keys()) >= 0.95 * len(exact)
    assert all(near[k][1] == pytest.approx(exact[k][1]) for k in near.keys() & exact.keys())
    everywhere = {(r.query_id, r.id): r.rank for r in cells.search_many(asked, probe=cells.figures.cells).collect()}
    assert everywhere == {k: rank for k, (rank, _) in exact.items()}


def test_recall_over_the_benchmark(spark, tmp_path):
    """All benchmark texts as queries against all documents."""
    sf = "/root/testdata/sf0.01"
    docs, asked = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    vectors = vector.hash_embed(docs).cache()
    index = ann.Cells.build(vectors, str(tmp_path / "index"), "id")
    queries = vector.hash_embed(asked, "item_id").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")).cache()
    near, exact = ({(r.query_id, r.id) for r in x.collect()} for x in (index.search_many(queries), vector.search_many(vectors, queries, 10, "id")))
    assert len(near & exact) >= 0.9 * len(exact) == 0.9 * 10 * queries.count()


def test_single_search_reads_probed_cells(clustered, cells):
    """Codes first, vectors of the candidates only; the cells' condition reaches the scan and prunes row groups."""
    hits = 0
    for i in range(0, 3000, 300):
        q = vector.stored(clustered, i)
        hits += len(set(found(cells.search(q))) & set(found(vector.search(clustered, q))))
    assert hits >= 90
    probed = cells.nearest_cells(q)
    codes = cells.candidates(q, probed)
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(cell", plan) and "vector" not in re.search(r"ReadSchema: (.*)", plan)[1]
    assert set(r.cell for r in codes.select("cell").distinct().collect()) <= set(probed)
    assert codes.count() < 6001 / 2


def test_filters_and_too_few_rows(clustered, cells):
    q = vector.stored(clustered, 7)
    got = cells.search(q, where=F.col("label") == 3)
    assert all(i % 5 == 3 for i in found(got)) and len(set(found(got)) & set(found(vector.search(clustered, q, where=F.col("label") == 3)))) >= 9
    rare = F.col("id").isin(*range(0, 6000, 1000))
    assert found(cells.search(q, where=rare)) == found(vector.search(clustered, q, where=F.col("vec_id").isin(*range(0, 6000, 1000))))
    assert found(cells.search(q, where=F.col("label") == 77)) == []


def test_add_and_delete(spark, clustered, tmp_path):
    index = ann.Cells.build(clustered.where("vec_id < 3000"), str(tmp_path / "index"), attributes=["label"])
    files = lambda: {f.rpartition("/")[2] for f in spark.read.parquet(f"{index.path}/rows").inputFiles()}
    before, q = files(), vector.stored(clustered, 3001)
    index.add(clustered.where("vec_id BETWEEN 3000 AND 3100"), attributes=["label"])
    assert before < files() and found(index.search(q))[0] == 3001
    index.delete(spark.createDataFrame([(3001,), (5,)], "id long"))
    index = ann.Cells.open(spark, index.path)
    assert 3001 not in found(index.search(q)) and index.rows().count() == 3000 + 101 - 2
    index.add(clustered.where("vec_id = 3001"), attributes=["label"])
    assert found(index.search(q))[0] == 3001 and index.rows().count() == 3000 + 101 - 1
    index.delete(spark.createDataFrame([(3001,)], "id long"))
    assert index.rows().count() == 3000 + 101 - 2


def test_empty_and_tiny_tables(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    index = ann.Cells.build(none, str(tmp_path / "none"))
    assert found(index.search([1.0])) == [] and index.search_many(none.selectExpr("vec_id AS query_id", "embedding AS vector")).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(ann.Cells.build(two, str(tmp_path / "two")).search([1.0, 0.1])) == [1, 2]


def test_engine_keeps_its_cells_in_step(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(30):
        (folder / f"n{i}.txt").write_text(f"note {i} about topic{i % 7} and word{i} " * 8)
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.index(str(folder))
    same = lambda q: [r.file_name for r in engine.search(q, "semantic", approximate=True, top_k=5).orderBy("rank").collect()] == [r.file_name for r in engine.search(q, "semantic", top_k=5).orderBy("rank").collect()]
    assert same("word3 topic3 note")
    first = engine.vector_index().path
    (folder / "n3.txt").write_text("quite another text now " * 8)
    engine.index(str(folder))
    engine.delete(f"{folder}/n4.txt")
    assert same("quite another text") and same("word4 topic4") and engine.vector_index().path == first
    assert engine.vector_index().rows().count() == engine.chunks().count() == 29
    for i in range(100, 150):
        (folder / f"n{i}.txt").write_text(f"late {i} and later {i} " * 8)
    engine.index(str(folder))
    assert same("late 120") and engine.vector_index().path != first
