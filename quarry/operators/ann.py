"""Approximate vector search: an inverted file of cells with product-quantised codes, kept as tables.

A build fits cell centres and code books on a bounded sample and then indexes every row: its cell is that of the nearest
centre, its code names, for each of `parts` slices of the vector, the nearest of 256 code words of the residual. Rows are
laid out by cell in Parquet, so a search that probes a few cells reads the row groups of these cells only, and of them
first the codes alone; the best candidates by code are then ranked by the exact cosine of their vectors.

How many cells a search probes is measured when the index is built: sample queries are answered exactly over all rows,
and `probe` is the number of cells, by falling similarity, that hold the wanted share of the true neighbours.

Added vectors go to a new segment under the same centres, deletions are tombstones that hold for the segments before
them; neither touches what is written. Filters are applied in the cells, and a search that finds too few rows for its
filter widens to all cells, where it is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bm25, vector

#: Rows that centres and code books are fitted on, and queries that the probe count is measured with, at most.
SAMPLE, SAMPLE_QUERIES = 65_536, 256
#: Cells of an index, at most: the centres are broadcast.
MOST_CELLS = 65_536
#: Code words of a slice.
WORDS = 256
#: Exact cosines for each wanted hit.
RERANK = 16
#: Rows of a block in which a batch of queries meets a cell.
BLOCK = 4_096


@dataclass
class Figures:
    """What a build found: dimensions, slices of the code, cells, cells that a search probes, and the next segment."""

    dims: int
    parts: int
    cells: int
    probe: int
    segment: int = 1


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def _stack(column: pa.Array) -> np.ndarray:
    return _unit(np.stack(column.to_numpy(zero_copy_only=False)))


def _lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of a small array: Lloyd's rounds from rows at even steps of a fixed shuffle."""
    rng = np.random.default_rng(17)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _slices(dims: int, parts: int) -> list[slice]:
    ends = [dims * (i + 1) // parts for i in range(parts)]
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


class Cells:
    """An index under one path of a store that Spark reads and writes; see build() and open()."""

    def __init__(self, spark: SparkSession, path: str, figures: Figures) -> None:
        self.spark, self.path, self.figures = spark, path.rstrip("/"), figures

    # ---- building ----

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", attributes: Sequence[str] = (), cells: int | None = None, parts: int | None = None, recall: float = 0.99, top_k: int = 10) -> Cells:
        """Index every row of vectors that has a vector; attributes are the columns that searches may filter on.

        cells is the square root of the number of rows, and parts an eighth of the dimensions, unless given. recall is
        the share of the sample queries' true neighbours that the probed cells must hold.
        """
        spark = vectors.sparkSession
        rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vector"), *attributes)
        n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        dims = int(dims or 1)
        # a row's place in the sample hangs on its id, so runs agree; rows beyond SAMPLE are left to the index
        few = rows.where(F.xxhash64("id") % F.lit(max(1, n // SAMPLE)) == 0).select("id", "vector").limit(SAMPLE)
        sample = _unit(np.stack([np.asarray(v) for v in few.toPandas()["vector"]])) if n else np.zeros((1, dims))
        wanted = min(cells or max(1, round(n**0.5)), MOST_CELLS, len(sample))
        figures = Figures(dims, min(parts or max(1, dims // 8), dims), wanted, wanted)
        out = cls(spark, path, figures)
        out._fit(sample)
        out._write(rows, 0)
        figures.probe = out._measure(few, id_col, recall, top_k) if n else 1
        out._save()
        return out

    def _fit(self, sample: np.ndarray) -> None:
        """Cell centres by MLlib's k-means over the sample, code books of the residuals by a task for each slice; written as tables."""
        rows = self.spark.createDataFrame([(v,) for v in sample.tolist()], "v array<double>")
        model = KMeans(k=self.figures.cells, seed=17, maxIter=10, featuresCol="f").fit(rows.select(array_to_vector("v").alias("f"))) if self.figures.cells > 1 else None
        centres = np.array(model.clusterCenters()) if model else sample.mean(0, keepdims=True)
        self.figures.cells = len(centres)
        residual = sample - centres[(sample @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)]
        cut = _slices(self.figures.dims, self.figures.parts)
        pieces = self.spark.createDataFrame([(i, np.ascontiguousarray(residual[:, s], np.float64).tobytes(), s.stop - s.start) for i, s in enumerate(cut)], "part int, rows binary, width int")

        def book(group: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(group["rows"][0]).reshape(-1, group["width"][0])
            return pd.DataFrame([{"part": group["part"][0], "words": _lloyd(x, min(WORDS, len(x))).tobytes()}])

        self.spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>").write.mode("overwrite").parquet(f"{self.path}/centres")
        pieces.groupBy("part").applyInPandas(book, "part int, words binary").write.mode("overwrite").parquet(f"{self.path}/books")

    def _model(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Centres and code books; their size does not grow with the rows."""
        if not hasattr(self, "_kept"):
            centres = np.stack([np.asarray(r.centre) for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()])
            cut = _slices(self.figures.dims, self.figures.parts)
            books = [np.frombuffer(r.words).reshape(-1, s.stop - s.start) for r, s in zip(self.spark.read.parquet(f"{self.path}/books").orderBy("part").collect(), cut, strict=True)]
            self._kept = centres, books
        return self._kept

    def _write(self, rows: DataFrame, segment: int) -> None:
        """Every row with its cell and code, by cell: small row groups and pages, so that a cell's rows are read alone."""
        model, cut = self.spark.sparkContext.broadcast(self._model()), _slices(self.figures.dims, self.figures.parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = model.value
            bias = 0.5 * (centres**2).sum(1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _stack(batch.column(1))
                cell = (v @ centres.T - bias).argmax(1)
                rest = v - centres[cell]
                codes = [(rest[:, s] @ b.T - 0.5 * (b**2).sum(1)).argmax(1).astype(np.int16) for s, b in zip(cut, books, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), *map(pa.array, codes)], names=names)

        names = [*rows.columns, "cell", *self._codes()]
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", cell int, " + ", ".join(f"{c} smallint" for c in self._codes())
        out = rows.mapInArrow(run, schema).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        out.write.mode("overwrite").option("parquet.block.size", 1 << 20).option("parquet.page.row.count.limit", 1000).parquet(f"{self.path}/rows/segment={segment}")

    def _codes(self) -> list[str]:
        return [f"code_{i}" for i in range(self.figures.parts)]

    def _measure(self, sample: DataFrame, id_col: str, recall: float, top_k: int) -> int:
        """The number of cells, by falling similarity, that hold the share `recall` of the true neighbours of sample queries."""
        asked = sample.orderBy(F.xxhash64("id")).limit(SAMPLE_QUERIES).select(F.xxhash64("id").alias("query_id"), "vector")
        everything = self.rows().select("id", "vector", "cell", F.monotonically_increasing_id().alias("row"))
        asked = asked.persist()
        true = vector.search_many(everything, asked, top_k, "row", "vector").select("query_id", F.col("id").alias("row"))
        found = true.join(everything.select("row", "cell"), "row").select("query_id", "cell").toPandas()  # SAMPLE_QUERIES * top_k rows
        queries = {r.query_id: _unit(np.asarray(r.vector)) for r in asked.collect()}
        asked.unpersist()
        centres = self._model()[0]
        place = {q: np.argsort(np.argsort(-(centres @ v))) for q, v in queries.items()}
        ranks = sorted(int(place[q][c]) for q, c in zip(found["query_id"], found["cell"], strict=True))
        return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1

    def _save(self) -> None:
        self.spark.createDataFrame([(json.dumps(asdict(self.figures)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/figures")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Cells:
        return cls(spark, path, Figures(**json.loads(spark.read.text(f"{path}/figures").first()[0])))

    # ---- changing ----

    def add(self, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", attributes: Sequence[str] = ()) -> None:
        """Index more rows; ids that are there already are to be deleted first."""
        x = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vector"), *attributes)
        self._write(x, self.figures.segment)
        self.figures.segment += 1
        self._save()

    def delete(self, ids: DataFrame) -> None:
        """Take ids (one column) out of all segments so far; the same ids may be added again afterwards."""
        ids.select(F.col(ids.columns[0]).alias("id"), F.lit(self.figures.segment).alias("upto")).write.mode("append").parquet(f"{self.path}/gone")
        self.figures.segment += 1
        self._save()

    # ---- searching ----

    def rows(self, where: Column | None = None) -> DataFrame:
        """id, vector, attributes, cell, codes of all rows that are not deleted."""
        x = self.spark.read.parquet(f"{self.path}/rows")
        x = x if where is None else x.where(where)
        gone = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gone")
        if gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(gone):
            dead = self.spark.read.parquet(f"{self.path}/gone").groupBy("id").agg(F.max("upto").alias("upto")).select(F.col("id").alias("_gone"), "upto")
            x = x.join(dead, (F.col("id") == F.col("_gone")) & (F.col("segment") < F.col("upto")), "left_anti")
        return x

    def nearest_cells(self, query: Sequence[float], probe: int | None = None) -> list[int]:
        return np.argsort(-(self._model()[0] @ _unit(np.asarray(query))), kind="stable")[: probe or self.figures.probe].tolist()

    def candidates(self, query: Sequence[float], cells: Sequence[int], where: Column | None = None) -> DataFrame:
        """cell, id, estimate: the rows of these cells with their cosine by code. Reads ids, codes and the filter's columns only."""
        q, (centres, books) = _unit(np.asarray(query)), self._model()
        cut = _slices(self.figures.dims, self.figures.parts)
        base = F.create_map(*[F.lit(x) for c in cells for x in (int(c), float(centres[c] @ q))])[F.col("cell")]
        parts = [F.get(F.lit((b @ q[s]).tolist()), F.col(c)) for c, s, b in zip(self._codes(), cut, books, strict=True)]
        return self.rows(F.col("cell").isin(*map(int, cells)) if where is None else F.col("cell").isin(*map(int, cells)) & where).select("cell", "id", sum(parts, base).alias("estimate"))

    def search(self, query: Sequence[float], top_k: int = 10, where: Column | None = None, probe: int | None = None, rerank: int = RERANK) -> DataFrame:
        """rank, id, score by exact cosine of the best candidates of the probed cells.

        Cells that hold fewer than top_k rows for the filter are not the answer: then all cells are ranked exactly.
        """
        if len(query) != self.figures.dims:
            return vector.search(self.rows(where), query, top_k, "id", "vector")  # an index of no vectors
        cells = self.nearest_cells(query, probe)
        best = self.candidates(query, cells, where).orderBy(F.desc("estimate"), "id").limit(top_k * rerank).collect()  # top_k * rerank rows
        if len(best) < top_k:
            return vector.search(self.rows(where), query, top_k, "id", "vector")
        x = self.rows(F.col("cell").isin(*sorted({int(r.cell) for r in best})) & F.col("id").isin(*[r.id for r in best]))
        return vector.search(x, query, top_k, "id", "vector")

    def search_many(self, queries: DataFrame, top_k: int = 10, where: Column | None = None, probe: int | None = None) -> DataFrame:
        """query_id, rank, id, score for queries (query_id, vector): blocks of a cell meet the queries that probe it, by an equi-join.

        Scores are exact cosines over the probed cells. Ids must be whole numbers.
        """
        model, n_probe = self.spark.sparkContext.broadcast(self._model()[0]), min(probe or self.figures.probe, self.figures.cells)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = np.argsort(-(_stack(batch.column(1)) @ model.value.T), axis=1, kind="stable")[:, :n_probe].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["query_id", "vector", "cells"])

        asked = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long"), F.col("vector").cast("array<float>"))
        routed = asked.mapInArrow(route, "query_id long, vector array<float>, cells array<int>").select("query_id", "vector", F.explode("cells").alias("cell"))
        rows = self.rows(where).select("cell", F.col("id").cast("long").alias("id"), "vector")
        blocks, groups = _blocks(rows, "id"), _blocks(routed, "query_id")
        met = blocks.join(groups.select("cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "cell")
        width = self.figures.dims

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, ids, vectors, q_ids, q_vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    keys, names = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                    s = np.frombuffer(q_vectors).reshape(-1, width) @ np.frombuffer(vectors).reshape(-1, width).T
                    k = min(top_k, len(keys))
                    cut = np.partition(s, len(keys) - k, axis=1)[:, len(keys) - k]
                    r, c = np.nonzero(s >= cut[:, None] - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(keys[c]), pa.array(s[r, c])], names=["query_id", "id", "score"])

        out = met.mapInArrow(best, "query_id long, id long, score double")
        order = Window.partitionBy("query_id").orderBy(bm25.by_score(), "id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def _blocks(rows: DataFrame, id_col: str) -> DataFrame:
    """cell, ids, vectors: rows (cell, id, vector) packed by cell, at most BLOCK to a block; a large cell is dealt to many tasks first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            v, order = _stack(batch.column(2)), np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            out = [(int(cell[x[0]]), ids[x].tobytes(), v[x].tobytes()) for g in np.split(order, starts[1:]) for x in np.split(g, range(BLOCK, len(g), BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["cell", "ids", "vectors"])

    packed = rows.select("cell", id_col, "vector").repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(4)))
    return packed.mapInArrow(pack, "cell int, ids binary, vectors binary")
