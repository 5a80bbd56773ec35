"""Vector operators: cosine search over array<float> columns, exact, and the hashing embedder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from . import bm25


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; 0 where one is zero."""
    a, b = _doubles(a), _doubles(b)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def search(vectors: DataFrame, query: Sequence[float], top_k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """rank, id, score of the nearest top_k; `where` filters before ranking and reaches the scan."""
    x = vectors if where is None else vectors.where(where)
    q = F.lit([float(v) for v in query])
    return bm25.ranked(x.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score")), top_k)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """ids, vectors (packed doubles of unit length), n: blocks of at most size rows (long, array) of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([v.tobytes()]), pa.array([len(ids)], pa.int32())], names=["ids", "vectors", "n"])

    return rows.mapInArrow(run, "ids binary, vectors binary, n int")


def search_many(vectors: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024) -> DataFrame:
    """query_id, rank, id, score: the nearest top_k of every query, as matrix products of blocks in one job.

    queries: query_id, vector. Blocks of the query set meet blocks of the vectors; each product keeps the best top_k of
    its rows for each query, so little is shuffled. Null vectors are nobody's neighbours.
    """
    rows = _packed(vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col)), 4 * block)
    asked = _packed(queries.where("vector is not null").select(F.col("query_id").cast("long"), F.col("vector")), block)
    met = rows.crossJoin(asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("n").alias("q_n")))  # blocks, not rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs, n, q_ids, q_vecs, q_n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, names = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                s = np.frombuffer(q_vecs).reshape(q_n, -1) @ np.frombuffer(vecs).reshape(n, -1).T
                k = min(top_k, n)
                cut = np.partition(s, n - k, axis=1)[:, n - k]
                r, c = np.nonzero(s >= cut[:, None] - 1e-9)  # ties at the cut stay for the exact ranking
                yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(keys[c]), pa.array(s[r, c])], names=["query_id", "id", "score"])

    out = met.mapInArrow(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(bm25.by_score(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def stored(vectors: DataFrame, id_: int, id_col: str = "vec_id", vec_col: str = "embedding") -> list[float]:
    row = vectors.where(F.col(id_col) == id_).select(vec_col).first()
    if row is None:
        raise KeyError(f"no vector {id_}")
    return [float(x) for x in row[0]]


# ---- hashing embedder ----------------------------------------------------------------------------


def term_dimension(term: Column, dims: int) -> Column:
    """First four hex digits of the term's MD5, modulo the dimensions."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("long"), F.lit(dims)).cast("int")


def hash_embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: int = 64) -> DataFrame:
    """id, embedding: counts of a text's terms by hashed dimension, of unit length unless zero. Texts without terms are zero."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("_t"))
    counts = words.groupBy("id", term_dimension(F.col("_t"), dims).alias("_d")).agg(F.count("*").alias("_n"))  # dims rows a text at most
    sums = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("_d", "_n"))).alias("_m"), F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_size"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("_m", d) / F.col("_size"), F.lit(0.0)).cast("float"))
    x = docs.select(F.col(id_col).alias("id")).join(sums, "id", "left")
    return x.select("id", F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0).cast("float"), dims)).otherwise(unit).alias("embedding"))


def hash_embed_text(text: str, dims: int = 64) -> list[float]:
    """The same vector for one text, on the driver."""
    import hashlib
    import re

    v = np.zeros(dims)
    for t in re.findall(r"\w+", text.lower()):
        v[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dims] += 1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()
