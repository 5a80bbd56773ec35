"""Hybrid search by reciprocal rank fusion, and the keyword and semantic modes with filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bm25, vector

RRF_K = 60
MODES = ("semantic", "keyword", "hybrid")


def filters(file_type: str | None = None, path_prefix: str | None = None, path_equals: str | None = None, date_from: str | None = None, date_to: str | None = None, namespace: str | None = None) -> Column | None:
    """A conjunction of the given filters (dates inclusive), or None. All of them reach a Parquet scan."""
    parts = [
        file_type and (F.col("file_type") == file_type),
        path_prefix and F.col("file_path").startswith(path_prefix),
        path_equals and (F.col("file_path") == path_equals),
        date_from and (F.col("file_modified_at") >= F.lit(date_from).cast("timestamp")),
        date_to and (F.col("file_modified_at") <= F.lit(date_to).cast("timestamp")),
        namespace and (F.col("namespace") == namespace),
    ]
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out & p
    return out


def fuse(semantic: DataFrame, keyword: DataFrame, top_k: int, k: int = RRF_K) -> DataFrame:
    """rank, id, score: sum of 1 / (k + rank) over two ranked lists (rank, id)."""
    a = semantic.select("id", F.col("rank").alias("_a"))
    b = keyword.select("id", F.col("rank").alias("_b"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return bm25.ranked(a.join(b, "id", "full").select("id", (part("_a") + part("_b")).alias("score")), top_k)


def hybrid(semantic: DataFrame, keyword: DataFrame, top_k: int, compat: bool = False) -> DataFrame:
    """Fused hits of two lists of 2 * top_k. Without keyword hits the semantic list with its own scores.

    compat drops hits that only the keyword list has, after the limit, so fewer than top_k may come and ranks have gaps.
    """
    fused = fuse(semantic, keyword, top_k)
    if compat:
        fused = fused.join(semantic.select("id"), "id", "left_semi").select("rank", "id", "score")
    some = keyword.limit(1).agg(F.count("*").alias("_n"))  # one row
    left = fused.crossJoin(F.broadcast(some)).where("_n > 0").drop("_n")
    right = semantic.where(F.col("rank") <= top_k).crossJoin(F.broadcast(some)).where("_n = 0").drop("_n")
    return left.unionByName(right.select("rank", "id", "score"))


def keyword_search(index: bm25.Index, chunks: DataFrame, query: str, top_k: int = 10, where: Column | None = None, id_col: str = "id", compat: bool = False) -> DataFrame:
    """rank, id, score with the filter before ranking; compat filters after the limit, so ranks keep gaps."""
    if where is None:
        return bm25.search(index, query, top_k)
    ids = chunks.where(where).select(F.col(id_col).alias("id"))
    if compat:
        return bm25.search(index, query, top_k).join(ids, "id", "left_semi").select("rank", "id", "score")
    return bm25.search(index, query, top_k, ids)


def with_payload(hits: DataFrame, chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with the result columns of their chunks and defaults for missing ones; the score is rounded last."""
    side = chunks.withColumnRenamed(id_col, "id") if id_col != "id" else chunks
    return side.join(F.broadcast(hits), "id").select(  # hits are at most top_k rows
        "rank", F.round("score", 4).alias("score"), "id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("file_path", "file_name", "file_type", "chunk_text")],
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("extractor", F.lit("")).alias("extractor"), "page_number",
    )


def search(chunks: DataFrame, index: bm25.Index, query: str, mode: str = "hybrid", top_k: int = 10, embed: Callable[[str], Sequence[float]] = vector.hash_embed_text, where: Column | None = None, id_col: str = "id", compat: bool = False, near: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Result rows of one query. Signed terms steer the query's vector; keyword search sees the raw text, or the positive terms.

    near(vector, top_k, where) gives the semantic hits; without it, all vectors of chunks are compared.
    """
    from ..functions.query_parser import combine, parse

    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    parsed = parse(query)
    text = parsed.base_text if parsed.arithmetic else query
    if mode == "keyword":
        return with_payload(keyword_search(index, chunks, text, top_k, where, id_col, compat), chunks, id_col)
    v = combine(parsed, embed) if parsed.arithmetic else embed(query)
    nearest = near or (lambda v, k, where: vector.search(chunks, v, k, id_col, "embedding", where))
    if mode == "semantic":
        return with_payload(nearest(v, top_k, where), chunks, id_col)
    words = keyword_search(index, chunks, text, 2 * top_k, where, id_col)
    return with_payload(hybrid(nearest(v, 2 * top_k, where), words, top_k, compat), chunks, id_col)
