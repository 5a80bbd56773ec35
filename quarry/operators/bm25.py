"""BM25 (Okapi) as an inverted index of DataFrames.

The index is derived data: postings(id, term, tf), lengths(id, dl), terms(term, df, idf) and one row of corpus figures.
It is made for one search, as where a key sees a part of a namespace; segments.Kept is the form that is kept and changed.
Inverse document frequency is ln((n - df + 0.5) / (df + 0.5)); negative values become EPSILON times the mean over all
terms. A query's repeated terms count again. Only positive scores are hits; ties go to the smaller id.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query_parser import Query
from ..functions.text import TERM, terms

if TYPE_CHECKING:
    from . import segments

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, tf. Counting terms needs the term's rows of one document only, so partial counts do most of it."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.size(terms(F.col(text_col))).cast("long").alias("dl"))


def stamped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as id, text, stamp: a hash of the text, by which a kept index knows what it holds."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("stamp"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(sizes: DataFrame, dfs: DataFrame) -> DataFrame:
    """One row: n, avgdl, n_terms, avg_idf."""
    docs = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    means = dfs.crossJoin(F.broadcast(docs)).agg(F.count("*").alias("n_terms"), F.avg(raw).alias("avg_idf"))  # docs is one row
    return docs.crossJoin(F.broadcast(means))


def idf(dfs: DataFrame, corpus: DataFrame) -> DataFrame:
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    x = dfs.crossJoin(F.broadcast(corpus))  # one row
    return x.select("term", "df", F.when(raw < 0, EPSILON * F.col("avg_idf")).otherwise(raw).alias("idf"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    docs = stamped(docs, id_col, text_col)
    posts = postings(docs, "id", "text")
    sizes = docs.select("id", F.size(terms(F.col("text"))).cast("long").alias("dl"), "stamp")
    return _of(posts, sizes, document_frequencies(posts))


def _of(posts: DataFrame, sizes: DataFrame, dfs: DataFrame) -> Index:
    corpus = corpus_stats(sizes, dfs)
    return Index(posts, sizes, idf(dfs, corpus), corpus)


def query_terms(query: str | Query) -> Counter:
    import re

    text = query.base_text if isinstance(query, Query) else query
    return Counter(re.findall(r"\w+", text.lower()))


def score(index: Index | segments.Kept, query: str | Query) -> DataFrame:
    """id, score of every document with a positive score."""
    if not isinstance(index, Index):
        return index.score(query)
    wanted = query_terms(query)
    spark = index.postings.sparkSession
    q = F.broadcast(spark.createDataFrame(sorted(wanted.items()), "term string, times long"))  # a query's terms
    posts = index.postings.where(F.col("term").isin(*wanted)) if wanted else index.postings.limit(0)
    known = index.terms.where(F.col("term").isin(*wanted)) if wanted else index.terms.limit(0)
    weight = q.join(known, "term").where("idf <> 0").select("term", (F.col("times") * F.col("idf")).alias("weight"))
    x = posts.join(F.broadcast(weight), "term").join(index.lengths, "id").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    norm = F.lit(1 - B) + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    return x.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")


def search(index: Index | segments.Kept, query: str | Query, top_k: int = 10, within: DataFrame | None = None) -> DataFrame:
    """rank, id, score of the best top_k, of the ids within (column id) if given."""
    if not isinstance(index, Index):
        return index.search(query, top_k, within)
    scores = score(index, query)
    return ranked(scores if within is None else scores.join(within, "id", "left_semi"), top_k)


def by_score():
    """Best score first. Sums in another order differ in the last bits, so scores within 1e-9 tie."""
    return F.desc(F.round("score", 9))


def ranked(scores: DataFrame, top_k: int) -> DataFrame:
    """rank, id, score: the best top_k by score, then id. The limit comes before the ranking, so one task ranks top_k rows."""
    best = scores.orderBy(by_score(), "id").limit(top_k)
    return best.select(F.row_number().over(Window.orderBy(by_score(), "id")).alias("rank"), "id", "score")


def search_many(index: Index, queries: DataFrame, query_id: str = "item_id", text_col: str = "text", top_k: int = 10) -> DataFrame:
    """query_id, rank, id, score for every query of a table in one job: an equi-join on terms, then the best of each query."""
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weight = q.join(index.terms, "term").where("idf <> 0").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    x = index.postings.join(weight, "term").join(index.lengths, "id").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    norm = F.lit(1 - B) + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    scores = x.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    best = Window.partitionBy("query_id").orderBy(by_score(), "id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def update_frequencies(dfs: DataFrame, old_posts: DataFrame, new_posts: DataFrame) -> DataFrame:
    """Document frequencies after old postings leave and new ones come: a signed sum over what changed only."""
    change = new_posts.select("term", F.lit(1).alias("d")).unionByName(old_posts.select("term", F.lit(-1).alias("d")))
    delta = change.groupBy("term").agg(F.sum("d").alias("d"))
    x = dfs.join(delta, "term", "full").select("term", (F.coalesce("df", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("long").alias("df"))
    return x.where("df > 0")


__all__ = ["TERM", "Index", "build", "search", "search_many"]
