"""Every retrieval operator as a query over the driver's tables, with its SQL where DuckDB can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, extract, query_parser, recursive, text
from ..operators import ann, bm25, catalog, hybrid, rag, segments, vector
from ..sources.corpus import AUDIT_SQL, CHUNKS_SQL, audit_log, chunks, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASKED = "the thing and onthe shre of"
FILE = "/corpus/3/10.txt"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text")


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
POSTINGS = f"p AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2), dl AS (SELECT doc_id AS id, CAST(len({TOKENS}) AS BIGINT) AS dl FROM documents)"
STATS = f"{POSTINGS}, df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), a AS (SELECT count(*) AS n_terms, avg(ln((n - df + 0.5) / (df + 0.5))) AS avg_idf FROM df, n), idf AS (SELECT term, df, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) < 0 THEN 0.25 * avg_idf ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, n, a)"


def scores_sql(words: str) -> str:
    """CTEs that end in s(id, score) of a query text."""
    return rf"{STATS}, q AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower('{words}'), '[\p{{L}}\p{{N}}_]+')) AS term) GROUP BY 1), s AS (SELECT id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN p USING (term) JOIN dl USING (id), n WHERE idf <> 0 GROUP BY id HAVING score > 0)"


def top(name: str, k: int) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id, score FROM {name} ORDER BY round(score, 9) DESC, id LIMIT {k}"


def rounded(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


# ---- terms and BM25 ------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_terms, CAST(len(list_distinct({TOKENS})) AS BIGINT) AS n_distinct, {TOKENS}[1] AS first_term FROM documents")
def tokenize(spark, sf):
    t = text.terms(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.try_element_at(t, F.lit(1)).alias("first_term"))


@query(f"WITH {POSTINGS} SELECT * FROM p")
def postings(spark, sf):
    return bm25.postings(docs(spark, sf))


@query(f"WITH {POSTINGS} SELECT * FROM dl")
def doc_lengths(spark, sf):
    return bm25.lengths(docs(spark, sf))


@query(f"WITH {STATS} SELECT term, df, round(idf, 6) AS idf FROM idf".replace(" p AS (", " p AS MATERIALIZED (").replace(" df AS (", " df AS MATERIALIZED (").replace(" a AS (", " a AS MATERIALIZED ("))
def term_stats(spark, sf):
    return rounded(bm25.build(docs(spark, sf)).terms, "idf")


@query(f"WITH {STATS} SELECT n, round(avgdl, 6) AS avgdl, n_terms, round(avg_idf, 6) AS avg_idf FROM n, a")
def corpus_stats(spark, sf):
    return rounded(rounded(bm25.build(docs(spark, sf)).corpus, "avgdl"), "avg_idf")


_KEPT: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, sf: str, kind: str, save: Callable[[str], object]) -> str:
    """The folder that save(folder) fills, once for a session; it is deleted when the driver ends."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _KEPT:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.gettempdir()}/quarry"
        folder = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        save(folder)
        _KEPT[key] = folder
    return _KEPT[key]


def kept_index(spark: SparkSession, sf: str) -> segments.Kept:
    """The index of the documents, made once for a session and read from then on."""
    return segments.Kept.open(spark, kept(spark, sf, "bm25", lambda folder: segments.Kept.create(docs(spark, sf), folder)))


def changed_index(spark: SparkSession, sf: str) -> segments.Kept:
    """The index of two thirds of the documents, after a commit by which one of them leaves and the last third comes."""

    def save(folder: str) -> None:
        d = docs(spark, sf)
        index = segments.Kept.create(d.where("doc_id % 3 <> 2"), folder)
        index.commit(d.where("doc_id % 3 = 2"), d.where("doc_id % 3 = 1").select("doc_id"))

    return segments.Kept.open(spark, kept(spark, sf, "bm25_changed", save))


@query(f"WITH {scores_sql(ASKED)}, t AS ({top('s', 20)}) SELECT rank, id, round(score, 6) AS score FROM t")
def bm25_kept(spark, sf):
    """As bm25_topk, on a kept index: of its terms' blocks, those that can hold one of the best are read."""
    return rounded(bm25.search(kept_index(spark, sf), ASKED, 20))


@query(f"WITH {scores_sql(ASKED)}, t AS ({top('s', 20)}) SELECT rank, id, round(score, 6) AS score FROM t")
def bm25_topk(spark, sf):
    return rounded(bm25.search(bm25.build(docs(spark, sf)), ASKED, 20))


@query(rf"WITH {STATS}, q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark) GROUP BY 1, 2), s AS (SELECT item_id AS query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN p USING (term) JOIN dl USING (id), n WHERE idf <> 0 GROUP BY 1, 2 HAVING score > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10")
def bm25_batch(spark, sf):
    return rounded(kept_index(spark, sf).search_many(read(spark, sf, "benchmark")))


@query(f"WITH {scores_sql(ASKED).replace('FROM documents', 'FROM documents WHERE doc_id % 3 <> 1')}, t AS ({top('s', 20)}) SELECT rank, id, round(score, 6) AS score FROM t")
def bm25_changed(spark, sf):
    """A search after a commit that took documents out and others in."""
    return rounded(changed_index(spark, sf).search(ASKED, 20))


@query(f"WITH {STATS.replace('FROM documents', 'FROM documents WHERE doc_id % 3 <> 1')} SELECT n, round(avgdl, 6) AS avgdl, n_terms, round(avg_idf, 6) AS avg_idf FROM n, a")
def bm25_changed_stats(spark, sf):
    """The corpus figures that commits keep as sums of changes."""
    index = changed_index(spark, sf)
    known = index.frequencies().agg(F.count("*").alias("n_terms"))
    return known.select(F.lit(index.manifest.n).cast("long").alias("n"), F.round(F.lit(index.manifest.avgdl), 6).alias("avgdl"), "n_terms", F.round(F.lit(index.mean_idf()), 6).alias("avg_idf"))


@query(f"WITH {POSTINGS.replace('FROM documents', 'FROM documents WHERE doc_id % 3 <> 1')} SELECT term, count(*) AS df FROM p GROUP BY 1")
def incremental_df(spark, sf):
    """A third of the documents is held, a third leaves, a third comes: only those that change are counted again."""
    d = docs(spark, sf)
    part = lambda r: bm25.postings(d.where(F.pmod("doc_id", F.lit(3)) == r))
    before = bm25.document_frequencies(part(0).unionByName(part(1)))
    return bm25.update_frequencies(before, part(1), part(2))


@query(f"WITH {CHUNKS_SQL}, {scores_sql(ASKED)}, f AS (SELECT s.* FROM s JOIN chunks USING (id) WHERE file_type = '.md'), t AS ({top('f', 10)}) SELECT rank, id, round(score, 6) AS score FROM t")
def keyword_search(spark, sf):
    return rounded(hybrid.keyword_search(bm25.build(docs(spark, sf)), chunks(spark, sf), ASKED, 10, hybrid.filters(file_type=".md")))


@query(f"WITH {CHUNKS_SQL}, {scores_sql(ASKED)}, t AS ({top('s', 20)}) SELECT t.rank, t.id, round(t.score, 6) AS score FROM t JOIN chunks USING (id) WHERE file_type = '.md'")
def keyword_postfilter(spark, sf):
    return rounded(hybrid.keyword_search(bm25.build(docs(spark, sf)), chunks(spark, sf), ASKED, 20, hybrid.filters(file_type=".md"), compat=True))


@query(f"WITH {CHUNKS_SQL}, {scores_sql(ASKED)}, t AS ({top('s', 10)}) SELECT t.rank, round(t.score, 4) AS score, t.id, file_path, file_name, file_type, chunk_text, chunk_index, extractor, page_number FROM t JOIN chunks USING (id)")
def hit_payload(spark, sf):
    return hybrid.with_payload(bm25.search(bm25.build(docs(spark, sf)), ASKED, 10), chunks(spark, sf))


# ---- vectors -------------------------------------------------------------------------------------

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"WITH s AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), t AS ({top('s', 10)}) SELECT rank, id, round(score, 6) AS score FROM t")
def vector_topk(spark, sf):
    e = read(spark, sf, "embeddings")
    return rounded(vector.search(e, vector.stored(e, 0)))


@query(f"WITH s AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3), t AS ({top('s', 10)}) SELECT rank, id, round(score, 6) AS score FROM t")
def vector_topk_filtered(spark, sf):
    e = read(spark, sf, "embeddings")
    return rounded(vector.search(e, vector.stored(e, 0), where=F.col("label") == 3))


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query_id, e.vec_id AS id, {COS} AS score FROM embeddings e, q), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10")
def vector_batch(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rounded(vector.search_many(e, q))


def kept_cells(spark: SparkSession, sf: str) -> ann.Cells:
    """The cells of the embeddings, built once for a session."""
    return ann.Cells.open(spark, kept(spark, sf, "ann", lambda folder: ann.Cells.build(read(spark, sf, "embeddings"), folder, attributes=["label"])))


def _every_hundredth(spark, sf):
    return read(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def vector_cells(spark, sf):
    """Every hundredth vector against all, from the cells that each probes; approximate, so there is no SQL."""
    return rounded(kept_cells(spark, sf).search_many(_every_hundredth(spark, sf)))


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query_id, e.vec_id AS id, {COS} AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, true AS found_nine_tenths FROM r WHERE rank <= 10")
def vector_cells_recall(spark, sf):
    """Whether the cells give nine tenths of the exact neighbours."""
    asked = _every_hundredth(spark, sf)
    exact = vector.search_many(read(spark, sf, "embeddings"), asked).select("query_id", "id")
    near = kept_cells(spark, sf).search_many(asked).select("query_id", "id", F.lit(1).alias("hit"))
    x = exact.join(near, ["query_id", "id"], "left")
    return x.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("found_nine_tenths"))


@query(f"WITH s AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 AND e.vec_id % 2 = 1), t AS ({top('s', 10)}) SELECT rank, id, round(score, 6) AS score FROM t")
def vector_cells_filtered(spark, sf):
    """With a filter that few rows pass, all cells are searched, so the result is exact."""
    cells = kept_cells(spark, sf)
    q = vector.stored(read(spark, sf, "embeddings"), 0)
    return rounded(cells.search(q, where=(F.col("label") == 3) & (F.col("id") % 2 == 1), probe=cells.figures.cells, rerank=1_000))


def _combined(expression: str, where: str = "true") -> str:
    """Search with a vector of stored vectors v0, v1, ... combined per dimension."""
    return f"WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id < 4), w AS (SELECT i, {expression} AS x FROM v GROUP BY i), q AS (SELECT list(x ORDER BY i) AS embedding FROM w), s AS (SELECT e.vec_id AS id, {COS} AS score FROM embeddings e, q WHERE {where}), t AS ({top('s', 10)}) SELECT rank, id, round(score, 6) AS score FROM t"


@query(_combined("sum(x * CASE vec_id WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END)"))
def query_arithmetic(spark, sf):
    e = read(spark, sf, "embeddings")
    q = query_parser.parse("0 -1 +2")
    return rounded(vector.search(e, query_parser.combine(q, lambda t: vector.stored(e, int(t)))))


@query(_combined("sum(x * CASE vec_id WHEN 0 THEN 1 WHEN 1 THEN 0.3 WHEN 2 THEN -0.3 ELSE 0 END)", "e.label <> 1"))
def vector_refine(spark, sf):
    e = read(spark, sf, "embeddings")
    v = query_parser.refine(vector.stored(e, 0), [vector.stored(e, 1)], [vector.stored(e, 2)])
    return rounded(vector.search(e, v, where=F.col("label") != 1))


EMBED = f"{POSTINGS}, g AS (SELECT id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS d, sum(tf) AS x FROM p GROUP BY 1, 2), l AS (SELECT id, sqrt(sum(x * x)) AS len FROM g GROUP BY 1)"


@query(f"WITH {EMBED} SELECT g.id, CAST(g.d AS INTEGER) AS dim, round(CAST(g.x / len AS FLOAT)::DOUBLE, 5) AS value FROM g JOIN l USING (id)")
def hash_embeddings(spark, sf):
    e = vector.hash_embed(docs(spark, sf))
    return e.select("id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0").select("id", "dim", F.round(F.col("value").cast("double"), 5).alias("value"))


def semantic_sql(words: str, k: int) -> str:
    return rf"{EMBED}, qt AS (SELECT ('0x' || substr(md5(term), 1, 4))::INT % 64 AS d, count(*) AS x FROM (SELECT unnest(regexp_extract_all(lower('{words}'), '[\p{{L}}\p{{N}}_]+')) AS term) GROUP BY 1), v AS (SELECT id, sum(g.x * qt.x) / any_value(len) / (SELECT sqrt(sum(x * x)) FROM qt) AS score FROM g JOIN qt USING (d) JOIN l USING (id) GROUP BY id), sem AS ({top('v', k)})"


def _near(spark, sf, k):
    e = vector.hash_embed(docs(spark, sf)).withColumn("embedding", F.col("embedding"))
    return vector.search(e, vector.hash_embed_text(ASKED), k, "id")


@query(f"WITH {semantic_sql(ASKED, 10)} SELECT rank, id, round(score, 4) AS score FROM sem")
def semantic_search(spark, sf):
    return _near(spark, sf, 10).withColumn("score", F.round("score", 4))


FUSED = f"{semantic_sql(ASKED, 20)}, {scores_sql(ASKED).removeprefix(POSTINGS + ', ')}, kw AS ({top('s', 20)}), u AS (SELECT coalesce(sem.id, kw.id) AS id, coalesce(1.0::DOUBLE / (60 + sem.rank), 0) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0) AS score FROM sem FULL JOIN kw ON sem.id = kw.id), t AS ({top('u', 10)})"


@query(f"WITH {FUSED} SELECT rank, id, round(score, 6) AS score FROM t")
def hybrid_rrf(spark, sf):
    return rounded(hybrid.hybrid(_near(spark, sf, 20), bm25.search(bm25.build(docs(spark, sf)), ASKED, 20), 10))


@query(f"WITH {FUSED} SELECT rank, id, round(score, 6) AS score FROM t WHERE id IN (SELECT id FROM sem)")
def hybrid_rrf_compat(spark, sf):
    return rounded(hybrid.hybrid(_near(spark, sf, 20), bm25.search(bm25.build(docs(spark, sf)), ASKED, 20), 10, compat=True))


@query(
    "WITH w AS (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS w FROM benchmark), t AS (SELECT item_id, w, item_id % 3 <> 0 AS signed FROM w), "
    "l AS (SELECT item_id, signed, CASE WHEN signed THEN [{'t': w[1], 's': 1}, {'t': w[2], 's': -1}, {'t': w[3] || ' ' || w[4], 's': -1}, {'t': 'C++', 's': 1}, {'t': w[5] || '-' || w[6], 's': 1}, {'t': w[7], 's': 1}, {'t': w[8], 's': -1}] "
    "ELSE [{'t': w[1], 's': 1}, {'t': w[2] || ' ' || w[3], 's': 1}, {'t': 'C++', 's': 1}, {'t': w[4] || '+', 's': 1}] END AS l FROM t) "
    "SELECT item_id, u.t AS term, CAST(u.s AS DOUBLE) AS sign, signed AS arithmetic FROM (SELECT item_id, signed, unnest(l) AS u FROM l)"
)
def parse_queries(spark, sf):
    """Queries made of each benchmark text's first words: with signs, quoted phrases, signs inside words and signs that stand apart."""
    w = F.split(F.trim("text"), r"\s+")
    signed = F.format_string('%s -%s -"%s %s" C++ %s-%s + %s\t-  %s ', *[w[i] for i in range(8)])
    plain = F.format_string(' %s "%s %s"  C++ %s+', *[w[i] for i in range(4)])
    q = read(spark, sf, "benchmark").select("item_id", query_parser.parse_column(F.when(F.col("item_id") % 3 != 0, signed).otherwise(plain)).alias("q"))
    return q.select("item_id", F.explode("q.terms").alias("t"), "q.arithmetic").select("item_id", F.col("t.text").alias("term"), F.col("t.sign").alias("sign"), "arithmetic")


# ---- filters -------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path, file_type FROM chunks WHERE file_type = '.py' AND namespace = 'en'")
def equality_filters(spark, sf):
    return chunks(spark, sf).where(hybrid.filters(file_type=".py", namespace="en")).select("id", "file_path", "file_type")


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path FROM chunks WHERE starts_with(file_path, '/corpus/3/')")
def path_prefix(spark, sf):
    return chunks(spark, sf).where(hybrid.filters(path_prefix="/corpus/3/")).select("id", "file_path")


@query(f"WITH {CHUNKS_SQL} SELECT id, chunk_index FROM chunks WHERE file_path = '{FILE}'")
def path_equals(spark, sf):
    return chunks(spark, sf).where(hybrid.filters(path_equals=FILE)).select("id", "chunk_index")


@query(f"WITH {CHUNKS_SQL} SELECT id, file_modified_at FROM chunks WHERE file_modified_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 05:00:00'")
def date_range_filter(spark, sf):
    return chunks(spark, sf).where(hybrid.filters(date_from="2024-01-01 01:00:00", date_to="2024-01-01 05:00:00")).select("id", F.col("file_modified_at").cast("timestamp_ntz").alias("file_modified_at"))


@query(f"WITH {CHUNKS_SQL} SELECT id, point_id FROM chunks WHERE point_id IN (SELECT point_id FROM chunks WHERE id % 50 = 0)")
def point_lookup(spark, sf):
    c = chunks(spark, sf)
    return c.join(c.where("id % 50 = 0").select("point_id"), "point_id", "left_semi").select("id", "point_id")


# ---- question answering --------------------------------------------------------------------------


def _hits(spark, sf, k=5):
    return hybrid.with_payload(bm25.search(bm25.build(docs(spark, sf)), ASKED, k), chunks(spark, sf))


HITS = f"WITH {CHUNKS_SQL}, {scores_sql(ASKED)}, t AS ({top('s', 5)}), h AS (SELECT t.rank, t.score, chunks.* FROM t JOIN chunks USING (id))"


@query(f"{HITS} SELECT string_agg('[File: ' || file_name || ']' || chr(10) || chunk_text, chr(10) || '---' || chr(10) ORDER BY rank) AS context, count(*) AS n_hits FROM h")
def rag_context(spark, sf):
    return rag.context(_hits(spark, sf))


@query(f"{HITS} SELECT string_agg('[From ' || file_name || ']:' || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_hits FROM h")
def rag_context_service(spark, sf):
    return rag.context(_hits(spark, sf), "service")


@query(f"{HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank) AS n FROM h) SELECT rank, file_path, file_name, substr(chunk_text, 1, 200) AS preview FROM r WHERE n = 1")
def rag_sources(spark, sf):
    return rag.sources(_hits(spark, sf)).select("rank", "file_path", "file_name", "preview")


# ---- scalar functions ----------------------------------------------------------------------------


@query(f"WITH {CHUNKS_SQL} SELECT id, point_id FROM chunks")
def point_ids(spark, sf):
    return chunks(spark, sf).select("id", "point_id")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def chunk_preview(spark, sf):
    return docs(spark, sf).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(the|thing)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def highlight(spark, sf):
    return docs(spark, sf).select("doc_id", text.highlight(F.col("text"), "the thing").alias("marked"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'quit|exit|stop|goodbye') THEN 'exit' WHEN regexp_matches(lower(text), 'search for|find|look for|where is') THEN 'search' ELSE 'ask' END AS intent, CASE WHEN regexp_matches(lower(text), 'search for|find|look for|where is|locate') THEN 'search' ELSE 'ask' END AS service_intent FROM conversations")
def intent_classify(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"), text.intent(F.col("text"), True).alias("service_intent"))


@query("SELECT DISTINCT lang AS namespace, CASE WHEN lang = 'en' THEN 'quarry_en' ELSE 'quarry_' || lang END AS collection FROM documents")
def collection_names(spark, sf):
    return read(spark, sf, "documents").select(F.col("lang").alias("namespace")).distinct().withColumn("collection", text.collection_name(F.col("namespace")))


@query(f"WITH {AUDIT_SQL} SELECT id, key_hash FROM log")
def key_hashes(spark, sf):
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), text.key_hash(F.col("user_id").cast("string")).alias("key_hash"))


@query("WITH d AS (SELECT doc_id, text, [0, length(text) // 2] AS o FROM documents), p AS (SELECT doc_id, o, strpos(text, left(text, 80)) - 1 AS a, substr(text, length(text) // 2 + 1, 80) AS probe, text FROM d), r AS (SELECT doc_id, o, a, CASE WHEN strpos(substr(text, a + 1), probe) > 0 THEN a + strpos(substr(text, a + 1), probe) - 1 ELSE a END AS b FROM p) SELECT doc_id, CAST(greatest(1, len(list_filter(o, lambda x: x <= a))) AS INTEGER) AS first_page, CAST(greatest(1, len(list_filter(o, lambda x: x <= b))) AS INTEGER) AS second_page FROM r")
def page_numbers(spark, sf):
    """Each text as two pages of equal length and two chunks that begin where the pages do."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    x = docs(spark, sf).select("doc_id", "text", F.array(F.lit(0), half).alias("o"), F.array(F.col("text"), F.substring(F.col("text"), half + 1, F.char_length("text"))).alias("c"))
    p = text.page_numbers(F.col("c"), F.col("text"), F.col("o"))
    return x.select("doc_id", p.alias("p")).select("doc_id", F.col("p")[0].alias("first_page"), F.col("p")[1].alias("second_page"))


@query("SELECT event_id, round(100.0 * (event_id % 100) / 100, 1) AS percent, CASE WHEN event_id % 100 > 0 THEN round(60.0 / (event_id % 100) * (100 - event_id % 100), 1) END AS eta FROM events")
def progress(spark, sf):
    done = F.pmod("event_id", F.lit(100))
    return read(spark, sf, "events").select("event_id", text.percent(done, F.lit(100)).cast("double").alias("percent"), text.eta_seconds(done, F.lit(100), F.lit(60.0)).alias("eta"))


@query("SELECT doc_id, regexp_replace(text, '([A-Za-z]+)ing', 'shown \\1 and \\1ed', 'g') AS text FROM documents")
def obsidian_text(spark, sf):
    """Notes with front matter and with links in place of words give the links' shown texts."""
    linked = F.regexp_replace("text", "([A-Za-z]+)ing", "[[$1ing|shown $1]] and [[$1ed]]")
    note = F.concat(F.lit("---\ntitle: [[x]]\ntags: a|b\n---\n"), linked)
    return docs(spark, sf).select("doc_id", text.resolve_links(text.strip_front_matter(note)).alias("text"))


# ---- catalogue -----------------------------------------------------------------------------------


@query(f"WITH {CHUNKS_SQL} SELECT file_type, count(*) AS count FROM chunks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def file_facets(spark, sf):
    return catalog.facet(chunks(spark, sf))


@query(f"WITH {CHUNKS_SQL} SELECT file_type, count(DISTINCT file_path) AS files FROM chunks GROUP BY 1")
def files_by_type(spark, sf):
    return catalog.files_by_type(chunks(spark, sf))


@query(f"WITH {CHUNKS_SQL}, ty AS (SELECT string_agg(file_type || '=' || n, ',' ORDER BY file_type) AS file_types FROM (SELECT file_type, count(*) AS n FROM chunks GROUP BY 1)) SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files, count(DISTINCT file_hash) AS total_hashes, CAST(sum(length(chunk_text)) AS BIGINT) AS total_chars, max(indexed_at) AS last_indexed_at, any_value(file_types) AS file_types FROM chunks, ty")
def stats_summary(spark, sf):
    return catalog.stats(chunks(spark, sf)).withColumn("last_indexed_at", F.col("last_indexed_at").cast("timestamp_ntz"))


@query(f"WITH {CHUNKS_SQL} SELECT file_path, count(*) AS chunk_count, arg_min(file_name, chunk_index) AS file_name, arg_min(file_type, chunk_index) AS file_type, arg_min(indexed_at, chunk_index) AS indexed_at FROM chunks GROUP BY 1")
def file_listing(spark, sf):
    return catalog.file_listing(chunks(spark, sf)).withColumn("indexed_at", F.col("indexed_at").cast("timestamp_ntz"))


@query(f"WITH {CHUNKS_SQL}, f AS (SELECT file_path, arg_min(indexed_at, chunk_index) AS indexed_at FROM chunks GROUP BY 1) SELECT * FROM f ORDER BY indexed_at DESC NULLS LAST, file_path LIMIT 8")
def recent_files(spark, sf):
    return catalog.recent_files(catalog.file_listing(chunks(spark, sf))).select("file_path", F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_index, chunk_text FROM chunks WHERE file_path = '{FILE}' ORDER BY 1")
def file_chunks(spark, sf):
    return catalog.file_chunks(chunks(spark, sf), FILE).select("chunk_index", "chunk_text")


@query(f"WITH {CHUNKS_SQL} SELECT DISTINCT file_hash FROM chunks")
def distinct_hashes(spark, sf):
    return chunks(spark, sf).select("file_hash").distinct()


@query("SELECT namespace FROM (SELECT DISTINCT lang AS namespace FROM documents UNION SELECT 'default') ORDER BY 1")
def namespaces(spark, sf):
    return catalog.namespaces(chunks(spark, sf))


@query(f"WITH {CHUNKS_SQL} SELECT namespace, count(*) AS points, count(DISTINCT file_path) AS files, count(page_number) AS with_page FROM chunks GROUP BY 1")
def collection_info(spark, sf):
    return catalog.collection_info(chunks(spark, sf))


def _files(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.concat(F.lit("/corpus/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


FILES = "files AS (SELECT '/corpus/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents)"


@query(f"WITH {FILES} SELECT path, size, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS n FROM files) WHERE n = 1")
def content_dedup(spark, sf):
    return catalog.first_of_hash(_files(spark, sf))


@query(f"WITH {CHUNKS_SQL}, {FILES} SELECT path, size, sha256 FROM files WHERE sha256 NOT IN (SELECT file_hash FROM chunks WHERE namespace = 'en')")
def unseen_files(spark, sf):
    return catalog.unseen(_files(spark, sf), chunks(spark, sf).where("namespace = 'en'")).select("path", "size", "sha256")


@query(f"WITH {FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files")
def disk_usage(spark, sf):
    return catalog.disk_usage(_files(spark, sf))


def _old_new(spark, sf):
    c = chunks(spark, sf).select("point_id", "file_path", "chunk_index", "file_hash")
    new = c.where("file_path LIKE '%.md' AND chunk_index < 4").withColumn("file_hash", F.sha2(F.concat("file_hash", F.lit("new")), 256))
    return c, new


NEW = f"{CHUNKS_SQL}, old AS (SELECT point_id, file_path, chunk_index, file_hash FROM chunks), new AS (SELECT point_id, file_path, chunk_index, sha256(file_hash || 'new') AS file_hash FROM old WHERE file_path LIKE '%.md' AND chunk_index < 4)"


@query(f"WITH {NEW} SELECT * FROM old WHERE point_id NOT IN (SELECT point_id FROM new) UNION ALL SELECT * FROM new")
def upsert(spark, sf):
    return catalog.upsert(*_old_new(spark, sf))


@query(f"WITH {NEW} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT * FROM new")
def upsert_replace(spark, sf):
    return catalog.replace_files(*_old_new(spark, sf))


@query(f"WITH {NEW} SELECT * FROM old WHERE file_path <> '{FILE}'")
def delete_by_file(spark, sf):
    return catalog.delete_file(_old_new(spark, sf)[0], FILE)


@query(f"WITH {NEW} SELECT new.* FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.point_id = new.point_id AND old.file_hash = new.file_hash)")
def sync_delta(spark, sf):
    old, new = _old_new(spark, sf)
    return catalog.sync_delta(new, old).select("point_id", "file_path", "chunk_index", "file_hash")


@query("SELECT file_path, '{\"file_path\":\"' || file_path || '\",\"chunk_index\":' || chunk_index || '}' AS json FROM (WITH " + CHUNKS_SQL + " SELECT * FROM chunks)")
def json_rows(spark, sf):
    c = chunks(spark, sf)
    return c.select("file_path", F.to_json(F.struct("file_path", "chunk_index")).alias("json"))


# ---- audit log and access ------------------------------------------------------------------------


@query(f"WITH {AUDIT_SQL}, m AS (SELECT id, operation, namespace, key_hash, detail FROM log WHERE operation = 'view' AND namespace = 'ns1'), t AS (SELECT count(*) AS total FROM m) SELECT m.*, total FROM m, t ORDER BY id DESC LIMIT 50 OFFSET 50")
def audit_page(spark, sf):
    return catalog.audit_page(audit_log(spark, sf), 2, 50, "view", "ns1").drop("timestamp")


@query(f"WITH {AUDIT_SQL} SELECT id, operation, detail FROM log ORDER BY timestamp DESC, id DESC LIMIT 20")
def recent_searches(spark, sf):
    return catalog.recent(audit_log(spark, sf)).select("id", "operation", "detail")


@query(f"WITH {AUDIT_SQL} SELECT detail, count(*) AS times FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_searches(spark, sf):
    return catalog.top_searches(audit_log(spark, sf))


@query(f"WITH {AUDIT_SQL} SELECT id, namespace FROM log WHERE namespace IN ('ns1', 'ns3')")
def acl_filter(spark, sf):
    grants = spark.createDataFrame([("secret", "ns1"), ("secret", "ns3"), ("other", "ns0")], "key string, namespace string")
    grants = grants.select(text.key_hash(F.col("key")).alias("key_hash"), "namespace")
    return catalog.allowed(audit_log(spark, sf), grants, "secret").select("id", "namespace")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def watch_counts(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("count"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def watch_latest(spark, sf):
    from ..streaming.watch import latest

    e = read(spark, sf, "events").withColumn("path", F.col("user_id"))
    return latest(e, "event_type", F.struct("ts", "event_id")).select(F.col("path").alias("user_id"), "event_type", F.col("at.ts").alias("ts"))


@query("SELECT event_type AS field, CASE WHEN lo IS NULL THEN 'added' WHEN hi IS NULL THEN 'removed' ELSE 'retyped' END AS change FROM (SELECT event_type, max(user_id) FILTER (event_id % 2 = 0 AND event_type <> 'click') AS lo, max(user_id) FILTER (event_id % 2 = 1 AND event_type <> 'view') AS hi FROM events GROUP BY 1) WHERE lo IS DISTINCT FROM hi")
def schema_diff(spark, sf):
    """What changes between two schemas that the events table gives: fields are event types, types their largest users."""
    from ..schema import diff

    e = read(spark, sf, "events").groupBy("event_type").agg(
        F.max(F.when((F.col("event_id") % 2 == 0) & (F.col("event_type") != "click"), F.col("user_id"))).alias("lo"),
        F.max(F.when((F.col("event_id") % 2 == 1) & (F.col("event_type") != "view"), F.col("user_id"))).alias("hi"),
    )
    fields = e.collect()  # one row for each event type
    old, new = ({r.event_type: str(r[name]) for r in fields if r[name] is not None} for name in ("lo", "hi"))
    return spark.createDataFrame([(f, kind) for kind, names in diff(old, new).items() for f in names], "field string, change string")


# ---- chunkers and extraction ---------------------------------------------------------------------

_END = "CASE WHEN {s} + 500 < length(text) AND strpos(reverse(substr(text, {s} + 2, 499)), ' ') > 0 THEN {s} + 500 - strpos(reverse(substr(text, {s} + 2, 499)), ' ') ELSE {s} + 500 END"


@query(
    "WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS s, " + _END.format(s="0") + " AS e FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' UNION ALL "
    "SELECT doc_id, text, greatest(s + 1, e - 50) AS s, " + _END.format(s="greatest(s + 1, e - 50)") + " AS e FROM w WHERE greatest(s + 1, e - 50) < length(text)), "
    "c AS (SELECT doc_id AS id, s, trim(substr(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(13)) AS chunk_text FROM w) "
    "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS INTEGER) AS chunk_index, chunk_text FROM c WHERE length(chunk_text) >= 100"
)
def chunk_windows(spark, sf):
    return chunking.chunk_rows(docs(spark, sf), kind="windows")


def _sectioned(spark, sf, begin: str, gap: str = "\n"):
    """Documents whose sentences begin on lines of their own, behind a mark."""
    return docs(spark, sf).withColumn("text", F.concat(F.lit(begin), F.replace("text", F.lit(". "), F.lit(f".{gap}{begin}"))))


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
_CUT = (
    "w AS (SELECT doc_id, n, text, 0 AS s, " + _END.format(s="0") + " AS e FROM b WHERE length(text) > 500 UNION ALL "
    "SELECT doc_id, n, text, greatest(s + 1, e - 50) AS s, " + _END.format(s="greatest(s + 1, e - 50)") + " AS e FROM w WHERE greatest(s + 1, e - 50) < length(text)), "
    f"c AS (SELECT doc_id, n, s, trim(substr(text, s + 1, e - s), {_SPACE}) AS chunk_text FROM w UNION ALL SELECT doc_id, n, 0, text FROM b WHERE length(text) <= 500) "
    "SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, s) - 1 AS INTEGER) AS chunk_index, chunk_text FROM c WHERE length(chunk_text) >= 100"
)


def _sections_sql(mark: str) -> str:
    """Documents as in _sectioned(), cut at the marks; sections that are too long are cut into windows."""
    return (
        f"WITH RECURSIVE m AS (SELECT doc_id, '{mark}' || replace(text, '. ', '.' || chr(10) || '{mark}') AS text FROM documents WHERE text IS NOT NULL), "
        f"p AS (SELECT doc_id, unnest(list_transform(string_split(chr(10) || text, chr(10) || '{mark}')[2:], lambda x, i: {{'n': i, 't': trim('{mark}' || x, {_SPACE})}})) AS p FROM m), "
        "b AS (SELECT doc_id, p.n AS n, p.t AS text FROM p), " + _CUT
    )


@query(_sections_sql("# "))
def chunk_headings(spark, sf):
    return chunking.chunk_rows(_sectioned(spark, sf, "# "), kind="headings")


@query(_sections_sql("def "))
def chunk_code(spark, sf):
    return chunking.chunk_rows(_sectioned(spark, sf, "def "), kind="code")


_JOIN = "list_append(acc[:-2], acc[-1] || {glue} || x)"


@query(
    "WITH RECURSIVE m AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL), "
    rf"q AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, {_SPACE})), lambda x: x <> '') AS parts FROM m), "
    f"r AS (SELECT doc_id, list_reduce(parts, lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1]) + 2 + length(x) <= 500 THEN {_JOIN.format(glue='chr(10) || chr(10)')} ELSE list_append(acc, x) END, []::VARCHAR[]) AS runs FROM q), "
    f"o AS (SELECT doc_id, list_reduce(runs, lambda acc, x: CASE WHEN length(x) >= 100 THEN list_append(acc, x) WHEN len(acc) > 0 THEN {_JOIN.format(glue='chr(10) || chr(10)')} ELSE acc END, []::VARCHAR[]) AS chunks FROM r), "
    "b AS (SELECT doc_id, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS n FROM o), " + _CUT
)
def chunk_paragraphs(spark, sf):
    return chunking.chunk_rows(_sectioned(spark, sf, "", "\n\n"), kind="paragraphs")


@query(
    "WITH m AS (SELECT doc_id, 'Sheet: ' || replace(text, '. ', '.' || chr(10) || 'Sheet: ') AS text FROM documents WHERE text IS NOT NULL), "
    f"p AS (SELECT doc_id, unnest(list_transform(string_split(chr(10) || text, chr(10) || 'Sheet: ')[2:], lambda x, i: {{'n': i, 't': trim('Sheet: ' || x, {_SPACE})}})) AS p FROM m), "
    f"r AS (SELECT doc_id, p.n AS n, CASE WHEN length(p.t) <= 500 THEN [p.t] ELSE list_reduce(string_split(p.t, chr(10)), lambda acc, x: CASE WHEN len(acc) > 0 AND acc[-1] <> '' AND length(acc[-1]) + 1 + length(x) <= 500 THEN {_JOIN.format(glue='chr(10)')} "
    "WHEN len(acc) > 0 AND acc[-1] = '' THEN list_append(acc[:-2], x) ELSE list_append(acc, x) END, []::VARCHAR[]) END AS runs FROM p), "
    "c AS (SELECT doc_id, n, unnest(runs) AS chunk_text, generate_subscripts(runs, 1) AS s FROM r) "
    "SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, s) - 1 AS INTEGER) AS chunk_index, chunk_text FROM c WHERE length(chunk_text) >= 100"
)
def chunk_sheets(spark, sf):
    return chunking.chunk_rows(_sectioned(spark, sf, "Sheet: "), kind="sheets")


@query()
def chunk_by_type(spark, sf):
    return chunking.chunk_rows(chunks(spark, sf), "id", "chunk_text", type_col="file_type")


@query()
def chunk_recursive(spark, sf):
    return recursive.chunk_rows(_sectioned(spark, sf, "# "), language="markdown")


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'cpp' WHEN 3 THEN 'csharp' WHEN 4 THEN 'yaml' WHEN 5 THEN 'kotlin' END AS language FROM documents")
def supported_languages(spark, sf):
    """Languages looked up by name, other name, extension with and without its dot, in any case."""
    keys = F.array(*[F.lit(k) for k in ("Python3", ".RS", "cxx", "c#", "yml", "KTS", "brainfuck")])
    table = recursive.language_table(spark)
    by_key = table.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases", "extensions"))).alias("key")).dropDuplicates(["key"])
    asked = docs(spark, sf).select("doc_id", F.regexp_replace(F.lower(F.element_at(keys, (F.col("doc_id") % 7 + 1).cast("int"))), r"^\.", "").alias("key"))
    return asked.join(F.broadcast(by_key), "key", "left").select("doc_id", F.col("name").alias("language"))  # a few keys for each language


@query()
def html_extract(spark, sf):
    pages = read(spark, sf, "pages").select(F.concat(F.lit("/site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return extract.extract_files(pages).select("path", "extractor", F.char_length("text").alias("n_chars"), "text")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def stream_counts(spark, sf):
    """The events table as a stream: counters by type after all of it was read."""
    from ..streaming.watch import counts

    schema = read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"stream_counts_{abs(hash(sf))}"
    done = counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.table(name)
