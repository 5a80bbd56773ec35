"""The driver's tables as files and chunks of the engine.

A chunk table row is a document: ten consecutive doc_ids make a file under /corpus/<source of the chunk>/, whose type
follows from its number. SQL twins of both views serve the DuckDB checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, file_suffix, point_id

TYPES = (".txt", ".md", ".py", ".csv", ".pdf")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table without embeddings; id is the document's."""
    d = read(spark, sf_dir, "documents")
    number = F.floor(F.col("doc_id") / 10)
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod(number, F.lit(len(TYPES))) + 1).cast("int"))
    x = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("namespace"), F.concat(F.lit("/corpus/"), F.pmod(number, F.lit(7)).cast("string"), F.lit("/"), number.cast("string"), kind).alias("file_path"), F.pmod("doc_id", F.lit(10)).cast("int").alias("chunk_index"), F.col("text").alias("chunk_text"), F.sha2("text", 256).alias("file_hash"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60)
    page = F.when(F.col("file_path").endswith(".pdf"), (F.floor(F.col("chunk_index") / 3) + 1).cast("int"))
    return x.select("id", "namespace", point_id(F.col("file_path"), F.col("chunk_index")).alias("point_id"), "file_path", file_name(F.col("file_path")).alias("file_name"), file_suffix(F.col("file_path")).alias("file_type"), "chunk_index", "chunk_text", "file_hash", at.alias("indexed_at"), F.lit("text").alias("extractor"), page.alias("page_number"), at.alias("file_modified_at"))


CHUNKS_SQL = """c0 AS (SELECT doc_id AS id, lang AS namespace, doc_id // 10 AS num, CAST(doc_id % 10 AS INTEGER) AS chunk_index, text AS chunk_text, sha256(text) AS file_hash FROM documents),
c1 AS (SELECT *, ['.txt', '.md', '.py', '.csv', '.pdf'][num % 5 + 1] AS file_type FROM c0),
c2 AS (SELECT *, '/corpus/' || (num % 7) || '/' || num || file_type AS file_path, num || file_type AS file_name, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(id) AS indexed_at FROM c1),
c3 AS (SELECT *, sha1(unhex('d1b4c5e87f3a4e2b9a1c6d8e0f2b3c4a') || encode(file_path || ':' || chunk_index)) AS h, CASE WHEN file_type = '.pdf' THEN CAST(chunk_index // 3 + 1 AS INTEGER) END AS page_number, indexed_at AS file_modified_at, 'text' AS extractor FROM c2),
chunks AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM c3)"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an audit log: id, timestamp, operation, key_hash, namespace, detail."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("operation"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("key_hash"), F.concat(F.lit("ns"), F.pmod("user_id", F.lit(4)).cast("string")).alias("namespace"), F.concat(F.lit("q"), F.pmod("user_id", F.lit(30)).cast("string")).alias("detail"))


AUDIT_SQL = "log AS (SELECT event_id AS id, ts AS timestamp, event_type AS operation, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS key_hash, 'ns' || (user_id % 4) AS namespace, 'q' || (user_id % 30) AS detail FROM events)"
