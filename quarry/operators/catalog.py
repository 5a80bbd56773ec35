"""Operators over the chunk table as a catalogue: facets, listings, statistics, namespaces, access, audit, synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NAMESPACE_NAME, key_hash


def facet(df: DataFrame, column: str = "file_type", limit: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(limit)


def files_by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_type").agg(F.countDistinct("file_path").alias("files"))


def file_listing(chunks: DataFrame, file_type: str | None = None) -> DataFrame:
    """A row per file: chunks, and name, type and time of indexing as its first chunk has them."""
    x = chunks if file_type is None else chunks.where(F.col("file_type") == file_type)
    firsts = [F.min_by(c, "chunk_index").alias(c) for c in ("file_name", "file_type", "indexed_at")]
    return x.groupBy("file_path").agg(F.count("*").alias("chunk_count"), *firsts)


def recent_files(listing: DataFrame, limit: int = 8) -> DataFrame:
    return listing.orderBy(F.desc_nulls_last("indexed_at"), "file_path").limit(limit)


def file_chunks(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).orderBy("chunk_index")


def stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, files, distinct hashes, characters, last indexing, and chunks by type."""
    totals = chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("file_path").alias("total_files"), F.countDistinct("file_hash").alias("total_hashes"), F.sum(F.char_length("chunk_text")).alias("total_chars"), F.max("indexed_at").alias("last_indexed_at"))
    types = facet(chunks, limit=50).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_type", "count"))), lambda r: F.concat(r["file_type"], F.lit("="), r["count"].cast("string"))), ",").alias("file_types"))
    return totals.crossJoin(F.broadcast(types))  # one row each


def namespaces(chunks: DataFrame) -> DataFrame:
    default = chunks.sparkSession.createDataFrame([("default",)], "namespace string")
    return chunks.select("namespace").union(default).where("namespace is not null").distinct().orderBy("namespace")


def valid_namespace(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike(NAMESPACE_NAME)


def collection_info(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("namespace").agg(F.count("*").alias("points"), F.countDistinct("file_path").alias("files"), F.count("page_number").alias("with_page"))


def allowed(rows: DataFrame, grants: DataFrame, key: str | None) -> DataFrame:
    """Rows of the namespaces that a key may read; without grants at all everything is open."""
    if key is None:
        open_ = grants.limit(1).agg(F.count("*").alias("_n"))  # one row
        return rows.crossJoin(F.broadcast(open_)).where("_n = 0").drop("_n")
    mine = grants.where(F.col("key_hash") == key_hash(F.lit(key)))
    return rows.join(mine.select("namespace").distinct(), "namespace", "left_semi")


def audit_page(log: DataFrame, page: int = 1, page_size: int = 50, operation: str | None = None, namespace: str | None = None, id_col: str = "id") -> DataFrame:
    """One page of the log, newest id first, with the number of all matching rows."""
    if not 1 <= page_size <= 200 or page < 1:
        raise ValueError("page starts at 1 and page_size is 1 to 200")
    x = log if operation is None else log.where(F.col("operation") == operation)
    x = x if namespace is None else x.where(F.col("namespace") == namespace)
    total = x.agg(F.count("*").alias("total"))  # one row
    return x.orderBy(F.desc(id_col)).offset((page - 1) * page_size).limit(page_size).crossJoin(F.broadcast(total))


def recent(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def top_searches(log: DataFrame, column: str = "detail", limit: int = 10) -> DataFrame:
    return log.groupBy(column).agg(F.count("*").alias("times")).orderBy(F.desc("times"), column).limit(limit)


def disk_usage(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# ---- changes of the chunk table ------------------------------------------------------------------


def first_of_hash(files: DataFrame) -> DataFrame:
    """Files whose content no file before them (by path) has."""
    order = Window.partitionBy("sha256").orderBy("path")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def unseen(files: DataFrame, chunks: DataFrame, column: str = "sha256") -> DataFrame:
    return files.join(chunks.select(F.col("file_hash").alias(column)).distinct(), column, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_files(old: DataFrame, new: DataFrame, path: str = "file_path") -> DataFrame:
    """All chunks of the files in `new` give way to the new ones, so a file that shrank leaves none behind."""
    return old.join(new.select(path).distinct(), path, "left_anti").unionByName(new)


def delete_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(~F.col("file_path").eqNullSafe(path))


def sync_delta(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of source that target lacks or has with another content hash."""
    return source.join(target.select("point_id", "file_hash"), ["point_id", "file_hash"], "left_anti")


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
