"""Table schemas, and the versioned payload schema with additive evolution."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("namespace", T.StringType()), ("point_id", T.StringType()), ("file_path", T.StringType()), ("file_name", T.StringType()), ("file_type", T.StringType()),
        ("chunk_index", T.IntegerType()), ("chunk_text", T.StringType()), ("file_hash", T.StringType()), ("indexed_at", T.TimestampType()), ("extractor", T.StringType()),
        ("page_number", T.IntegerType()), ("file_modified_at", T.TimestampType()), ("embedding", T.ArrayType(T.FloatType())),
    ]]
)

# Payload fields by kind, and the vector configuration.
PAYLOAD = {"file_path": "keyword", "file_name": "keyword", "file_type": "keyword", "chunk_text": "text", "chunk_index": "integer", "file_hash": "keyword", "indexed_at": "keyword", "extractor": "keyword", "page_number": "integer", "file_modified_at": "keyword", "namespace": "keyword"}
VECTOR = {"name": "text", "size": 384, "distance": "Cosine"}


class IncompatibleSchema(Exception):
    """Fields or vectors of an index do not allow the change without indexing again."""


def diff(old: dict[str, str], new: dict[str, str]) -> dict[str, list[str]]:
    """added, removed and retyped fields, each in order of name."""
    return {"added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()), "retyped": sorted(f for f in new.keys() & old.keys() if new[f] != old[f])}


class SchemaLog:
    """The schemas that collections had, as a table of a store: a row (HISTORY) for each collection and version.

    Versions are only ever added, each in a folder of its own that must not exist before, so of two writers of one
    version one fails.
    """

    HISTORY = "collection string, version int, fields map<string,string>, vector map<string,string>, created_at timestamp"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/schemas"

    def history(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.HISTORY)
        return self.spark.read.schema(self.HISTORY).option("recursiveFileLookup", True).parquet(self.root)

    def current(self) -> DataFrame:
        """The last version of each collection."""
        last = F.max_by(F.struct("version", "fields", "vector", "created_at"), "version").alias("last")
        return self.history().groupBy("collection").agg(last).select("collection", "last.*")

    def changes(self, collection: str, fields: dict[str, str], vector: dict[str, object]) -> tuple[int, list[str], list[str]]:
        """(version now, 0 if there is none; what a change to these would add; what of it is not possible)."""
        row = self.current().where(F.col("collection") == collection).first()
        if row is None:
            return 0, sorted(fields), []
        change = diff(row.fields, fields)
        bad = [f"{kind}: {name}" for kind in ("removed", "retyped") for name in change[kind]]
        return row.version, change["added"], bad + [f"vector: {k}" for k in diff(row.vector, _texts(vector))["retyped"]]

    def migrate(self, collection: str, fields: dict[str, str] | None = None, vector: dict[str, object] | None = None) -> int:
        """Bring a collection to these fields; its version then. Only additions are possible."""
        fields, vector = fields or PAYLOAD, vector or VECTOR
        version, added, bad = self.changes(collection, fields, vector)
        if bad:
            raise IncompatibleSchema(f"{collection}: {', '.join(bad)}")
        if added:
            version += 1
            row = self.spark.createDataFrame([(collection, version, dict(fields), _texts(vector), datetime.now(UTC))], self.HISTORY)
            row.coalesce(1).write.mode("error").parquet(f"{self.root}/{collection}/{version}")
        return version


def _texts(vector: dict[str, object]) -> dict[str, str]:
    return {k: str(v) for k, v in vector.items()}
