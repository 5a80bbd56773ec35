"""Index writer: files to chunk rows, and versions of the chunk table behind a pointer that is swapped at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions.extract import extract_files
from ..functions.text import page_numbers, point_id
from ..schema import CHUNKS
from . import catalog, vector


@dataclass
class Summary:
    """What an indexing run did; updated counts known paths whose content is new."""

    total: int = 0
    new: int = 0
    updated: int = 0
    skipped: int = 0
    duplicates: int = 0
    chunks: int = 0


class BatchModel:
    """A model for embed= that gets lists of texts: load() makes it, once in each Python worker; its result maps a list of texts to vectors.

    Called with one text, as for a query, it loads the model where it stands.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 64) -> None:
        self.load, self.batch, self.name = load, batch, uuid.uuid4().hex

    def __call__(self, text: str) -> Sequence[float]:
        return _loaded(self)([text])[0]


_MODELS: dict[str, Callable] = {}


def _loaded(model: BatchModel) -> Callable[[list[str]], Sequence[Sequence[float]]]:
    """The model as this process holds it."""
    if model.name not in _MODELS:
        _MODELS[model.name] = model.load()
    return _MODELS[model.name]


def embedded(rows: DataFrame, embed: Callable[[str], Sequence[float]] | BatchModel) -> DataFrame:
    """point_id, embedding: the vectors that a model gives the rows' chunk_text. A BatchModel gets lists of texts of like length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.operators.index import BatchModel, _loaded  # the worker's own module, which holds the model

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if isinstance(embed, BatchModel):
                model, vectors = _loaded(embed), [None] * len(texts)
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                for at in range(0, len(order), embed.batch):
                    some = order[at : at + embed.batch]
                    for i, v in zip(some, model([texts[i] for i in some]), strict=True):
                        vectors[i] = [float(x) for x in v]
            else:
                vectors = [[float(x) for x in embed(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["point_id", "embedding"])

    return rows.select("point_id", "chunk_text").mapInArrow(run, "point_id string, embedding array<float>")


def chunk_files(files: DataFrame, namespace: str = "default", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, dims: int = 64, embed: Callable[[str], Sequence[float]] | BatchModel | None = None) -> DataFrame:
    """Rows of the chunk table (schema CHUNKS) for files (path, file_name, file_type, modified_at, sha256, content).

    Only extraction and chunking run in Python, and `embed` if it is given; ids, pages and hashed embeddings are JVM
    expressions.
    """
    texts = extract_files(files.select("path", "file_name", "file_type", "modified_at", "sha256", "content"))
    rows = chunking.chunk_rows(texts, "path", "text", type_col="file_type", size=size, overlap=overlap)
    rows = rows.withColumnRenamed("id", "path").withColumn("point_id", point_id(F.col("path"), F.col("chunk_index")))
    paged = texts.where("page_offsets is not null").select("path", "text", "page_offsets")
    lists = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"]).alias("c"))  # a file's chunks
    pages = paged.join(lists, "path").select("path", F.posexplode(page_numbers(F.col("c"), F.col("text"), F.col("page_offsets"))).alias("chunk_index", "page_number"))
    vectors = embedded(rows, embed) if embed else vector.hash_embed(rows, "point_id", "chunk_text", dims).withColumnRenamed("id", "point_id")
    x = rows.join(texts.select("path", "file_name", "file_type", "modified_at", "sha256", "extractor"), "path").join(pages, ["path", "chunk_index"], "left").join(vectors, "point_id")
    return x.select(
        F.lit(namespace).alias("namespace"), "point_id", F.col("path").alias("file_path"), "file_name", "file_type", "chunk_index", "chunk_text", F.col("sha256").alias("file_hash"),
        F.current_timestamp().alias("indexed_at"), "extractor", "page_number", F.col("modified_at").alias("file_modified_at"), "embedding",
    )


class Conflict(RuntimeError):
    """Another writer has changed what a commit was made from."""


class Store:
    """The chunk table under root as parts: the files of a namespace, dealt to BUCKETS by a hash of their paths.

    A version is a list of the folders of its parts; the highest number is the current one. A commit writes the parts that
    change into new folders and puts the list, with the untouched parts, under the next number, which only one writer can
    take. One that finds it taken looks at what the other changed: with other parts it takes the number after that, with
    one of its own it begins anew from the other's version. A writer that fails before that leaves the old version. What a
    commit costs is the parts that it touches. The last two versions stay.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- files ----

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def list_numbers(self, name: str) -> list[int]:
        """The folders below a name that are called by numbers."""
        if not self.has(name):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(name))]
        return [int(x) for x in names if x.isdigit()]

    def names(self) -> set[str]:
        """Namespaces that were made, with chunks or without."""
        return set(json.loads(self.text("NAMESPACES"))) if self.has("NAMESPACES") else set()

    def set_names(self, names: set[str]) -> None:
        self.put("NAMESPACES", json.dumps(sorted(names)))

    def watches(self) -> dict[str, list[str]]:
        """Watched folders with their checkpoints and debounce times."""
        return json.loads(self.text("WATCHES")) if self.has("WATCHES") else {}

    def set_watches(self, watches: dict[str, list[str]]) -> None:
        self.put("WATCHES", json.dumps(watches))

    # ---- versions ----

    def version(self) -> int:
        return max(self.list_numbers("versions"), default=0)

    def parts(self, version: int | None = None) -> dict[tuple[str, int], str]:
        """(namespace, bucket) -> folder of every part of a version, the current one unless another is given."""
        return {part: folder for part, (folder, _) in self.manifest(version).items()}

    def manifest(self, version: int | None = None) -> dict[tuple[str, int], tuple[str, str]]:
        """(namespace, bucket) -> folder and checksum of every part; equal checksums mean equal rows, whatever their order."""
        v = self.version() if version is None else version
        return {(ns, b): (folder, check) for ns, b, folder, check in json.loads(self.text(f"versions/{v}"))} if v > 0 and self.has(f"versions/{v}") else {}

    def _checksums(self, folder: str) -> dict[tuple[str, int], str]:
        """Of the parts that a commit has written: the number of rows, and two sums over hashes of what makes a row."""
        row = [F.col(c).cast("string") for c in CHUNKS.fieldNames() if c != "indexed_at"]
        x = self.spark.read.parquet(f"{self.root}/{folder}").withColumn("part_namespace", F.col("part_namespace").cast("string"))
        low = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
        found = x.groupBy("part_namespace", "part_bucket").agg(F.concat_ws(":", F.count("*"), low(F.xxhash64(*row)), low(F.xxhash64(F.lit("second"), *row))).alias("check")).collect()  # a row a part
        return {(ns, b): check for ns, b, check in found}

    @classmethod
    def bucket(cls, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(cls.BUCKETS)).cast("int")

    def read(self, namespace: str | None = None, only: set[tuple[str, int]] | None = None, version: int | None = None) -> DataFrame:
        """The chunks of a namespace, or all; only: of these parts alone; of the current version unless another is given."""
        folders = [f"{self.root}/{folder}" for part, folder in self.parts(version).items() if namespace in (None, part[0]) and (only is None or part in only)]
        return self.spark.read.schema(CHUNKS).parquet(*folders) if folders else self.spark.createDataFrame([], CHUNKS)

    def commit(self, chunks: DataFrame, touched: set[tuple[str, int]] | None = None, base: int | None = None) -> int:
        """Make chunks the content of the touched parts (of the whole table, if None); the new version.

        base: the version that chunks were made from, the current one unless given. Conflict is raised if another writer
        has changed one of the touched parts since.
        """
        base = self.version() if base is None else base
        before = self.parts(base)
        folder = f"data/{base + 1}-{uuid.uuid4().hex[:8]}"
        rows = chunks.select(*CHUNKS.fieldNames(), F.col("namespace").alias("part_namespace"), self.bucket(F.col("file_path")).alias("part_bucket"))
        ordered = rows.repartition("part_namespace", "part_bucket").sortWithinPartitions("part_namespace", "part_bucket", "file_path", "chunk_index")
        ordered.write.mode("overwrite").partitionBy("part_namespace", "part_bucket").parquet(f"{self.root}/{folder}")
        found = self._fs.globStatus(self._path(f"{folder}/part_namespace=*/part_bucket=*")) or []
        checks = self._checksums(folder) if found else {}
        new: dict[tuple[str, int], tuple[str, str]] = {}
        for status in found:
            bucket, name = status.getPath().getName(), status.getPath().getParent().getName()
            part = name.partition("=")[2], int(bucket.partition("=")[2])
            new[part] = f"{folder}/{name}/{bucket}", checks[part]
        while True:
            v = self.version()
            known = self.manifest(v)
            old = {part: f for part, (f, _) in known.items()}
            mine = set(old) | set(before) if touched is None else touched
            if any(old.get(part) != before.get(part) for part in mine):
                self.remove(folder)
                raise Conflict(f"version {v} changed parts that were read from version {base}")
            kept = {part: x for part, x in known.items() if part not in mine}
            if self._publish(v + 1, kept | new):
                break
        for f in set(self.parts(v - 1).values()) - set(old.values()) - {f for f, _ in (kept | new).values()}:
            self.remove(f)
        self.remove(f"versions/{v - 1}")
        return v + 1

    def _publish(self, v: int, parts: dict[tuple[str, int], tuple[str, str]]) -> bool:
        """Put a version under its number unless another writer has; it is seen whole or not at all."""
        name = f"versions/.writing-{uuid.uuid4().hex}"
        self.put(name, json.dumps([[*part, *x] for part, x in sorted(parts.items())]))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(name), self._path(f"versions/{v}"), options)  # refuses a name that is taken
        except Py4JJavaError as e:
            self.remove(name)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def change(self, gone: DataFrame, fresh: DataFrame | None = None, attempts: int = 10) -> int:
        """Take all chunks of files (namespace, file_path) out and put fresh ones in; only the parts of these files are rewritten.

        After a conflict the same change is made to the other writer's version.
        """
        files = gone.select("namespace", "file_path")
        if fresh is not None:
            files = files.union(fresh.select("namespace", "file_path"))
        touched = {(r[0], r[1]) for r in files.select("namespace", self.bucket(F.col("file_path"))).distinct().collect()}  # BUCKETS rows a namespace at most
        if not touched:
            return self.version()
        for attempt in range(attempts):
            base = self.version()
            kept = self.read(only=touched, version=base).join(gone.select("namespace", "file_path").distinct(), ["namespace", "file_path"], "left_anti").select(*CHUNKS.fieldNames())
            try:
                return self.commit(kept if fresh is None else kept.unionByName(fresh.select(*CHUNKS.fieldNames())), touched, base)
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise AssertionError("attempts must be at least 1")

    def compact(self) -> int:
        """Rewrite the whole table."""
        return self.commit(self.read())


def index_files(store: Store, files: DataFrame, namespace: str = "default", force: bool = False, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, dims: int = 64, embed: Callable[[str], Sequence[float]] | None = None) -> Summary:
    """Index files whose content the namespace does not have; a file's new chunks replace all its old ones."""
    old = store.read(namespace)
    files = files.persist()
    first = catalog.first_of_hash(files)
    wanted = first if force else catalog.unseen(first, old)
    known = old.select(F.col("file_path").alias("path")).distinct()
    out = Summary(total=files.count())
    wanted = wanted.persist()
    n = wanted.count()
    out.updated = wanted.join(known, "path", "left_semi").count()
    out.new, out.skipped = n - out.updated, out.total - n
    out.duplicates = out.total - first.count()
    if n:
        fresh = chunk_files(wanted, namespace, size, overlap, dims, embed).persist()
        out.chunks = fresh.count()
        # a changed file without chunks any more loses its old ones too
        store.change(wanted.select(F.lit(namespace).alias("namespace"), F.col("path").alias("file_path")), fresh)
        fresh.unpersist()
    wanted.unpersist()
    files.unpersist()
    return out
