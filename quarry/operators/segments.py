"""The kept BM25 index: immutable segments of packed postings, changed by commits that cost what they change.

A segment holds blocks of at most BLOCK postings of one term (ids, counts and document lengths side by side, so a search
needs no table of lengths), by term and falling impact; its documents with their terms and counts; and signed changes of document
frequencies. A commit writes one segment with the fresh documents, the ids that left as tombstones for older segments, and
the changes of the figures, then replaces the manifest. Segments of like size merge, so that there are few; a merge also
is one new segment and a new manifest, so one that fails is as if it had not begun.

A search reads the blocks of its terms in two passes. The first takes the blocks of the highest impact and gives a score
that top_k documents reach for certain. A block of which no document can reach it, whatever its other terms give, is not
read in the second: terms and impacts are compared in the scan.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query_parser import Query
from ..functions.text import terms
from . import bm25
from .bm25 import EPSILON, K1, B

#: Postings of a block; blocks of a term in a file that the first pass of a search reads.
BLOCK, FIRST = 128, 2
#: Bytes of a row group of documents and their terms, before compression.
DOCS_GROUP = 8 << 20
#: Words whose postings one task sorts at most, about. One pass over the documents deals to at most RANGES tasks: up to 200
#: (spark.shuffle.sort.bypassMergeThreshold) Spark writes rows to their range as they come; beyond it holds and sorts them first.
TASK_WORDS, RANGES = 2_000_000, 200
#: So many trailing segments of at most one tier merge; a tier has FAN times the documents of the one below.
FAN = 8
#: Terms that are looked up by a condition in the scan; beyond it by a join.
LISTED = 2_000
#: Terms with more blocks than this are dealt to SALTS tasks when a batch of queries meets them.
MANY, SALTS = 4_096, 16


@dataclass
class Segment:
    """number: the commit that wrote it (the last one merged); avgdl: of the corpus then, for which its impacts hold."""

    number: int
    folder: str
    docs: int
    avgdl: float


@dataclass
class Manifest:
    version: int = 0
    n: int = 0
    tokens: int = 0
    segments: list[Segment] = field(default_factory=list)

    @property
    def avgdl(self) -> float:
        return self.tokens / self.n if self.n else 0.0


def _norm(dl: Column, avgdl: float | Column) -> Column:
    return F.lit(1 - B) + B * dl / F.greatest(avgdl if isinstance(avgdl, Column) else F.lit(float(avgdl)), F.lit(1e-9))


def _part(tf: Column, dl: Column, avgdl: float | Column) -> Column:
    """What a posting gives for a weight of one, without the factor K1 + 1."""
    return tf / (tf + K1 * _norm(dl, avgdl))


def _counted(texts: DataFrame) -> DataFrame:
    """id, stamp, text -> id, stamp, dl, terms with their counts. A text is counted in its own row: its words are sorted, and a term reaches from one start to the next."""
    x = texts.select("id", "stamp", F.sort_array(terms(F.col("text"))).alias("words"))
    begins = F.transform("words", lambda w, i: F.when((i == 0) | (w != F.get("words", i - 1)), i))
    x = x.select("id", "stamp", "words", F.filter(begins, lambda i: i.isNotNull()).alias("starts"))
    count = lambda at, k: F.coalesce(F.get("starts", k + 1), F.size("words")) - at
    listed = F.transform("starts", lambda at, k: F.struct(F.get("words", at).alias("term"), count(at, k).alias("tf")))
    return x.select("id", "stamp", F.size("words").cast("long").alias("dl"), listed.alias("terms"))


def _packed(rows: DataFrame, avgdl: float, tasks: int) -> DataFrame:
    """Postings (id, term, tf, dl) -> blocks, by term and falling impact. A term of any length is spread over the ranges of the sort, one for each task."""
    kind = dict(rows.dtypes)["id"]
    impact = _part(F.col("tf"), F.col("dl"), avgdl)  # made anew after the shuffle, of which it would be a quarter
    order = (F.col("term"), F.desc(impact), F.col("id"))
    ordered = rows.select("term", "id", F.col("tf").cast("int"), F.col("dl").cast("int")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered = ordered.select("term", impact.alias("impact"), "id", "tf", "dl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(codes, prepend=-1))  # where a term begins
            sizes = np.diff(np.append(first, batch.num_rows))
            starts = np.concatenate([np.arange(a, a + n, BLOCK) for a, n in zip(first, sizes, strict=True)])
            ends = np.append(starts[1:], batch.num_rows)
            names = batch.column(0).take(pa.array(starts))
            numbers = np.concatenate([np.arange((n + BLOCK - 1) // BLOCK) for n in sizes])
            if batch.column(0)[0].as_py() == last:  # the batch before ended in the same term
                numbers[: (sizes[0] + BLOCK - 1) // BLOCK] += nth + 1
            last, nth = batch.column(0)[-1].as_py(), int(numbers[-1])
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in (2, 3, 4)]
            yield pa.record_batch([names, batch.column(1).take(pa.array(starts)), pa.array(numbers.astype(np.int32)), pa.array((ends - starts).astype(np.int32)), *lists], names=["term", "impact", "nth", "size", "ids", "tfs", "dls"])

    return ordered.mapInArrow(run, f"term string, impact double, nth int, size int, ids array<{kind}>, tfs array<int>, dls array<int>")


def _write_docs(docs: DataFrame, at: str) -> None:
    """Row groups are small, as a reader's batch of nested values ends with its group."""
    docs.write.option("parquet.block.size", DOCS_GROUP).option("compression", "zstd").parquet(at)


class Kept:
    """A BM25 index under one folder of a store; see create() and open()."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest) -> None:
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    # ---- the manifest ----

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Kept | None:
        """The index under path, or None if there is none."""
        out = cls(spark, path, Manifest())
        fs, file = out._fs("MANIFEST")
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        raw = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        out.manifest = Manifest(**raw | {"segments": [Segment(**s) for s in raw["segments"]]})
        return out

    def _swap(self, manifest: Manifest) -> None:
        """Make a manifest the current one; what only the one before the last names is deleted, as searches may still read the last."""
        fs, old = self._fs("MANIFEST")
        fs, new = self._fs("MANIFEST.next")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(new, old, options)
        live = {s.folder for s in (*self.manifest.segments, *manifest.segments)}
        _, root = self._fs("")
        for status in fs.listStatus(root):
            if status.isDirectory() and status.getPath().getName() not in live:
                fs.delete(status.getPath(), True)
        self.manifest = manifest

    # ---- changing ----

    @classmethod
    def create(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Kept:
        out = cls(docs.sparkSession, path, Manifest())
        out.commit(docs, None, id_col, text_col)
        return out

    def commit(self, fresh: DataFrame | None, gone: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Take the ids of gone (one column) out and the documents of fresh in, which are to be new or among gone."""
        old, number = self.manifest, self.manifest.version + 1
        folder = f"s{number}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{folder}"
        docs, tokens, changes = 0, 0, []
        if fresh is not None:
            texts = fresh.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("stamp"))
            _write_docs(_counted(texts.sortWithinPartitions("id")), f"{at}/docs")  # the texts are sorted, as their terms take more room
            docs, tokens = self.spark.read.parquet(f"{at}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        left = leaving = 0
        if gone is not None and old.segments:
            gone.select(F.col(gone.columns[0]).alias("id"), F.lit(number).alias("upto")).distinct().write.parquet(f"{at}/gone")
            ids = self.spark.read.parquet(f"{at}/gone").select("id")
            few = [r.id for r in ids.limit(LISTED + 1).collect()]
            # read twice, first without the terms: kept in memory, the terms of ten thousand documents would be one batch
            held = self.docs(F.col("id").isin(*few) if len(few) <= LISTED else None)
            left, leaving = held.select("id", "dl").join(ids, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            dead = held.select("id", F.col("terms.term").alias("terms")).join(ids, "id", "left_semi")
            changes.append(dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("d")))
        manifest = Manifest(number, old.n + docs - left, old.tokens + tokens - leaving, [*old.segments, Segment(number, folder, docs, 0.0)])
        manifest.segments[-1].avgdl = manifest.avgdl
        if docs:
            self._write_blocks(at, manifest.avgdl, tokens)
            changes.append(self.spark.read.parquet(f"{at}/blocks").groupBy("term").agg(F.sum("size").alias("d")))
        if changes:
            summed = changes[0] if len(changes) == 1 else reduce(DataFrame.unionByName, changes).groupBy("term").agg(F.sum("d").alias("d"))
            summed.where("d <> 0").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
            delta = self.spark.read.parquet(f"{at}/terms")
            few = [r.term for r in delta.select("term").limit(LISTED + 1).collect()] if old.segments else []
            before = self.frequencies(F.col("term").isin(*few) if len(few) <= LISTED else None) if old.segments else self._none("term string, df long")
            steps = delta.join(before, "term", "left").select(F.explode(F.array(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.lit(-1).alias("d")), F.struct((F.coalesce("df", F.lit(0)) + F.col("d")).alias("df"), F.lit(1).alias("d")))).alias("x"))
            steps.select("x.*").where("df > 0").groupBy("df").agg(F.sum("d").alias("d")).coalesce(1).write.parquet(f"{at}/histogram")
        self._swap(manifest)
        while run := self._mergeable():
            self._merge(run)

    def _write_blocks(self, at: str, avgdl: float, tokens: int) -> None:
        """The blocks of a segment from its documents' terms. What a task holds does not grow with the documents: more words make more tasks, then more passes, each over a share of the terms."""
        tasks = max(self.spark.sparkContext.defaultParallelism, math.ceil(tokens / TASK_WORDS))
        passes = math.ceil(tasks / RANGES)
        listed = self.spark.read.parquet(f"{at}/docs").select("id", "dl", F.explode("terms").alias("t")).select("id", "t.term", "t.tf", "dl")
        for k in range(passes):
            mine = listed if passes == 1 else listed.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)
            _packed(mine, avgdl, math.ceil(tasks / passes)).write.mode("append").option("parquet.block.size", 4 << 20).option("parquet.page.row.count.limit", 200).option("compression", "zstd").parquet(f"{at}/blocks")

    def _mergeable(self) -> list[Segment]:
        """The trailing segments to merge: the longest run of FAN or more that are no larger than some tier, or none."""
        tier = lambda s: int(math.log(max(1, s.docs), FAN))
        found: list[Segment] = []
        for t in {tier(s) for s in self.manifest.segments}:
            run: list[Segment] = []
            for s in reversed(self.manifest.segments):
                if tier(s) > t:
                    break
                run.insert(0, s)
            if len(run) >= FAN and len(run) > len(found):
                found = run
        return found

    def _merge(self, run: list[Segment]) -> None:
        """Replace a trailing run by one segment of its living documents; the sums of its changes stay, and its tombstones for what is older."""
        number, folder = run[-1].number, f"m{run[-1].number}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{folder}"
        part = Kept(self.spark, self.path, Manifest(segments=run))
        _write_docs(part.docs().sortWithinPartitions("id"), f"{at}/docs")
        docs, tokens = self.spark.read.parquet(f"{at}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        part.frequencies(positive=False).withColumnRenamed("df", "d").where("d <> 0").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        part._read("histogram", "df long, d long").groupBy("df").agg(F.sum("d").alias("d")).coalesce(1).write.parquet(f"{at}/histogram")
        if len(run) < len(self.manifest.segments):
            part._read("gone", self._gone_schema()).select("id", "upto").write.parquet(f"{at}/gone")
        if docs:
            self._write_blocks(at, self.manifest.avgdl, tokens)
        kept = [s for s in self.manifest.segments if s not in run]
        self._swap(Manifest(self.manifest.version, self.manifest.n, self.manifest.tokens, [*kept, Segment(number, folder, docs, self.manifest.avgdl)]))

    # ---- tables ----

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _id_type(self) -> str:
        for s in self.manifest.segments:
            fs, path = self._fs(f"{s.folder}/docs")
            if fs.exists(path):
                return self.spark.read.parquet(f"{self.path}/{s.folder}/docs").schema["id"].dataType.simpleString()
        return "string"

    def _gone_schema(self) -> str:
        return f"id {self._id_type()}, upto int"

    def _read(self, table: str, schema: str) -> DataFrame:
        """A table of all segments, with the number of each row's segment."""
        frames = []
        for s in self.manifest.segments:
            fs, path = self._fs(f"{s.folder}/{table}")
            if fs.exists(path):
                frames.append(self.spark.read.schema(schema).parquet(f"{self.path}/{s.folder}/{table}").withColumn("segment", F.lit(s.number)))
        return reduce(DataFrame.unionByName, frames) if frames else self._none(f"{schema}, segment int")

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows (id, segment, ...) whose document no later commit took out."""
        if not any(self._fs(f"{s.folder}/gone")[0].exists(self._fs(f"{s.folder}/gone")[1]) for s in self.manifest.segments):
            return rows
        dead = self._read("gone", self._gone_schema()).groupBy("id").agg(F.max("upto").alias("upto")).withColumnRenamed("id", "_gone")
        return rows.join(dead, (F.col("id") == F.col("_gone")) & (F.col("segment") < F.col("upto")), "left_anti")

    def docs(self, where: Column | None = None) -> DataFrame:
        """id, stamp, dl, terms of the documents; where reaches the scans, which are sorted by id."""
        x = self._read("docs", f"id {self._id_type()}, stamp long, dl long, terms array<struct<term: string, tf: int>>")
        return self._living(x if where is None else x.where(where)).drop("segment")

    def frequencies(self, where: Column | None = None, positive: bool = True) -> DataFrame:
        """term, df: the sums of the changes."""
        x = self._read("terms", "term string, d long")
        x = (x if where is None else x.where(where)).groupBy("term").agg(F.sum("d").alias("df"))
        return x.where("df > 0") if positive else x

    def blocks(self) -> DataFrame:
        kind = self._id_type()
        return self._read("blocks", f"term string, impact double, nth int, size int, ids array<{kind}>, tfs array<int>, dls array<int>")

    def postings(self, blocks: DataFrame | None = None, *more: str) -> DataFrame:
        """id, term, tf, dl, segment, and more columns of the blocks, of living documents."""
        x = (self.blocks() if blocks is None else blocks).select("term", "segment", *more, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return self._living(x.select(F.col("p.ids").alias("id"), "term", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), "segment", *more))

    def mean_idf(self) -> float:
        """The mean over all terms of their raw idf, from how many terms have each document frequency."""
        n = F.lit(float(self.manifest.n))
        x = self._read("histogram", "df long, d long").groupBy("df").agg(F.sum("d").alias("d")).where("d <> 0")
        total, count = x.agg(F.sum(F.col("d") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))), F.sum("d")).first()
        return total / count if count else 0.0

    # ---- searching ----

    def weights(self, wanted: dict[str, int]) -> dict[str, float]:
        """A query's terms with times * idf; terms without weight are left out."""
        n = self.manifest.n
        found = {r.term: r.df for r in self.frequencies(F.col("term").isin(*wanted)).collect()} if wanted else {}  # a query's terms
        raw = {t: math.log((n - df + 0.5) / (df + 0.5)) for t, df in found.items()}
        mean = self.mean_idf() if any(x < 0 for x in raw.values()) else 0.0
        out = {t: wanted[t] * (EPSILON * mean if x < 0 else x) for t, x in raw.items()}
        return {t: w for t, w in sorted(out.items()) if w != 0}

    def _scores(self, weights: dict[str, float], blocks: DataFrame, within: DataFrame | None) -> DataFrame:
        weight = F.create_map(*[F.lit(x) for item in weights.items() for x in item])[F.col("term")]
        x = self.postings(blocks)
        x = x if within is None else x.join(within, "id", "left_semi")
        return x.groupBy("id").agg(F.sum(weight * (K1 + 1) * _part(F.col("tf"), F.col("dl"), self.manifest.avgdl)).alias("score"))

    def score(self, query: str | Query) -> DataFrame:
        """id, score of every document with a positive score."""
        weights = self.weights(bm25.query_terms(query))
        if not weights:
            return self._none(f"id {self._id_type()}, score double")
        return self._scores(weights, self.blocks().where(F.col("term").isin(*weights)), None).where("score > 0")

    def needed(self, weights: dict[str, float], top_k: int, within: DataFrame | None = None) -> Column:
        """The condition on blocks (term, segment, impact) that the best top_k documents can be in; one job over the first blocks."""
        mine = F.col("term").isin(*weights)
        if min(weights.values()) <= 0:
            return mine
        first = self._scores(weights, self.blocks().where(mine & (F.col("nth") < FIRST)), within)
        best = first.orderBy(F.desc("score")).limit(top_k).agg(F.min("score"), F.count("*")).first()
        if best[1] < top_k:
            return mine
        # impacts hold for the average length at writing; where that has grown since, a posting gives up to so much more
        grown = {s.number: (K1 + 1) * max(1.0, self.manifest.avgdl / max(s.avgdl, 1e-9)) for s in self.manifest.segments}
        tops = self.blocks().where(mine & (F.col("nth") == 0)).groupBy("term", "segment").agg(F.max("impact").alias("impact")).collect()  # terms * segments
        most: dict[str, float] = {}
        for r in tops:
            most[r.term] = max(most.get(r.term, 0.0), weights[r.term] * r.impact * grown[r.segment])
        reach, out = sum(most.values()), F.lit(False)
        for r in tops:
            spare = best[0] - 1e-8 - (reach - most[r.term])
            least = spare / (weights[r.term] * grown[r.segment])
            if least <= r.impact:
                out = out | ((F.col("term") == r.term) & (F.col("segment") == r.segment) & (F.col("impact") >= least))
        return out

    def search(self, query: str | Query, top_k: int = 10, within: DataFrame | None = None) -> DataFrame:
        """rank, id, score of the best top_k, of the ids within (one column, id) if given."""
        weights = self.weights(bm25.query_terms(query))
        if not weights:
            return bm25.ranked(self._none(f"id {self._id_type()}, score double"), top_k)
        within = None if within is None else within.select("id").distinct()
        scores = self._scores(weights, self.blocks().where(self.needed(weights, top_k, within)), within)
        return bm25.ranked(scores.where("score > 0"), top_k)

    def search_many(self, queries: DataFrame, query_id: str = "item_id", text_col: str = "text", top_k: int = 10) -> DataFrame:
        """query_id, rank, id, score for every query of a table. Each query's bound comes from the first blocks of its terms; blocks of common terms are dealt to many tasks."""
        n, mean = self.manifest.n, self.mean_idf()
        raw = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        q = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        q = q.join(self.frequencies(), "term").withColumn("weight", F.col("times") * F.when(raw < 0, EPSILON * mean).otherwise(raw)).where("weight <> 0")
        salts = F.when(F.col("df") > MANY * BLOCK, SALTS).otherwise(1)
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("salts", salts).persist()
        grown = F.create_map(*[F.lit(x) for s in self.manifest.segments for x in (s.number, (K1 + 1) * max(1.0, self.manifest.avgdl / max(s.avgdl, 1e-9)))])
        blocks = self.blocks()

        def scored(some: DataFrame, extra: Column | None = None) -> DataFrame:
            met = some.withColumn("_deal", F.xxhash64("term", "impact", "nth", "segment")).join(q.withColumnRenamed("term", "_term"), (F.col("term") == F.col("_term")) & (F.pmod("_deal", F.col("salts")) == F.col("salt")))
            met = met if extra is None else met.join(bounds, "query_id", "left").where(extra)
            x = self.postings(met, "query_id", "weight")
            return x.groupBy("query_id", "id").agg(F.sum(F.col("weight") * (K1 + 1) * _part(F.col("tf"), F.col("dl"), self.manifest.avgdl)).alias("score"))

        order = Window.partitionBy("query_id").orderBy(bm25.by_score(), "id")
        first = scored(blocks.where(F.col("nth") < FIRST)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
        tops = blocks.where("nth = 0").groupBy("term", "segment").agg(F.max("impact").alias("impact")).withColumn("impact", F.col("impact") * grown[F.col("segment")]).groupBy("term").agg(F.max("impact").alias("most"))
        reach = q.where("salt = 0").join(tops, "term").groupBy("query_id").agg(F.sum(F.col("weight") * F.col("most")).alias("reach"), F.min("weight").alias("lowest"))
        bounds = reach.join(first, "query_id", "left").where("lowest > 0").select("query_id", (F.col("least") - F.col("reach")).alias("room")).persist()
        most = tops.withColumnRenamed("term", "_t")
        able = F.col("room").isNull() | (F.col("weight") * (F.col("impact") * grown[F.col("segment")] - F.col("most")) >= F.col("room") - 1e-8)
        scores = scored(blocks.join(most, F.col("term") == F.col("_t")).drop("_t"), able).where("score > 0")
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")
