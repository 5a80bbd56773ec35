"""Operator 1 [native]: mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order that the seed fixes, once per pass. A queued document's virtual
finish time is the number of its source's words up to its end, divided by the source's weight. All queued documents are
sorted by finish time over ranges of it, and the mix is what comes before the budget of words is spent; the document at
the cut is taken in part. A source whose passes are over has no more documents to finish, so the others share what it
leaves, and each source ends within a document of its target.

All prefix sums are taken in two levels (totals of ranges, then rows inside one range), so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, table

#: Rows of one range of a source's queue, on average.
RANGE_ROWS = 4_000
#: Repeats of one row that are made at a time.
CHUNK = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, passes: int = 2) -> DataFrame:
    """source, source_size -> weight, target, level: the budget (times all sizes) shared by weight, at most passes * size each.

    Sources in order of code points, null last, take the weights in turn. Sources whose share would exceed their limit
    are the ones with the smallest limit per weight; the first prefix of that order that leaves the rest below their
    limits is the result of resharing until none is above. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    x = sizes.withColumn("weight", w).withColumn("limit", (F.col("source_size") * passes).cast("long"))
    x = x.withColumn("_total", F.lit(budget) * F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    x = x.withColumn("_spent", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_weights"))
    fits = F.col("_level") * F.col("weight") <= F.col("limit")
    x = x.withColumn("level", F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (share > F.col("limit")), F.col("limit").cast("double")).otherwise(share)
    return x.select("source", "source_size", "weight", target.alias("target"))


def shuffle_key(seed: str = "mix") -> Column:
    """The place of a document in its source's shuffled order: MD5 of seed, doc_id and text. Equal documents share it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("|"), text))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _before(df: DataFrame, keys: list[str], at: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add the sum of `value` over the rows before each row in (range number `at`, order) within keys; drops `at`."""
    df = df.withColumn("_value", value)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, at).agg(F.sum("_value").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return df.join(totals, [*keys, at]).withColumn(out, F.col("_base") + F.col("_own")).drop("_base", "_own", "_value", at)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document and pass: doc_id, key, copy, source, size, source_size, target, pass, virtual_finish, position, taken.

    docs needs doc_id, text, source; other columns are ignored. `position` is the number of words before the row in the
    order of finish times (ties by source, place in its queue); taken is what the budget leaves of its size. Rows with
    taken = 0 are not in the mix but stay in the result. Null texts have size 0, null sources form a source of their
    own, null doc_ids are kept apart by their texts, and rows equal in doc_id, text and source by their number `copy`. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), shuffle_key(seed).alias("key"))
    rows = materialize(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")))  # equal rows stand together in the queue
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sizes.select("source", "source_size"), weights, budget, passes)
    known = targets.join(sizes.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_key", _source_key())
    known = materialize(known)
    rows = rows.withColumn("_key", _source_key()).join(known.drop("source"), "_key")

    # Place in the source's queue: ranges of the shuffled order, so many that each holds about RANGE_ROWS rows.
    part = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")  # 28 bits, evenly spread
    rows = rows.withColumn("_at", F.floor(part * (F.floor(F.col("_rows") / RANGE_ROWS) + 1) / F.lit(1 << 28)))
    queued = _before(rows, ["_key"], "_at", [F.col("key"), F.col("doc_id"), F.col("size")], F.col("size") * F.col("copies"), "_start")
    queued = queued.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    start = F.col("_start") + F.col("copy") * F.col("size") + F.col("pass") * F.col("source_size")
    queued = queued.withColumn("_start", start).withColumn("virtual_finish", (F.col("_start") + F.col("size")) / F.col("weight"))

    # The global order: a range sort by finish time, written with the number of each range.
    order = [F.col("virtual_finish"), F.col("_key"), F.col("_start"), F.col("key"), F.col("doc_id")]
    sorted_ = materialize(queued.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).drop("_rows", "copies"))
    placed = _before(sorted_, [], "_range", order, F.col("size"), "position")
    words = known.agg(F.sum("source_size")).first()[0] or 0
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(int(budget * words)) - F.col("position"))).cast("long")
    return placed.select("doc_id", "key", "copy", "source", "size", "source_size", "target", (F.col("pass") + 1).alias("pass"), "virtual_finish", "position", taken.alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """docs as the mix takes them, whole documents: a row per pass of which at least half of the words are taken.

    A document without words stays once. All columns stay. Rows equal in doc_id, text and source share what the mix takes
    of them: those equal in all columns are one row that is repeated; among others the smaller hash comes first.
    """
    some = (F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size")) | ((F.col("size") == 0) & (F.col("pass") == 1))
    times = mix(docs, seed=seed, **options).groupBy("key", "source").agg(F.sum(some.cast("long")).alias("_times"), F.max("copy").alias("_last"))
    times = materialize(times.where("_times > 0").select(F.col("key").alias("_k"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"), "_times", "_last"))
    mine = docs.select(F.struct(*docs.columns).alias("_row"), shuffle_key(seed).alias("_key"), _source_key().alias("_source"))
    same = (F.col("_key") == F.col("_k")) & (F.col("_source") == F.col("_s"))
    single = mine.join(times.where("_last = 0"), same).select("_row", "_times")
    several = times.where("_last > 0")
    if not several.isEmpty():
        row_hash = F.xxhash64(*[F.col("_row").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
        alike = mine.join(several, same).groupBy("_k", "_s", "_times", "_last", row_hash.alias("_hash")).agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
        ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_k", "_s").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each, rest = F.floor(F.col("_times") / (F.col("_last") + 1)), F.col("_times") % (F.col("_last") + 1)
        alike = alike.withColumn("_ahead", ahead).select("_row", (each * F.col("_n") + F.greatest(F.lit(0), F.least(F.col("_n"), rest - F.col("_ahead")))).alias("_times"))
        single = single.unionByName(alike.where("_times > 0"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / CHUNK)))
    out = single.select("_row", "_times", chunks.alias("_chunk"))
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK), F.col("_times") - F.col("_chunk") * CHUNK)))).select("_row.*")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with the words that the mix takes of it over all passes; nulls as in mix()."""
    rows = mix(table(spark, sf_dir, "documents"))
    out = rows.groupBy("doc_id", "key", "copy", "source", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
   AS total, CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS spent,
   CAST(sum(weight) OVER (ORDER BY 2 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights FROM w),
l AS (SELECT *, (total - spent) / weights AS own FROM r),
v AS (SELECT arg_min(own, 2 * source_size / weight) AS level FROM l WHERE own * weight <= 2 * source_size),
t AS (SELECT source, source_size, weight, total, CASE WHEN level IS NULL OR level * weight > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target FROM l LEFT JOIN v ON true),
q AS (SELECT d.r, d.doc_id, d.source, d.size, d.o, t.source_size, t.target, t.weight, t.total, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size, d.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, b + pass * source_size AS start, CAST(b + pass * source_size + size AS DOUBLE) / weight AS finish FROM q, (VALUES (0), (1)) passes(pass)),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, coalesce('s' || source, 'n'), start, o, doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM p)
SELECT doc_id, source, size, source_size, target, CAST(sum(greatest(0, least(size, floor(total) - position))) AS BIGINT) AS taken FROM c GROUP BY r, doc_id, source, size, source_size, target
"""
