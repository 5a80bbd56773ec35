"""Operator 11: what each of five filters removes, in every order of them.

Words are exploded and counted as rows: (text, word), then text, give the totals and the distinct words. Every row of
documents gets the set of filters that it fails as five bits, and an aggregation per part counts the 32 sets, among all
rows, the good ones and the toxic ones. All 120 orders follow from these counts, whatever the number of documents.

A text that repeats is exploded once: documents are told apart by SHA-256 of their text, and each finds its text's
figures by a join. Such a group may be large, so the join reads written tables only, where Spark can split its skew.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table

FILTERS = "ABCDE"
#: Rows without doc_id have no label; the join with labels spreads them over so many keys.
SALTS = 4096


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.sha2(_text().cast("binary"), 256))


def text_figures(docs: DataFrame) -> DataFrame:
    """One row per distinct text: digest, first_doc (the smallest doc_id that has it), n_words, n_distinct.

    The texts are dealt by digest once, one of each kind from each task; the two aggregations of words keep that dealing.
    """
    texts = docs.select(_digest().alias("digest"), F.col("doc_id"), _text().alias("text")).groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.first("text").alias("text"))
    words = texts.select("digest", "first_doc", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words")).select("digest", "first_doc", F.explode_outer("words").alias("word"))
    per_word = words.groupBy("digest", "first_doc", "word").agg(F.count("word").alias("tf"))
    return per_word.groupBy("digest", "first_doc").agg(F.sum("tf").alias("n_words"), F.count("word").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, part, fails (bit i: fails filter i of FILTERS), good, toxic.

    Both joins are merge joins: the written sides grow with the corpus, and their files are far smaller than a broadcast.
    """
    figures = materialize(text_figures(docs))
    known = materialize(
        labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        .select(F.col("doc_id").alias("_labelled"), F.lit(0).cast("long").alias("_no"), "good", "toxic")
    )
    capitals = 100 * F.regexp_count(_text(), F.lit("[A-Z]")).cast("long") > 10 * F.length(_text()).cast("long")
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), _digest().alias("digest"), capitals.alias("capitals"), _text().rlike("[#$%&*|]").alias("symbols"))
    rows = rows.join(figures.hint("merge"), "digest", "left")
    failed = [F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"), F.col("capitals"), F.col("symbols"), F.coalesce(F.col("first_doc") < F.col("doc_id"), F.lit(False))]
    mask = reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)])
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", F.rand(11)), F.lit(SALTS))).otherwise(0).cast("long")
    rows = rows.select("doc_id", "part", mask.alias("fails"), salt.alias("_salt"))
    out = rows.join(known.hint("merge"), (F.col("doc_id") == F.col("_labelled")) & (F.col("_salt") == F.col("_no")), "left")
    return out.select("doc_id", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _total(counts: Column, wanted) -> Column:
    """Sum of the counts of the sets that `wanted` accepts."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(wanted(m), F.get(counts, m)).otherwise(F.lit(0).cast("long")))


def _steps() -> list[dict]:
    """The steps of every order: the filter's own bit, and the bits of those before it."""
    return [
        {"filter_order": "".join(FILTERS[x] for x in order), "step": i + 1, "own": 1 << f, "before": sum(1 << x for x in order[:i])}
        for order in permutations(range(len(FILTERS))) for i, f in enumerate(order)
    ]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: see op11_filter_audit.

    docs needs doc_id, text, lang, labels doc_id, quality, toxic; other columns are ignored. Null texts are empty, null
    and empty lang are one part, and repeated rows count each. Without a doc_id a row has no label, no earlier copy, and
    is none. A document is good (toxic) if any of its labels says so. An empty table gives no row.
    """
    rows = failures(docs, labels)
    sets = range(32)
    count = lambda m, also: F.count_if((F.col("fails") == m) & also)
    per_part = rows.groupBy("part").agg(
        *[count(m, F.lit(True)).alias(f"all_{m}") for m in sets], *[count(m, F.col("good")).alias(f"good_{m}") for m in sets], *[count(m, F.col("toxic")).alias(f"toxic_{m}") for m in sets]
    )
    packed = materialize(per_part.select("part", *[F.array(*[f"{kind}_{m}" for m in sets]).alias(kind) for kind in ("all", "good", "toxic")]))
    plan = packed.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order string, step int, own int, before int>>"))).select("*", "s.*")
    own, before = F.col("own"), F.col("before")
    fails = lambda m, which: m.bitwiseAND(which) != 0
    here = lambda m: fails(m, own) & ~fails(m, before)
    # over all orders, a filter comes first among the k filters of a set in 120 / k of them
    orders = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(fails(m, own), F.get("all", m) * F.floor(F.lit(120) / F.bit_count(m))).otherwise(F.lit(0).cast("long")))
    return plan.select(
        "part", "filter_order", "step", _total(F.col("all"), lambda m: ~fails(m, own.bitwiseOR(before))).alias("kept"), _total(F.col("all"), here).alias("removed"),
        _total(F.col("all"), lambda m: fails(m, own) & fails(m, before)).alias("redundant"), F.get("all", own).alias("unique_fails"),
        _total(F.col("good"), here).alias("good_lost"), _total(F.col("toxic"), here).alias("toxic_lost"), orders.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, order and step over all `documents` and `labels`: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_doc FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first_doc < w.doc_id, false)] AS f,
   coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, f),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string([substr('ABCDE', x, 1) for x in o], '') AS filter_order, CAST(i AS INTEGER) AS step, o[i] AS own, o[1:i - 1] AS before FROM o, i),
j AS (SELECT part, filter_order, step, own, n, g, x, f[own] AS hit, len([b for b in before if f[b]]) > 0 AS gone, f = [k = own for k in [1, 2, 3, 4, 5]] AS alone FROM s, c),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
   coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(g) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM j GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
   CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
