"""Operator 5: quality classifier by perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted text (labels with quality = 1), lower-cased, over words hashed to 2**VOCAB_BITS ids.
Everything per word id (context totals, continuation counts, interpolation weights) is an array of that fixed size;
bigram counts grow with the corpus, so they are sharded by bigram. Each document's bigrams travel once, packed per block
of text and shard, to the shard that has their counts; shards send back partial log-likelihoods per document.

A fifth of the trusted documents is held out of training; a language's threshold is a quantile of their perplexities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, materialize, n_words, span_hashes, table, text_blocks, word_spans

VOCAB_BITS = 18
#: Text bytes whose bigrams one shard serves.
SHARD_BYTES = 48 << 20
#: Share of held-out trusted documents of a language whose perplexity is within its threshold, and the slack on top.
QUANTILE, SLACK = 0.98, 1.15
#: The log of a threshold also grows by CHANCE / sqrt(words): a short text's mean strays further by chance.
CHANCE = 6.0
#: Trusted doc_ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000
_V = 1 << VOCAB_BITS


def _bigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigram keys, text number) of every word; the id _V stands before a text's first word."""
    begin, end = word_spans(data)
    ids = (span_hashes(data, begin, end) >> np.uint64(64 - VOCAB_BITS)).astype(np.uint64)
    doc = np.searchsorted(starts, begin, "right") - 1
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    first = np.ones(len(ids), bool)
    first[1:] = doc[1:] != doc[:-1]
    before[first] = _V
    return (before << np.uint64(VOCAB_BITS)) | ids, doc


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: lengths and types, then the bytes; the first is ascending and kept as steps."""
    import pickle

    import zstandard

    first = arrays[0].copy()
    first[1:] -= arrays[0][:-1]
    # bytes of equal weight together compress far better than whole integers
    planes = first.view(np.uint8).reshape(-1, first.itemsize).T.copy() if len(first) else first.view(np.uint8)
    return zstandard.ZstdCompressor(1).compress(pickle.dumps((str(first.dtype), len(first), planes.tobytes(), [(str(a.dtype), a.tobytes()) for a in arrays[1:]])))


def _unpack(value: bytes) -> list[np.ndarray]:
    import pickle

    import zstandard

    kind, n, planes, rest = pickle.loads(zstandard.ZstdDecompressor().decompress(value))
    size = np.dtype(kind).itemsize
    first = np.frombuffer(planes, np.uint8).reshape(size, n).T.copy().view(kind).ravel() if n else np.empty(0, kind)
    return [np.cumsum(first, dtype=kind), *(np.frombuffer(b, t) for t, b in rest)]


def _counts(trusted: DataFrame, shards: int) -> DataFrame:
    """Sharded bigram counts (shard, data = packed keys and counts) of the training texts, one row per shard."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, starts, _ in text_blocks(batches, lower=True):
            keys, n = np.unique(_bigrams(data, starts)[0], return_counts=True)
            shard = _shard(keys, shards)
            rows = [(int(s), _pack(keys[shard == s], n[shard == s].astype(np.uint32))) for s in np.unique(shard)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(*total)], pa.binary())], names=["shard", "data"])

        now, total, waiting, size = None, (np.empty(0, np.uint64), np.empty(0, np.uint32)), [], 0

        def join():
            nonlocal total, waiting, size
            keys = np.concatenate([total[0], *(w[0] for w in waiting)])
            n = np.concatenate([total[1], *(w[1] for w in waiting)])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
            total, waiting, size = (keys[at], np.add.reduceat(n, at) if len(at) else n), [], 0

        for batch in batches:
            for shard, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if now is not None:
                        join()
                        yield flush()
                    now, total, waiting, size = shard, (np.empty(0, np.uint64), np.empty(0, np.uint32)), [], 0
                waiting.append(_unpack(value.as_py()))
                size += len(waiting[-1][0])
                if size > 2_000_000:
                    join()
        if now is not None:
            join()
            yield flush()

    return trusted.select(F.col("text").cast("string").cast("binary")).mapInArrow(emit, "shard int, data binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(merge, "shard int, data binary")


def _per_word(counts: DataFrame) -> DataFrame:
    """id, and sums over the bigrams that it starts (total, ones, twos, more, threes, fours) or ends (kinds): at most _V + 1 rows."""
    names = ("total", "ones", "twos", "more", "threes", "fours", "kinds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                keys, n = _unpack(value.as_py())
                v, w = (keys >> np.uint64(VOCAB_BITS)).astype(np.int64), (keys & np.uint64(_V - 1)).astype(np.int64)
                sums = [np.bincount(v, x, _V + 1) for x in (n.astype(float), n == 1, n == 2, n > 2, n == 3, n == 4)] + [np.bincount(w, minlength=_V + 1)]
                at = np.flatnonzero((sums[0] > 0) | (sums[6] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(s[at].astype(np.int64)) for s in sums)], names=["id", *names])

    rows = counts.select("data").mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, kept within [0, count]; absolute ones where a count of counts is missing."""
    if min(n1, n2, n3, n4) <= 0:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def fit(per_word: DataFrame) -> dict:
    """The model's arrays of fixed size: context totals, back-off weights, lowest-order probabilities, discounts."""
    x = per_word.toPandas()  # at most 2**VOCAB_BITS + 1 rows
    a = {c: np.bincount(x["id"], x[c], _V + 1) if len(x) else np.zeros(_V + 1) for c in x.columns if c != "id"}
    d = _discounts(*(a[c].sum() for c in ("ones", "twos", "threes", "fours")))
    total = a["total"]
    back = np.divide(d[0] * a["ones"] + d[1] * a["twos"] + d[2] * a["more"], total, out=np.ones(_V + 1), where=total > 0)
    kinds = a["kinds"][:_V]
    e = _discounts(*((kinds == k).sum() for k in (1, 2, 3, 4)))
    all_kinds = kinds.sum()
    if all_kinds:
        taken = np.select([kinds == 1, kinds == 2, kinds > 2], e, 0.0)
        low = (kinds - taken) / all_kinds + taken.sum() / all_kinds / _V
    else:
        low = np.full(_V, 1 / _V)
    return {"total": total.astype(np.float32), "back": back.astype(np.float32), "low": low.astype(np.float32), "d": d}


def log_probability(keys: np.ndarray, counts: np.ndarray, model: dict) -> np.ndarray:
    """Natural log of p(word | word before) for bigram keys with these training counts."""
    v, w = (keys >> np.uint64(VOCAB_BITS)).astype(np.int64), (keys & np.uint64(_V - 1)).astype(np.int64)
    total = model["total"][v].astype(float)
    off = np.select([counts == 0, counts == 1, counts == 2], [0.0, model["d"][0], model["d"][1]], model["d"][2])
    direct = np.divide(np.maximum(counts - off, 0.0), total, out=np.zeros(len(keys)), where=total > 0)
    return np.log(direct + model["back"][v] * model["low"][w])


def _partial_sums(docs: DataFrame, counts: DataFrame, model: dict, shards: int) -> DataFrame:
    """key, logp, n: sums over the bigrams of the documents with that key that a shard serves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # arrays of fixed size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), data, starts, _ in text_blocks(batches, lower=True):
            keys, doc = _bigrams(data, starts)
            order = np.lexsort((doc, keys)) if len(starts) > 1 << 20 else np.argsort((keys << np.uint64(20)) | doc.astype(np.uint64))
            keys, doc = keys[order], doc[order]
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))))
            n = np.diff(np.append(at, len(keys)))
            keys, doc, shard = keys[at], doc[at].astype(np.uint32), _shard(keys[at], shards)
            names = key.to_numpy(zero_copy_only=False)
            rows = []
            for s in np.unique(shard):
                of = np.flatnonzero(shard == s)
                used, local = np.unique(doc[of], return_inverse=True)
                small = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                repeat = n[of]
                rows.append((int(s), _pack(keys[of], small, repeat.astype(np.uint8 if repeat.max() < 256 else np.uint32), names[used])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "kind", "data"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, known = shared.value, None, (np.empty(0, np.uint64), np.empty(0, np.uint32))
        for batch in batches:
            for shard, kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != now:
                    now, known = shard, (np.empty(0, np.uint64), np.empty(0, np.uint32))
                if kind == 0:
                    known = _unpack(value.as_py())
                    continue
                keys, doc, n, names = _unpack(value.as_py())
                at = np.searchsorted(known[0], keys)
                hit = at < len(known[0])
                hit[hit] = known[0][at[hit]] == keys[hit]
                count = np.zeros(len(keys))
                count[hit] = known[1][at[hit]]
                logp = np.bincount(doc, log_probability(keys, count, model) * n, len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(logp), pa.array(np.bincount(doc, n, len(names)).astype(np.int64))], names=["key", "logp", "n"])

    rows = docs.mapInArrow(emit, "shard int, kind int, data binary")
    both = rows.unionByName(counts.select("shard", F.lit(0).alias("kind"), "data"))
    return both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(score, "key long, logp double, n long")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, chance: float = CHANCE) -> DataFrame:
    """doc_id, lang, key, n_words, perplexity, threshold, accepted: one row per document.

    Trusted text: documents whose doc_id has a label with quality = 1. A document is accepted if its perplexity is
    within its language's threshold; a language (null is one) without held-out trusted documents takes the quantile
    over all of them. Documents without words are rejected with null perplexity. If no trusted document is held out,
    every document with words is accepted. Equal rows are scored alike; further columns are ignored; an empty table
    gives an empty result. `key` hashes doc_id and text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held out")), F.lit(5)) == 0
    base = docs.select("doc_id", "lang", "key", n_words("text").alias("n_words"), F.octet_length("text").alias("_bytes"))
    base = materialize(base.join(trusted, base.doc_id == trusted["_id"], "left").withColumn("trusted", F.col("_id").isNotNull()).drop("_id"))
    size = base.agg(F.sum("_bytes")).first()[0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    # only few trusted ids are broadcast; with more of them the texts are shuffled to meet them
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    learn = docs.where(~held).join(F.broadcast(trusted) if few else trusted, docs.doc_id == trusted["_id"], "left_semi")
    counts = materialize(_counts(learn, shards))
    model = fit(_per_word(counts))
    parts = _partial_sums(docs.select("key", F.col("text").cast("binary")), counts, model, shards)
    sums = parts.groupBy("key").agg(F.sum("logp").alias("logp"), F.sum("n").alias("n"))
    scored = base.join(sums, "key", "left").withColumn("perplexity", F.round(F.exp(-F.col("logp") / F.col("n")), 4))
    scored = materialize(scored.select("doc_id", "lang", "key", "n_words", "perplexity", (F.col("trusted") & held).alias("_held")))
    drop_tables(docs.sparkSession, counts, base)
    tested = scored.where("_held and perplexity is not null")
    by_lang = tested.groupBy("lang").agg((F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)) * slack).alias("_own")).withColumnRenamed("lang", "_lang")
    overall = tested.agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)) * slack).first()[0]
    overall = float("inf") if overall is None else overall
    salts = 32  # a language may hold most rows
    by_lang = by_lang.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = F.col("lang").eqNullSafe(F.col("_lang")) & (F.pmod(F.col("key"), F.lit(salts)) == F.col("_salt"))
    out = scored.join(by_lang, mine, "left")
    out = out.withColumn("threshold", F.coalesce("_own", F.lit(overall)) * F.exp(F.lit(chance) / F.sqrt(F.greatest("n_words", F.lit(1)))))
    return out.select("doc_id", "lang", "key", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that the classifier rejects; all columns stay."""
    rejected = classify(docs, labels, **options).where(~F.col("accepted")).select(F.col("key").alias("_k")).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key")).join(rejected, F.col("_key") == F.col("_k"), "left_anti").select("_row.*")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents, trained on labels; nulls, repeats and empty tables as in classify()."""
    x = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return x.select("doc_id", "lang", "n_words", "perplexity", "threshold", "accepted")
