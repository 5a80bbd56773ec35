"""Operator 10: SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits link at max_bits or fewer differing bits. They are cut into max_bits + 1 segments placed on a
ring. By the pigeonring principle, two linked fingerprints have a segment from which on every chain of l consecutive
segments differs in at most l * max_bits / (max_bits + 1) bits (rounded down): the first segment is equal, the first two
differ in at most 1 bit, the first three in at most 2, and so on. Chains of two give the join keys; longer chains prune
what meets under a key before the full check. A key's fingerprints (distinct ones: copies are folded first) are searched
for connections by breadth-first search, which emits a spanning forest instead of all pairs, so links of a large group
of near copies stay linear in its size. Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, materialize, table

_ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a text: a bit is 1 if over half of the shingles' XXH64 (seed 42) have it. No words: 0."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z and splits at \x20 and \x09-\x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    hash64 = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[len(ends) - n :].tolist(), strict=True)
    h = np.array([hash64(joined[a:b], 42) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # long texts: bounded memory
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the 64 bits as a signed long) for each row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, key long, fp long")


def _segments(max_bits: int) -> tuple[list[int], list[int]]:
    """Shifts and widths of max_bits + 1 segments of 64 bits."""
    m = max_bits + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [sum(widths[:i]) for i in range(m)], widths


def _keys(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, bool]]:
    """(keys, stored) of chains of two: the first segment exact, the second as it is (stored) or with one bit flipped."""
    shifts, widths = _segments(max_bits)
    m = len(shifts)
    cut = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(shifts, widths, strict=True)]
    for i in range(m):
        j = (i + 1) % m
        head = (np.uint64(i) << np.uint64(widths[i] + widths[j])) | (cut[i] << np.uint64(widths[j]))
        yield head | cut[j], True
        for bit in range(widths[j] if max_bits else 0):
            yield head | (cut[j] ^ (_ONE << np.uint64(bit))), False


def chain_ok(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Pigeonring test of xor values: some start has every chain of l segments within l * max_bits / m bits."""
    shifts, widths = _segments(max_bits)
    m = len(shifts)
    d = [np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(shifts, widths, strict=True)]
    found = np.zeros(len(x), bool)
    for i in range(m):
        ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for length in range(1, m + 1):
            total += d[(i + length - 1) % m]
            ok &= total * m <= length * max_bits
        found |= ok
    return found


def spanning_edges(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect exactly the fingerprints connected by links within fps (distinct values)."""
    rest, out = fps.copy(), []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            f = frontier.pop()
            x = rest ^ f
            near = np.bitwise_count(x) <= max_bits if len(rest) < 64 else _pruned(x, max_bits)
            if near.any():
                new = rest[near]
                out.append((np.full(len(new), f, np.uint64), new))
                frontier.extend(new)
                rest = rest[~near]
    return out


def _pruned(x: np.ndarray, max_bits: int) -> np.ndarray:
    near = np.zeros(len(x), bool)
    maybe = np.flatnonzero(chain_ok(x, max_bits))
    near[maybe] = np.bitwise_count(x[maybe]) <= max_bits
    return near


def link_edges(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect whatever chains of links connect."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 2048):
                f = all_fps[at : at + 2048]
                parts = [(k, s) for k, s in _keys(f, max_bits)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in parts]).view(np.int64)), pa.array(np.tile(f, len(parts)).view(np.int64)), pa.array(np.repeat([s for _, s in parts], len(f)))], names=["key", "fp", "stored"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps_, stored = (np.empty(0, t) for t in (np.int64, np.uint64, bool))

        def groups(k, f, s):
            if not len(k):
                return
            bounds = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(bounds, len(k)))
            some = np.add.reduceat(s.astype(np.int64), bounds) > 0
            a, b = [], []
            two = bounds[some & (sizes == 2)]
            near = np.bitwise_count(f[two] ^ f[two + 1]) <= max_bits
            a.append(f[two][near])
            b.append(f[two + 1][near])
            for at, n in zip(bounds[some & (sizes > 2)].tolist(), sizes[some & (sizes > 2)].tolist(), strict=True):
                for x, y in spanning_edges(f[at : at + n], max_bits):
                    a.append(x)
                    b.append(y)
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps_ = np.concatenate([fps_, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            stored = np.concatenate([stored, batch.column(2).to_numpy(zero_copy_only=False)])
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on
            yield from groups(keys[:last], fps_[:last], stored[:last])
            keys, fps_, stored = keys[last:], fps_[last:], stored[last:]
        yield from groups(keys, fps_, stored)

    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = fps.select("fp").mapInArrow(expand, "key long, fp long, stored boolean")
    return wide.repartition(n, "key").sortWithinPartitions("key").mapInArrow(links, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b) that is not the root itself: alternating large-star and small-star until nothing changes.

    root is the smallest node value of the component. Each round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    stamp = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    while before != (mark := tuple(stamp(now))):
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        old, now = now, materialize(small)
        drop_tables(edges.sparkSession, old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, key, fp, root, component_id.

    root is one for each component, key hashes the text.

    component_id is the smallest doc_id reachable over links (null doc_ids are ignored; null if there is no other).
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows give repeated rows; columns other
    than doc_id and text are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected(link_edges(distinct, max_bits))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    class_of = named.join(lows, "root").select("fp", "root", "component_id")
    return prints.join(class_of, "fp").select("doc_id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (null last), then the smallest hash of the text.

    All columns stay. Of rows equal in doc_id and text one stays, chosen by a hash of the other columns.
    """
    near = simhash_components(docs, shingle, max_bits).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("i"), F.col("key").alias("k"), "n")).alias("first"))
    first = materialize(first.select(F.col("first.i").alias("_i"), F.col("first.k").alias("_k"), F.col("first.n").alias("_n")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))
    again = first.where("_n > 1")
    if again.isEmpty():
        return x.join(first, same, "left_semi").select("_row.*")
    # only the rows that have copies are shuffled to leave one of them
    order = F.xxhash64(*[F.col("_row").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
    one = x.join(again, same, "left_semi").groupBy("_id", "_key").agg(F.min_by("_row", order).alias("_row"))
    return x.join(first.where("_n = 1"), same, "left_semi").select("_row").union(one.select("_row")).select("_row.*")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of documents; nulls and repeats as in simhash_components()."""
    x = simhash_components(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
