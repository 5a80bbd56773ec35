"""Operator 9: best-fit-decreasing packing of tokenized documents into sequences.

Lengths are whole numbers from 1 to max_tokens, so the exact best-fit-decreasing result depends on the histogram of
lengths alone. The driver packs the histogram (at most max_tokens counts, whatever the corpus size) with a segment tree
over remaining capacities; each piece then finds its place by its rank among the pieces of its length, so no task and
no driver step ever holds the pieces themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that are ranked together, on average.
RANK_BUCKET = 5_000
#: Entries of a worker's cache of encoded word units.
CACHE = 400_000


class SegmentTree:
    """Which capacities have an open bin; first(c) is the smallest such capacity that is at least c, in O(log n)."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def first(self, c: int) -> int | None:
        i = c + self.size
        if self.open[i]:
            return c
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}.

    Returns (length, rank_from, rank_to, first_sequence, offset): the pieces of that length with these ranks go to
    consecutive sequences from first_sequence on, at the offset. Bins of equal remaining capacity stay together as
    ranges; the result has the bins that packing piece by piece would have.
    """
    tree, bins = SegmentTree(capacity), [[] for _ in range(capacity + 1)]  # capacity -> [(first sequence, bins)]
    plan, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            bins[left].append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            left = tree.first(length)
            if left is None:
                left, first, n = capacity, opened, -(-(count - rank) // (capacity // length))
                opened += n
            else:
                first, n = bins[left].pop()
                if not bins[left]:
                    tree.set(left, False)
            fill, todo = left // length, count - rank
            full = min(n, todo // fill)
            for slot in range(fill if full else 0):
                plan.append((length, rank, rank + full, first, capacity - left + slot * length))
                rank += full
            put(left - fill * length, first, full)
            if full < n:
                rest = count - rank
                for slot in range(rest):  # fewer than fill: they meet in one bin
                    plan.append((length, rank, rank + 1, first + full, capacity - left + slot * length))
                    rank += 1
                put(left - rest * length, first + full, 1 if rest else 0)
                put(left, first + full + (1 if rest else 0), n - full - (1 if rest else 0))
    return plan


def make_encoder(name: str = "byte_bpe_50k", marks_as_text: bool = False):
    """text -> little-endian 32-bit ids as bytes, as the tokenizer in `name`.json gives them without adding special tokens.

    The same merges in tiktoken's form take a fifth of the time. Texts that hold a token which the JSON file adds to the
    merges, such as an end-of-text mark, go to the JSON file's own tokenizer, which gives that token's id (marks_as_text: the
    ids of its letters). Any other text whose white space stands
    alone splits at each single space into units on whose edges no token crosses; units recur, so their ids are kept.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    whole.encode_special_tokens = marks_as_text
    added = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or r"(?!)").search

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    wide = re.compile(r"\s\s").search

    class Units(dict):
        def __missing__(self, unit: str) -> bytes:
            if len(self) >= CACHE:
                self.clear()
            ids = np.array(encode(unit), "<u4").tobytes()
            if len(unit) < 64:
                self[unit] = ids
            return ids

    units = Units()

    def ids_of(text: str) -> bytes:
        if added(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if wide(text) or not text:
            return np.array(encode(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return b"".join([units[head] if head else b"", *[units[" " + x] for x in rest]])

    return ids_of


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole when they fit, else full pieces after a shorter first one."""
    first = n % most or most
    return [(0, min(n, first)), *((s, most) for s in range(first, n, most))]


def tokenize_pieces(docs: DataFrame, max_tokens: int = 2048, end_id: int = 0, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Tokenize whole texts (null: empty), append end_id, cut what is longer than max_tokens. One row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = make_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                out += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, max_tokens))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Give every row of a written table with a `length` (1 to max_tokens) a sequence_id and an offset.

    Ties (equal lengths) are ranked by doc_id, piece, start and checksum; equal rows are interchangeable.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    # as many buckets as a length needs; the table of them has max_tokens rows at most
    buckets = spark.createDataFrame([(length, n // RANK_BUCKET + 1) for length, n in counts.items()], "length long, _n long")
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("_n"))).drop("_n")
    before = keyed.groupBy("length", "_b").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        keyed.join(before.select("length", "_b", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_b"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    )
    plan: dict[int, list] = {}
    for length, low, high, first, offset in plan_best_fit(counts, max_tokens):
        plan.setdefault(length, []).append((low, high, first, offset))
    arrays = {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in plan.items()}
    shared = spark.sparkContext.broadcast(arrays)  # bounded by max_tokens * ln(max_tokens) entries, whatever the corpus size

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                low, _, first, where = shared.value[int(n)]
                i = np.searchsorted(low, rank[at], "right") - 1
                sequence[at], offset[at] = first[i] + rank[at] - low[i], where[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in schema.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, max_tokens: int = 2048, end_id: int = 0, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Pack documents (doc_id, text; other columns are ignored) into sequences of at most max_tokens ids.

    Null and empty texts are one id, end_id. Null doc_ids and repeated rows are packed like any others. An empty table
    gives an empty result.
    """
    return pack(materialize(tokenize_pieces(docs, max_tokens, end_id, tokenizer)), max_tokens)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every row of documents; nulls, empty texts and repeated rows as in best_fit_packing()."""
    return best_fit_packing(table(spark, sf_dir, "documents"))
