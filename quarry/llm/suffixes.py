"""Operator 3: exact removal of repeated byte strings with suffix arrays sorted in two stages.

Every string of `length` bytes has an anchor: the smallest hash among its substrings of `gram` bytes. Consecutive strings
of a text with one anchor form a run. Equal strings have equal anchors, so strings can be compared anchor by anchor:

1. texts are packed into blocks; blocks send their distinct anchors to shards, which tell each block its shared ones;
2. blocks send the distinct runs with shared anchors, with the smallest doc_id that holds each;
3. shards build suffix arrays over the runs in two stages, and adjacent common prefixes give, for each string, the
   smallest doc_id that holds it;
4. blocks mark the strings that a smaller doc_id also holds, and remove the bytes they cover.

A block sends an anchor or a run once, however many of its documents hold it, so a passage in many documents costs a
shard one entry per block. Blocks and what they exchange are packed binary values; nothing is collected to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, materialize, mix, span_hashes, table
from .perplexity import _pack, _shard, _unpack

#: Bytes of text in a block, bytes of text whose anchors one shard serves, and bytes of runs in one suffix array.
BLOCK_BYTES, SHARD_BYTES, ARRAY_BYTES = 2 << 20, 24 << 20, 2 << 20
_NONE = -(1 << 63)


# ---- suffix arrays ------------------------------------------------------------------------------


def _words_at(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The eight bytes from at + 8k on as big-endian numbers; text is padded."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at + 8 * k].view(">u8").ravel().astype(np.uint64)


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes of text (uint8) in the order of their first `depth` bytes or more.

    Suffixes smaller than their successors are sorted directly; the others follow from a scan of the buckets of first
    bytes in order: each suffix met puts the one before it, if that is greater, at the end of its bucket's front part.
    """
    n = len(text)
    text = np.concatenate([text, np.array([0, 1], np.uint8)])  # the first added byte is smaller than its successor
    # type: compare with the next byte; in a run of equal bytes all take the type of the last
    differs = text[:-1] != text[1:]
    last = np.where(differs, np.arange(n + 1), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    small = text[last] < text[last + 1]
    need = np.zeros(n + 1, bool)
    need[wanted] = True
    # a greater suffix needs its successor, and so on up to the next smaller one
    stop = np.where(small, np.arange(n + 1), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    greater = wanted[~small[wanted]]
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, greater, 1)
    np.add.at(mark, stop[greater] + 1, -1)
    need |= np.cumsum(mark[: n + 1]) > 0
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    direct = np.flatnonzero(need & small)
    keys = [_words_at(padded, direct, k) for k in range(-(-depth // 8))]
    direct = direct[np.lexsort(keys[::-1])]
    cut = np.searchsorted(text[direct], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        before = before[need[before] & ~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        same = np.empty(0, np.int64)
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(first)), bool), first[1:] != first[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(first)), strict=False):
            if first[a] == c:
                same = before[a:b]
            else:
                fronts[first[a]].append(before[a:b])
        return same

    for c in range(256):
        front = np.concatenate(fronts[c]) if fronts[c] else np.empty(0, np.int64)
        while len(front):
            out.append(front)
            front = induce(front, c)
        back = direct[cut[c] : cut[c + 1]]
        if len(back):
            out.append(back)
            induce(back, c)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    asked = np.zeros(n + 1, bool)
    asked[wanted] = True
    return order[asked[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, at most depth; 0 for the first."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(-(-depth // 8)):
        x = _words_at(padded, order[live], k) ^ _words_at(padded, order[live - 1], k)
        same = np.full(len(x), 8, np.int64)
        for byte in range(8):
            same[(x >> np.uint64(8 * byte)) > 0] = 7 - byte
        lcp[live] += same
        live = live[same == 8]
    return np.minimum(lcp, depth)


def smallest_holders(runs: list[bytes] | np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For every string of `length` bytes within runs (runs[offsets[i]:offsets[i+1]]), the smallest id of a run with it.

    Strings are numbered run by run in order of position.
    """
    text = np.asarray(runs)
    sizes = np.diff(offsets) - length + 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    wanted = offsets[:-1][of] + np.arange(len(of)) - first[of]
    order = two_stage_sort(text, wanted, length)
    fresh = common_prefixes(text, order, length) < length
    number = np.full(len(text) + 1, -1, np.int64)
    number[wanted] = np.arange(len(wanted))
    rank = number[order]
    starts = np.flatnonzero(fresh)
    low = np.minimum.reduceat(ids[of[rank]], starts) if len(starts) else np.empty(0, np.int64)
    out = np.empty(len(wanted), np.int64)
    out[rank] = np.repeat(low, np.diff(np.append(starts, len(order))))
    return out


# ---- blocks --------------------------------------------------------------------------------------


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first position, number of strings, anchor, text number) of every run of a block's texts."""
    n, width = len(data), length - gram + 1
    if n < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    done, low = 1, h
    while done < width:  # minimum over `width` neighbours by doubling
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    size = np.maximum(ends - starts - length + 1, 0)  # strings per text
    of = np.repeat(np.arange(len(starts)), size)
    at = starts[of] + np.arange(len(of)) - (np.cumsum(size) - size)[of]
    anchor = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), anchor[first], of[first]


def _pack_block(ids: list, texts: list[bytes]) -> bytes:
    import zstandard

    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    head = np.concatenate([[len(texts)], lens, [_NONE if i is None else i for i in ids], [i is None for i in ids]]).astype(np.int64)
    return zstandard.ZstdCompressor(3).compress(head.tobytes() + b"".join(texts))


def _open_block(value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, ids, whether an id is null)."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    lens, ids, null = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    data = np.frombuffer(raw, np.uint8, offset=8 * (3 * n + 1))
    ends = np.cumsum(lens)
    return data, ends - lens, ends, ids, null.astype(bool)


def _blocks(docs: DataFrame) -> DataFrame:
    """block, data: the texts in packed blocks of about BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or len(ids) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([base]), pa.array([_pack_block(ids, texts)])], names=["block", "data"])
                    base, ids, texts, size = base + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([base]), pa.array([_pack_block(ids, texts)])], names=["block", "data"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "block long, data binary")


def _rows(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


_SENT = (pa.int32(), pa.int64(), pa.binary())


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), shard[order][1:] != shard[order][:-1])))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=False):
        yield int(shard[order[a]]), order[a:b]


def _per_shard(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Gather the rows (shard, block, data) of each shard, which arrive together, and yield what work makes of them."""
    now, rows = None, []
    for batch in batches:
        for shard, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if shard != now and rows:
                yield from work(rows)
                rows = []
            now = shard
            rows.append((block, _unpack(value.as_py())))
    if rows:
        yield from work(rows)


def shared_anchors(blocks: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """block, data: for each block and shard, the block's anchors that texts of two doc_ids hold (or may: two blocks)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, starts, ends, ids, _ = _open_block(value.as_py())
                _, _, anchor, of = _runs(data, starts, ends, length, gram)
                order = np.argsort(anchor, kind="stable")
                anchor, doc = anchor[order], ids[of[order]]
                at = np.flatnonzero(np.concatenate((np.ones(min(1, len(anchor)), bool), anchor[1:] != anchor[:-1])))
                if not len(at):
                    continue
                many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                anchor = anchor[at]
                rows = [(s, block, _pack(anchor[i], np.packbits(many[i]))) for s, i in _by_shard(_shard(anchor, shards))]
                yield _rows(rows, _SENT, ["shard", "block", "data"])

    def meet(rows: list) -> Iterator[pa.RecordBatch]:
        anchor = np.concatenate([a for _, (a, _) in rows])
        many = np.concatenate([np.unpackbits(m)[: len(a)] for _, (a, m) in rows]).astype(bool)
        order = np.argsort(anchor, kind="stable")
        sorted_ = anchor[order]
        again = np.zeros(len(order), bool)
        again[1:] = sorted_[1:] == sorted_[:-1]
        again[:-1] |= again[1:]
        shared = np.empty(len(order), bool)
        shared[order] = again
        shared |= many
        cut = np.cumsum([0, *(len(a) for _, (a, _) in rows)])
        for i, (block, (a, _)) in enumerate(rows):
            mine = a[shared[cut[i] : cut[i + 1]]]
            if len(mine):
                yield _rows([(block, _pack(mine))], (pa.int64(), pa.binary()), ["block", "data"])

    sent = blocks.mapInArrow(emit, "shard int, block long, data binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return sent.mapInArrow(lambda it: _per_shard(it, meet), "block long, data binary")


def _distinct_runs(data: np.ndarray, first: np.ndarray, size: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of its equals, its number) for each run: runs are equal by anchor, hash of bytes, and length."""
    end, h = first + size + length - 1, np.empty(len(first), np.uint64)
    cut = np.searchsorted(first, np.arange(0, len(data) + 1, BLOCK_BYTES))  # runs are in order: hash a stretch at a time
    for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
        if b > a:
            low, high = int(first[a]), int(end[a:b].max())
            h[a:b] = span_hashes(data[low:high], first[a:b] - low, end[a:b] - low)
    both = mix(anchor ^ np.uint64(0x9E3779B97F4A7C15)) + h
    order = np.lexsort((h, both))
    new = np.ones(len(order), bool)
    new[1:] = (both[order][1:] != both[order][:-1]) | (h[order][1:] != h[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = np.full(int(new.sum()), len(order), np.int64)
    np.minimum.at(lead, group, np.arange(len(order)))
    return lead, group


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[first:first + size] of many spans, one after the other."""
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return data[at]


def held_before(blocks: DataFrame, shared: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """block, data: for runs of the block (by number), the smallest holders of their strings as steps."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if not lists.is_valid:  # no anchor of this block is shared
                    continue
                data, starts, ends, ids, _ = _open_block(value.as_py())
                first, size, anchor, of = _runs(data, starts, ends, length, gram)
                known = np.sort(np.concatenate([_unpack(v)[0] for v in lists.as_py()]))
                at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                run = np.flatnonzero(known[at] == anchor)
                lead, group = _distinct_runs(data, first[run], size[run], anchor[run], length)
                low = np.full(len(lead), np.iinfo(np.int64).max)
                np.minimum.at(low, group, ids[of[run]])
                run = run[lead]
                rows = []
                for s, i in _by_shard(_shard(anchor[run], shards)):
                    i = i[np.argsort(run[i])]
                    r = run[i]
                    span = size[r] + length - 1
                    rows.append((s, block, _pack(r.astype(np.int64), anchor[r], low[i], span.astype(np.uint32), _gather(data, first[r], span))))
                if rows:
                    yield _rows(rows, _SENT, ["shard", "block", "data"])

    def compare(rows: list) -> Iterator[pa.RecordBatch]:
        anchor = np.concatenate([x[1] for _, x in rows])
        low = np.concatenate([x[2] for _, x in rows])
        span = np.concatenate([x[3] for _, x in rows]).astype(np.int64)
        text = np.concatenate([x[4] for _, x in rows])
        for _, x in rows:
            x[4] = None
        start = np.cumsum(span) - span
        lead, group = _distinct_runs(text, start, span - length + 1, anchor, length)
        lowest = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, low)
        # suffix arrays over whole anchors, about ARRAY_BYTES at a time
        order = lead[np.argsort(anchor[lead], kind="stable")]
        number = group[order]
        total = np.cumsum(span[order])
        ends_anchor = np.append(np.flatnonzero(anchor[order][1:] != anchor[order][:-1]) + 1, len(order))
        counts, places, holders = np.zeros(len(lead), np.int64), [], []
        at = 0
        while at < len(order):
            base = total[at - 1] if at else 0
            stop = int(ends_anchor[min(np.searchsorted(total[ends_anchor - 1], base + ARRAY_BYTES), len(ends_anchor) - 1)])
            stop = stop if stop > at else int(ends_anchor[np.searchsorted(ends_anchor, at, "right")])
            part = order[at:stop]
            sizes = span[part]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            holder = smallest_holders(_gather(text, start[part], sizes), offsets, lowest[number[at:stop]], length)
            strings = sizes - length + 1
            begin = np.cumsum(strings) - strings
            new = np.ones(len(holder), bool)
            new[1:] = holder[1:] != holder[:-1]
            new[begin] = True
            change = np.flatnonzero(new)
            steps = np.diff(np.searchsorted(change, np.append(begin, len(holder))))
            counts[number[at:stop]] = steps
            places.append((change - np.repeat(begin, steps)).astype(np.uint32))
            holders.append(holder[change])
            at = stop
        place, holder = np.concatenate(places), np.concatenate(holders)
        offset = np.empty(len(lead), np.int64)
        offset[number] = np.cumsum(counts[number]) - counts[number]
        at = 0
        for block, x in rows:
            mine = group[at : at + len(x[0])]
            at += len(mine)
            n = counts[mine]
            k = np.repeat(offset[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield _rows([(block, _pack(x[0], n.astype(np.uint32), place[k], holder[k]))], (pa.int64(), pa.binary()), ["block", "data"])

    lists = shared.groupBy("block").agg(F.collect_list("data").alias("lists"))
    # a left join, as in remove_repeats, so that both read one shuffle of the blocks
    with_lists = blocks.join(lists, "block", "left").select("block", "data", "lists")
    sent = with_lists.mapInArrow(emit, "shard int, block long, data binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return sent.mapInArrow(lambda it: _per_shard(it, compare), "block long, data binary")


def _covered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, found: list[bytes], length: int, gram: int) -> np.ndarray:
    """Which bytes of a block are covered by strings that a smaller id also holds."""
    cover = np.zeros(len(data) + 1, np.int32)
    first, size, anchor, of = _runs(data, starts, ends, length, gram)
    if found:
        # what all shards say at once: a run has one anchor, so one shard, and the work does not grow with their number
        values = [_unpack(v) for v in found]
        run, steps, at, holder = (np.concatenate([v[i] for v in values]).astype(np.int64) for i in range(4))
        # all runs of the block that equal one of these
        mine = np.flatnonzero(np.isin(anchor, anchor[run]))
        lead, group = _distinct_runs(data, first[mine], size[mine], anchor[mine], length)
        place = np.full(len(first), -1, np.int64)
        place[run] = np.arange(len(run))
        which = place[mine[lead]][group]
        mine, which = mine[which >= 0], which[which >= 0]
        step0 = np.cumsum(steps) - steps
        reps = steps[which]
        k = np.repeat(step0[which] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        r = np.repeat(mine, reps)
        last = np.append(at[1:], 0)
        last[step0 + steps - 1] = -1
        stop = np.where(last[k] < 0, size[r], last[k])
        old = holder[k] < ids[of[r]]
        np.add.at(cover, first[r[old]] + at[k[old]], 1)
        np.add.at(cover, first[r[old]] + stop[old] - 1 + length, -1)
    return np.cumsum(cover[:-1]) > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 25) -> DataFrame:
    """One row per document (OUT): kept are the bytes that no string of `length` bytes also starting in a smaller doc_id covers.

    Texts are UTF-8 bytes, null is empty; null doc_ids count as smaller than all others; rows with equal doc_ids take
    nothing from each other. Columns other than doc_id and text are ignored; an empty table gives an empty result.
    """
    blocks = materialize(_blocks(docs), "uncompressed")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    shared = shared_anchors(blocks, shards, length, gram)
    found = held_before(blocks, shared, shards, length, gram)
    lists = found.groupBy("block").agg(F.collect_list("data").alias("found"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, lists in zip(batch.column(0), batch.column(1), strict=True):
                data, starts, ends, ids, null = _open_block(value.as_py())
                gone = _covered(data, starts, ends, ids, lists.as_py() or [], length, gram)
                kept = ~gone
                rows = []
                for a, b, i, no in zip(starts.tolist(), ends.tolist(), ids.tolist(), null.tolist(), strict=True):
                    g = gone[a:b]
                    rest = data[a:b][kept[a:b]].tobytes() if g.any() else data[a:b].tobytes()
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if b > a else 0
                    rows.append((None if no else i, b - a, int(g.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
                for j in range(0, len(rows), 256):
                    yield _rows(rows[j : j + 256], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), [x.split()[0] for x in OUT.split(", ")])

    return blocks.join(lists, "block", "left").select("data", "found").mapInArrow(finish, OUT)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of documents; nulls and repeats as in remove_repeats()."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS p FROM d)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) < doc_id AS old FROM w),
b AS (SELECT doc_id, unnest(range(0, len(x) // 2)) AS p, unnest(regexp_extract_all(x, '..')) AS byte FROM d),
c AS (SELECT b.doc_id, b.p, byte, coalesce(bool_or(old) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM b LEFT JOIN m ON m.doc_id = b.doc_id AND m.p = b.p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
