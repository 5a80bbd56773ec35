"""Operator 12: media columns. Payloads stand in tar shards under the digest of their content; rows carry digest, offset and length.

store() keeps each different payload once. Its tasks write plain tar files through Spark's own writer and commit protocol,
so a lost or repeated attempt leaves no half shard, and any file system of Spark will do. Each shard ends with an index of
its members and a fixed-size tail that says where the index begins, as any reader of ranges wants it: one range for the tail
and one for the index list a shard, 33 bytes or fewer at a member's offset fill the metadata columns, and a whole member
is one more range. Readers work shard by shard and never see a shard whole.

Only payloads that may repeat are shuffled. A filter of fixed size over the digests that occur more than once, built from
the digests alone, sends every other payload from the scan straight into a shard; what the filter lets through is dealt by
digest and written once. The more repeats a corpus has, the more is shuffled; the result is the same.

Payloads of this module's query are grey PNG pictures of 8-bit samples, 192 to a row; store() takes any bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, workspace

#: Samples in a row of a picture.
WIDTH = 192
#: The filter of repeated digests has 2**FILTER_BITS bits.
FILTER_BITS = 26
#: Payload bytes of a shard of dealt payloads, on average. Other shards hold what one task scans.
SHARD_BYTES = 64 << 20
#: Bytes of a header-only read: PNG's signature and first chunk; WAV and GIF need fewer.
HEADER = 33
#: Bytes of the batches that tasks hand on.
BATCH_BYTES = 4 << 20
_BLOCK = 512
_ENTRY = "<32sQQ"  # digest, offset, length
_TAIL = "<8sQQ"  # mark, offset of the index, entries
_MARK = b"shardidx"
_PNG = b"\x89PNG\r\n\x1a\n"

INDEX = "digest string, shard string, offset long, length long"
HEADERS = INDEX + ", format string, width long, height long, channels int, bits int, rate long"


# ---- formats -------------------------------------------------------------------------------------


def png(samples: bytes, width: int = WIDTH) -> bytes:
    """Grey 8-bit samples, a positive multiple of width, as a PNG picture; equal samples give equal bytes."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # filter 0: samples as they are
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> bytes:
    """The samples of a picture that png() made."""
    width, height = struct.unpack(">II", data[16:24])
    at, body = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def header_fields(head: bytes) -> tuple:
    """format, width, height, channels, bits, rate from the first bytes of a PNG, GIF or canonical WAV file; nulls where a format has none."""
    if head[:8] == _PNG and len(head) >= 26:
        width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
        return "png", width, height, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour), bits, None
    if head[:4] == b"GIF8" and len(head) >= 11:
        return "gif", *struct.unpack("<HH", head[6:10]), 1, (head[10] & 7) + 1, None
    if head[:4] == b"RIFF" and head[8:16] == b"WAVEfmt " and len(head) >= 28:
        channels, rate = struct.unpack("<HI", head[22:28])
        return "wav", None, None, channels, None, rate
    return None, None, None, None, None, None


# ---- shards --------------------------------------------------------------------------------------


def _member_header(name: bytes, size: int) -> bytes:
    """A ustar header of a plain file; sizes of 8 GB and more in base 256."""
    length = b"%011o\x00" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head = b"".join([name.ljust(100, b"\0"), b"0000644\0", b"0000000\0", b"0000000\0", length, b"00000000000\0", b" " * 8, b"0", b"\0" * 100, b"ustar\x0000", b"\0" * 247])
    return head[:148] + b"%06o\x00 " % sum(head) + head[156:]


def _member(name: bytes, body: bytes) -> bytes:
    """Header, body and padding. The last byte is always a NUL of padding, or of an empty member's header where the body needs none."""
    pad = -len(body) % _BLOCK
    return _member_header(name, len(body)) + body + (b"\0" * pad if pad else _member_header(b".pad", 0))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """The rows (digest, bytes) of batches, one at a time."""
    for batch in batches:
        for digest, body in zip(batch.column(0), batch.column(1), strict=True):
            yield digest.as_py(), body.as_py()


def _shard(items: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Items, equal digests next to each other -> the pieces of a tar file, each without its last byte, a NUL that the writer adds."""
    at, last, entries, out, size = 0, None, [], [], 0
    for digest, media in items:
        if digest == last:
            continue
        piece = _member(digest.encode(), media)
        entries.append(struct.pack(_ENTRY, bytes.fromhex(digest), at + _BLOCK, len(media)))
        at, last, size = at + len(piece), digest, size + len(piece)
        out.append(piece[:-1])
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(out, pa.binary())], names=["piece"])
            out, size = [], 0
    if entries:
        index = _member(b".index", b"".join(entries))
        tail = _member(b".tail", struct.pack(_TAIL, _MARK, at + _BLOCK, len(entries))) + b"\0" * 2 * _BLOCK
        yield pa.record_batch([pa.array([*out, index[:-1], tail[:-1]], pa.binary())], names=["piece"])


def _write(pieces: DataFrame) -> str:
    """Write each partition's pieces as one file: bytes as they are, and a NUL behind each."""
    folder = workspace(pieces.sparkSession)
    pieces.select(F.col("piece").cast("string")).write.option("lineSep", "\0").text(folder)  # the cast keeps the bytes
    return folder


def store(items: DataFrame, total_bytes: int, shard_bytes: int | None = None) -> str:
    """Write items (digest: 64 hex digits, media: binary) into tar shards, each digest once; returns the folder.

    A digest stands for the content: rows with the same digest must hold the same bytes, and rows that lack either are
    left out. Items should come with few repeats of a digest (_encoded()), as all of them meet in one shard.
    """
    shards = max(1, math.ceil(total_bytes / (shard_bytes or SHARD_BYTES)))
    ordered = items.where("digest IS NOT NULL AND media IS NOT NULL").select("digest", "media").repartition(shards, "digest").sortWithinPartitions("digest")
    return _write(ordered.mapInArrow(lambda b: _shard(_items(b)), "piece binary"))


def repeat_filter(repeated: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits as bytes; set are those that the first bits of repeated's digests name. Each word is summed up in the executors."""
    place = F.shiftright(F.conv(F.substring("digest", 1, 7), 16, 10).cast("long"), 28 - FILTER_BITS)
    x = repeated.select(place.alias("place")).selectExpr("shiftright(place, 3) AS byte", "shiftleft(1, cast(place & 7 AS int)) AS bit").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[x["byte"].to_numpy(np.int64)] = x["bits"].to_numpy(np.uint8)
    return bits


def may_repeat(digest: str, bits: np.ndarray) -> bool:
    place = int(digest[:7], 16) // ((1 << 28) // (8 * len(bits)))
    return bool(bits[place >> 3] >> (place & 7) & 1)


def _encoded(items: Iterator[tuple[str, bytes]], encode: Callable[[bytes], bytes], wanted: Callable[[str], bool]) -> Iterator[tuple[str, bytes]]:
    """Items of wanted digests, encoded, each once a task: what a hot payload sends is one copy from each task."""
    seen = set()
    for digest, payload in items:
        if digest not in seen and wanted(digest):
            seen.add(digest)
            yield digest, encode(payload)


def _batched(items: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Items as batches (digest, media) of about BATCH_BYTES."""
    out, size = [], 0
    for item in itertools.chain(items, [None]):
        if item is not None:
            out.append(item)
            size += len(item[1])
        if out and (item is None or size >= BATCH_BYTES):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], names=["digest", "media"])
            out, size = [], 0


def _open(shard: str):
    """A random-access file of a shard; the store must be one that pyarrow opens too (local or mounted, hdfs, s3, gs, abfs)."""
    uri = shard.replace("s3a://", "s3://", 1)
    files, path = pyarrow.fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return files.open_input_file(path)


def _range(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def _shards(spark: SparkSession, folders: tuple[str, ...]) -> DataFrame:
    """path, length of the shards in the folders, as Spark lists them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(folders)).select("path", "length").where("length > 0")


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, size in zip(batch["path"], batch["length"], strict=True):
            with _open(path) as f:
                mark, at, n = struct.unpack(_TAIL, _range(f, size - 3 * _BLOCK, struct.calcsize(_TAIL)))
                if mark != _MARK:
                    raise ValueError(f"{path} has no index")
                found = list(struct.iter_unpack(_ENTRY, _range(f, at, n * struct.calcsize(_ENTRY))))
            yield pd.DataFrame({"digest": [d.hex() for d, _, _ in found], "shard": path, "offset": [o for _, o, _ in found], "length": [x for _, _, x in found]})


def _by_shard(batch: pd.DataFrame):
    """(rows of one shard by offset, open file) for each shard of a batch."""
    for path, rows in batch.groupby("shard", sort=False):
        with _open(path) as f:
            yield rows.sort_values("offset"), f


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for rows, f in _by_shard(batch):
            fields = [header_fields(_range(f, o, min(HEADER, n))) for o, n in zip(rows["offset"], rows["length"], strict=True)]
            for i, name in enumerate(("format", "width", "height", "channels", "bits", "rate")):
                rows[name] = pd.array([x[i] for x in fields], "Int64") if i else [x[0] for x in fields]
            yield rows


def _features(batches: Iterator[pd.DataFrame], features: Callable[[bytes], tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for rows, f in _by_shard(batch):
            out = [features(_range(f, o, n)) for o, n in zip(rows["offset"], rows["length"], strict=True)]
            for i, name in enumerate(names):
                rows[name] = [x[i] for x in out]
            yield rows


def index(spark: SparkSession, *folders: str) -> DataFrame:
    """INDEX: one row per member of the shards in the folders, from two range reads of each. Spark lists the shards; none is read whole."""
    return _shards(spark, folders).mapInPandas(_entries, INDEX)


def with_headers(members: DataFrame) -> DataFrame:
    """HEADERS: INDEX rows with the metadata that the first HEADER bytes of each member hold; unknown formats give nulls."""
    return members.mapInPandas(_headers, HEADERS)


def read_back(members: DataFrame, features: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """members' columns and those of schema, which features(bytes) gives for each member, read one at a time from its range."""
    old = ", ".join(f"`{c}` {t}" for c, t in members.dtypes)
    return members.mapInPandas(lambda b: _features(b, features, [x.split()[0] for x in schema.split(",")]), f"{old}, {schema}")


def described(spark: SparkSession, features: Callable[[bytes], tuple], schema: str, *folders: str) -> DataFrame:
    """index(), with_headers() and read_back() in one pass of each shard."""
    names = [x.split()[0] for x in schema.split(",")]
    return _shards(spark, folders).mapInPandas(lambda b: _features(_headers(_entries(b)), features, names), f"{HEADERS}, {schema}")


# ---- documents as pictures -----------------------------------------------------------------------


def payload_column(text: Column, unit: int = WIDTH) -> Column:
    """A text's UTF-8 bytes with spaces up to a positive multiple of unit; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.octet_length(text)
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(unit), F.ceil(n / unit) * unit).cast("int") - n)).cast("binary")


def picture_features(media: bytes) -> tuple:
    """payload_sha256, tail_crc32, media_sha256, feature of a stored picture.

    feature: mean, standard deviation and entropy in bits of the samples, and the mean step between neighbours, at 4 decimals.
    """
    payload = unpng(media)
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    mean, spread, entropy = x.mean(), x.std(), float(-(share * np.log2(share)).sum())
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    feature = f"mean={mean:.4f} std={spread:.4f} entropy={entropy + 0.0:.4f} step={step:.4f}"
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media).hexdigest(), feature


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored) with its media columns.

    doc_id, n_bytes, payload_bytes, digest, shard, offset, length, format, width, height, channels, bits (from headers only),
    payload_sha256, tail_crc32, media_sha256, feature (from the stored bytes, read back). The shards stay until the driver
    ends. Null texts are empty, rows with equal texts share a member, null ids stay, and an empty table gives no row.
    """
    spark = docs.sparkSession
    payload = payload_column(F.col("text"))
    rows = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), payload.alias("payload"))
    rows = materialize(rows.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha2("payload", 256)).alias("digest")))
    repeated = materialize(rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("payload_bytes").alias("payload_bytes")).where("n > 1").select(F.lower(F.hex("digest")).alias("digest"), "payload_bytes"))
    bits = spark.sparkContext.broadcast(repeat_filter(repeated))
    items = docs.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload")
    single = _write(items.mapInArrow(lambda b: _shard(_encoded(_items(b), png, lambda d: not may_repeat(d, bits.value))), "piece binary"))
    dealt = store(items.mapInArrow(lambda b: _batched(_encoded(_items(b), png, lambda d: may_repeat(d, bits.value))), "digest string, media binary"), repeated.agg(F.sum("payload_bytes")).first()[0] or 0)
    members = described(spark, picture_features, "payload_sha256 string, tail_crc32 long, media_sha256 string, feature string", single, dealt)
    # a payload that is read back as it was has its digest for SHA-256, which then need not travel twice
    members = members.withColumns({"digest": F.unhex("digest"), "payload_sha256": F.unhex(F.nullif("payload_sha256", "digest")), "media_sha256": F.unhex("media_sha256")})
    back = {"payload_sha256": F.lower(F.hex(F.coalesce("payload_sha256", "digest")))} | {c: F.lower(F.hex(c)) for c in ("digest", "media_sha256")}
    return rows.join(members, "digest").withColumns(back)


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with the columns that the stored picture of its text gives; offset and shard name stay inside, as shards are dealt anew."""
    x = media_columns(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "format", "width", "height", "channels", "bits")
