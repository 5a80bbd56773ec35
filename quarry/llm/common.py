"""Shared pieces of the training-data operators: written tables, table readers, byte-level helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def workspace(spark: SparkSession) -> str:
    """A fresh folder in the shared place named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster must name a shared one.
    The folder is deleted when the driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/quarry"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if "/quarry-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> "F.Column":
    """Words in a text column, 0 for null; JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- numpy over the bytes of many texts at once -------------------------------------------------

#: Odd multiplier of the polynomial window hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n, kept by the worker."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n).bit_length())
        for key, p in (("up", _P), ("down", _P_INV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over 64."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hashes of data[start:end] for many spans, in time linear in the bytes plus the spans.

    A prefix sum of byte * p**position gives every span by one subtraction; multiplying by p**-start makes it independent of the position.
    """
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array that begins and ends with white space."""
    space = IS_SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    return change[0::2], change[1::2]


def text_blocks(batches, limit: int = 2 << 20, lower: bool = False):
    """Yield (columns, data, starts, ends) for runs of rows with about `limit` bytes of text.

    batches: Arrow batches whose last column is the text as binary (null: empty). columns: the other columns' slices.
    data: all texts with one space before, between and after; starts[i]:ends[i] is text i.
    """
    for batch in batches:
        *others, texts = batch.columns
        row = 0
        while row < len(texts):
            at, size, parts = row, 0, []
            while row < len(texts) and (size < limit or not parts):
                t = texts[row].as_py() or b""
                parts.append(t)
                size += len(t) + 1
                row += 1
            blob = b" " + b" ".join(parts) + b" "
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            starts = np.cumsum(lens + 1) - lens
            yield [c.slice(at, row - at) for c in others], np.frombuffer(blob.lower() if lower else blob, np.uint8), starts, starts + lens
