"""File sources: a recursive scan with hashes, a scan that honours .gitignore, and a stream of changes.

Spark's binaryFile source hides names that begin with an underscore and matches suffixes by case, so the scan is a
Python data source: the driver lists folders, each partition reads and hashes its share of the files. Folders must be
visible to the executors.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, file_name string, file_type string, size long, modified_at timestamp, sha256 string, content binary"
ARROW = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("file_type", pa.string()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("sha256", pa.string()), ("content", pa.binary())])
EVENTS = "event_type string, path string, timestamp timestamp"

# File types that are indexed, names that the git-aware scan passes over, and how bulk reading decodes types.
SUPPORTED = [".txt", ".md", ".pdf", ".docx", ".pptx", ".xlsx", ".xls", ".csv", ".tsv", ".html", ".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".cpp", ".rb", ".eml", ".msg", ".epub"]
SKIPPED = ["node_modules", ".venv", "__pycache__", ".git", "dist", "build", ".egg-info", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", ".DS_Store"]
TEXT_TYPES = ["txt", "md", "rst", "csv", "tsv", "json", "toml", "yaml", "yml", "env", "cfg", "ini", "conf"]
BINARY_TYPES = ["pdf", "docx", "xlsx", "pptx", "epub", "eml", "msg"]


def hash_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class GitIgnore:
    """Rules of the .gitignore files from a root down; a later rule and a deeper file win."""

    def __init__(self, root: str) -> None:
        self.root, self.rules = root, {}

    def _of(self, folder: str) -> list[tuple[bool, bool, bool, str]]:
        if folder not in self.rules:
            rules = []
            try:
                with open(os.path.join(folder, ".gitignore"), encoding="utf-8") as f:
                    for line in map(str.rstrip, f):
                        if line and not line.startswith("#"):
                            keep, line = line.startswith("!"), line.lstrip("!")
                            rules.append((keep, line.endswith("/"), "/" in line.rstrip("/"), line.strip("/")))
            except OSError:
                pass
            self.rules[folder] = rules
        return self.rules[folder]

    def ignores(self, path: str, is_dir: bool) -> bool:
        folders, at = [self.root], self.root
        for part in os.path.relpath(os.path.dirname(path), self.root).split(os.sep):
            if part != ".":
                at = os.path.join(at, part)
                folders.append(at)
        out = False
        for folder in folders:
            inside = os.path.relpath(path, folder).replace(os.sep, "/")
            for keep, only_dirs, anchored, pattern in self._of(folder):
                if only_dirs and not is_dir:
                    continue
                subject = inside if anchored else os.path.basename(path)
                match = fnmatch.fnmatch(subject, pattern.replace("**/", "*")) if "**" in pattern else fnmatch.fnmatch(subject, pattern) and (not anchored or subject.count("/") == pattern.count("/"))
                if match:
                    out = not keep
        return out


def walk(root: str, extensions: list[str] | None = None, max_bytes: int | None = None, skip_hidden: bool = True, follow_links: bool = True, git_aware: bool = False) -> list[str]:
    """Paths of regular files below root in string order; a root that is missing has none. Suffixes match in any case."""
    wanted = {"." + e.lower().lstrip(".") for e in extensions} if extensions is not None else None
    ignore = GitIgnore(root) if git_aware and os.path.isdir(os.path.join(root, ".git")) else None
    out, seen = [], set()
    for folder, dirs, names in os.walk(root, followlinks=follow_links):
        real = os.path.realpath(folder)
        if real in seen:  # a link back up
            dirs[:] = []
            continue
        seen.add(real)
        hide = lambda n: (skip_hidden and not git_aware and n.startswith(".")) or (git_aware and n in SKIPPED)
        dirs[:] = sorted(d for d in dirs if not hide(d) and not (ignore and ignore.ignores(os.path.join(folder, d), True)))
        for name in names:
            path = os.path.join(folder, name)
            stem, suffix = os.path.splitext(name)
            if hide(name) or (wanted is not None and suffix.lower() not in wanted) or (ignore and ignore.ignores(path, False)):
                continue
            try:
                if os.path.isfile(path) and (follow_links or not os.path.islink(path)) and (max_bytes is None or os.path.getsize(path) <= max_bytes):
                    out.append(path)
            except OSError:
                continue
    return sorted(out)


def read_file(path: str) -> tuple | None:
    """A file's row of SCHEMA; None if it can't be read."""
    try:
        with open(path, "rb") as f:
            content = f.read()
        at = datetime.fromtimestamp(os.path.getmtime(path), UTC)
    except OSError:
        return None
    name = os.path.basename(path)
    return path, name, os.path.splitext(name)[1].lower(), len(content), at, hashlib.sha256(content).hexdigest(), content


class _Paths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        flag = lambda k, default: options.get(k, default).lower() == "true"
        exts = options.get("extensions")
        most = options.get("maxbytes")
        self.args = (options["path"], exts.split(",") if exts else None, int(most) if most else None, flag("skiphidden", "true"), flag("followlinks", "true"), flag("gitaware", "false"))
        self.per_partition = int(options.get("filesperpartition", "256"))

    def partitions(self) -> list[_Paths]:
        paths = walk(*self.args)
        n = self.per_partition
        return [_Paths(paths[i : i + n]) for i in range(0, len(paths), n)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path in partition.paths:
            if row := read_file(path):
                yield row


def snapshot(root: str, extensions: list[str] | None, skip_hidden: bool = True) -> dict[str, list]:
    out = {}
    for path in walk(root, extensions, None, skip_hidden):
        try:
            s = os.stat(path)
            out[path] = [s.st_mtime_ns, s.st_size]
        except OSError:
            continue
    return out


def changes(before: dict[str, list], after: dict[str, list]) -> list[tuple[str, str]]:
    """(event, path) of what was created, modified and deleted between two snapshots, by path."""
    events = [("created" if p not in before else "modified", p) for p, s in after.items() if before.get(p) != s]
    return sorted(events + [("deleted", p) for p in before if p not in after], key=lambda e: e[1])


class _Shard(InputPartition):
    def __init__(self, start: int, end: int, shard: int) -> None:
        self.start, self.end, self.shard = start, end, shard


class _Watch(DataSourceStreamReader):
    """The offset is the number of a snapshot, so its size is the same for any folder.

    A snapshot is a listing, dealt to SHARDS files by a hash of the paths, under the state folder, which the executors
    must see. Each shard of two snapshots gives its changes in a task of its own, and a replay reads the same files. A
    listing that equals the last one makes no new snapshot; commits drop the snapshots before them.
    """

    SHARDS = 16

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.exts = options["extensions"].split(",") if options.get("extensions") else None
        self.first = options.get("includeexisting", "true").lower() == "true"
        self.state = options["state"]

    def _store(self) -> tuple[pafs.FileSystem, str]:
        uri = self.state
        store, folder = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")
        return store, folder

    def _numbers(self) -> list[int]:
        store, folder = self._store()
        found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def _load(self, number: int, shard: int) -> dict[str, list]:
        if number < 0:
            return {}
        store, folder = self._store()
        with store.open_input_stream(f"{folder}/{number}/{shard}") as f:
            return json.loads(f.read())

    def _save(self, number: int, listing: dict[str, list]) -> None:
        store, folder = self._store()
        parts: list[dict[str, list]] = [{} for _ in range(self.SHARDS)]
        for path, s in listing.items():
            parts[zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.SHARDS][path] = s
        new = f"{folder}/writing-{uuid.uuid4().hex}"
        store.create_dir(new)
        for i, part in enumerate(parts):
            with store.open_output_stream(f"{new}/{i}") as f:
                f.write(json.dumps(part, sort_keys=True).encode())
        store.move(new, f"{folder}/{number}")  # whole, or not at all

    def initialOffset(self) -> dict:
        if self.first:
            return {"snapshot": -1}
        if not self._numbers():
            self._save(0, snapshot(self.root, self.exts))
        return {"snapshot": self._numbers()[0]}

    def latestOffset(self) -> dict:
        last = (self._numbers() or [-1])[-1]
        now = snapshot(self.root, self.exts)
        before = {p: x for i in range(self.SHARDS) for p, x in self._load(last, i).items()}
        if now != before or last < 0:
            last += 1
            self._save(last, now)
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[_Shard]:
        return [_Shard(start["snapshot"], end["snapshot"], i) for i in range(self.SHARDS)] if start != end else []

    def read(self, partition: _Shard) -> Iterator[tuple]:
        now = datetime.fromtimestamp(time.time(), UTC)
        for event, path in changes(self._load(partition.start, partition.shard), self._load(partition.end, partition.shard)):
            yield event, path, now

    def commit(self, end: dict) -> None:
        store, folder = self._store()
        for n in self._numbers():
            if n < end["snapshot"]:
                store.delete_dir(f"{folder}/{n}")


class FileScan(DataSource):
    """Batch source of files with their hashes and contents."""

    @classmethod
    def name(cls) -> str:
        return "quarry_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


class FileWatch(DataSource):
    """Stream source of file changes below a folder."""

    @classmethod
    def name(cls) -> str:
        return "quarry_watch"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Watch({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, max_bytes: int | None = None, **options: object) -> DataFrame:
    """Files below root (SCHEMA). Options: skipHidden, followLinks, gitAware, filesPerPartition."""
    spark.dataSource.register(FileScan)
    reader = spark.read.format("quarry_files").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    if extensions is not None:
        reader = reader.option("extensions", ",".join(extensions))
    if max_bytes is not None:
        reader = reader.option("maxBytes", str(max_bytes))
    return reader.load(root)


def read_paths(paths: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """SCHEMA for the files that paths (column path) names, each opened once in the task that has its row; others are not touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    fits = max_bytes is None or os.path.getsize(path) <= max_bytes
                except OSError:
                    continue
                if fits and (row := read_file(path)):
                    yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, row, strict=True))], ARROW)

    return paths.select("path").mapInArrow(run, SCHEMA)


def watch(spark: SparkSession, root: str, state: str, extensions: list[str] | None = None, include_existing: bool = True) -> DataFrame:
    """A stream of EVENTS below root. state: a folder of this stream alone, for its snapshots, that the executors see."""
    spark.dataSource.register(FileWatch)
    reader = spark.readStream.format("quarry_watch").option("includeExisting", str(include_existing).lower()).option("state", state)
    if extensions is not None:
        reader = reader.option("extensions", ",".join(extensions))
    return reader.load(root)


def bulk_texts(files: DataFrame) -> DataFrame:
    """path, text: null for binary types; text types fall back to Latin-1; all others are UTF-8 or null."""
    from pyspark.sql import functions as F

    from ..functions.text import decode_strict, decode_text

    ext = F.substring(F.col("file_type"), 2, 100)
    text = F.when(ext.isin(BINARY_TYPES), F.lit(None).cast("string")).when(ext.isin(TEXT_TYPES), decode_text(F.col("content"))).otherwise(decode_strict(F.col("content")))
    return files.select("path", text.alias("text"))
