"""The engine's facade: index, search, refine, ask, stats, files, delete, doctor and watch over one store."""

from __future__ import annotations

import importlib.util
import json
import re
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import query_parser
from .functions.text import NAMESPACE_NAME
from .operators import ann, bm25, catalog, hybrid, rag, segments, vector
from .operators.index import Store, Summary, chunk_files, index_files
from .sources import files as file_sources
from .streaming import watch as streaming

Embedder = Callable[[str], Sequence[float]]


def namespace_name(name: str) -> str:
    """Stripped and in lower case; others than letters, digits, - and _ are refused."""
    name = name.strip().lower()
    if not re.fullmatch(NAMESPACE_NAME.strip("^$"), name):
        raise ValueError(f"{name!r} is no namespace name")
    return name


class Engine:
    """All operations take the engine's namespace unless another is given. Results are DataFrames unless said otherwise."""

    def __init__(self, spark: SparkSession, root: str, namespace: str = "default", embed: Embedder = vector.hash_embed_text, generate: Callable[[str], Iterator[str]] | None = None, grants: DataFrame | None = None) -> None:
        self.spark, self.root, self.namespace = spark, root.rstrip("/"), namespace_name(namespace)
        self.store, self.embed, self.generate, self.grants = Store(spark, root), embed, generate, grants
        self._watches: dict[str, object] = {}
        self._lock = threading.Lock()
        self._recent: list[dict] = []

    # ---- writing ----

    def index(self, folder: str | None = None, files: DataFrame | None = None, force: bool = False, namespace: str | None = None, max_file_size_mb: int = 10, size: int = 500, overlap: int = 50, progress: Callable[[dict], None] | None = None) -> Summary:
        """Index a folder, or files given as a DataFrame of sources.files.SCHEMA."""
        tell = progress or (lambda _: None)
        tell({"status": "scanning"})
        if files is None:
            files = file_sources.scan(self.spark, folder, file_sources.SUPPORTED, max_file_size_mb << 20)
        with self._lock:
            own = None if self.embed is vector.hash_embed_text else self.embed  # the default one has a form without Python
            out = index_files(self.store, files, namespace or self.namespace, force, size, overlap, embed=own)
        tell({"status": "done"} | asdict(out))
        self.audit("index", json.dumps(asdict(out)))
        return out

    def delete(self, path: str, namespace: str | None = None) -> int:
        """Remove a file's chunks; the number removed."""
        ns = namespace or self.namespace
        with self._lock:
            gone = self.spark.createDataFrame([(ns, path)], "namespace string, file_path string")
            n = self.store.read(ns).where(F.col("file_path") == path).count()
            if n:
                self.store.change(gone)
        self.audit("delete", path)
        return n

    # ---- searching ----

    def chunks(self, namespace: str | None = None, key: str | None = None) -> DataFrame:
        x = self.store.read(namespace or self.namespace)
        return x if self.grants is None else catalog.allowed(x, self.grants, key)

    def search(self, query: str, mode: str = "hybrid", top_k: int = 10, namespace: str | None = None, key: str | None = None, compat: bool = False, approximate: bool = False, **filters: str | None) -> DataFrame:
        """Hits of one query. Corpus statistics are those of the namespace; filters come before ranking.

        approximate: the semantic side probes the namespace's cells (vector_index()) instead of scanning all vectors.
        """
        if mode not in hybrid.MODES:
            raise ValueError(f"mode must be one of {', '.join(hybrid.MODES)}")
        chunks = self.chunks(namespace, key)
        self._note(query, mode)
        if not query.strip():
            return hybrid.with_payload(self.spark.createDataFrame([], "rank int, id string, score double"), chunks, "point_id")
        # what a key may see differs from search to search, so only whole namespaces have a kept index
        index = self.keyword_index(namespace) if self.grants is None else bm25.build(chunks, "point_id", "chunk_text")
        near = self.vector_index(namespace).search if approximate and self.grants is None else None
        return hybrid.search(chunks, index, query, mode, top_k, self.embed, hybrid.filters(**filters), "point_id", compat, near)

    def vector_index(self, namespace: str | None = None) -> ann.Cells:
        """The namespace's cells, brought to the store's version: chunks that left are marked, new ones added; rebuilt once more than half has changed."""
        ns, now = namespace or self.namespace, self.store.version()
        name = f"ann/{ns}"
        known = json.loads(self.store.text(f"{name}/STATE")) if self.store.has(f"{name}/STATE") else None
        if known and known["version"] == now:
            return ann.Cells.open(self.spark, f"{self.root}/{name}/{known['folder']}")
        with self._lock:
            rows = self.store.read(ns)
            attributes = ["file_type", "file_path", "file_modified_at", "file_hash"]
            state = {"version": now, "folder": known["folder"] if known else now, "changed": known["changed"] if known else 0}
            if known:
                cells = ann.Cells.open(self.spark, f"{self.root}/{name}/{known['folder']}")
                old, new = cells.rows().select("id", "file_hash"), rows.select(F.col("point_id").alias("id"), "file_hash")
                gone = old.join(new, ["id", "file_hash"], "left_anti").select("id").persist()
                fresh = rows.join(old.withColumnRenamed("id", "point_id"), ["point_id", "file_hash"], "left_anti").persist()
                state["changed"] += gone.count() + fresh.count()
                if 2 * state["changed"] <= rows.count():
                    cells.delete(gone)
                    cells.add(fresh, "point_id", "embedding", attributes)
                else:
                    state |= {"folder": now, "changed": 0}
                gone.unpersist()
                fresh.unpersist()
            if not known or state["folder"] != known["folder"]:
                cells = ann.Cells.build(rows, f"{self.root}/{name}/{now}", "point_id", "embedding", attributes)
            self.store.put(f"{name}/STATE", json.dumps(state))
        return cells

    def keyword_index(self, namespace: str | None = None) -> segments.Kept:
        """The namespace's BM25 index, brought to the store's version by a commit of what differs.

        Texts are read from the store's parts that have changed since; of the others the ids alone.
        """
        ns, now = namespace or self.namespace, self.store.version()
        name = f"bm25/{ns}"
        state = json.loads(self.store.text(f"{name}/STATE")) if self.store.has(f"{name}/STATE") else None
        index = segments.Kept.open(self.spark, f"{self.root}/{name}")
        if state and index and state["version"] == now:
            return index
        with self._lock:
            parts = {f"{b}": folder for (n, b), folder in self.store.parts().items() if n == ns}
            if not state or index is None:
                index = segments.Kept.create(self.store.read(ns), f"{self.root}/{name}", "point_id", "chunk_text")
            else:
                same = {(ns, int(b)) for b, folder in parts.items() if state["parts"].get(b) == folder}
                stays = self.store.read(ns, same).select(F.col("point_id").alias("id"))
                moved = bm25.stamped(self.store.read(ns, set(self.store.parts()) - same), "point_id", "chunk_text").persist()
                old = index.docs().select("id", "stamp").join(stays, "id", "left_anti").persist()
                gone = old.join(moved.select("id", "stamp"), ["id", "stamp"], "left_anti").select("id").persist()
                fresh = moved.join(old, ["id", "stamp"], "left_anti").persist()
                if not (gone.isEmpty() and fresh.isEmpty()):
                    index.commit(fresh, gone, "id", "text")
                for x in (moved, old, gone, fresh):
                    x.unpersist()
            self.store.put(f"{name}/STATE", json.dumps({"version": now, "parts": parts}))
        return index

    def refine_search(self, query: str, add: Sequence[str] = (), subtract: Sequence[str] = (), top_k: int = 10, namespace: str | None = None, **filters: str | None) -> DataFrame:
        """Semantic hits of the query's vector, moved towards what is added and away from what is subtracted."""
        parsed = query_parser.parse(query)
        base = query_parser.combine(parsed, self.embed) if parsed.arithmetic else list(self.embed(query))
        v = query_parser.refine(base, [list(self.embed(t)) for t in add], [list(self.embed(t)) for t in subtract])
        chunks = self.chunks(namespace)
        return hybrid.with_payload(vector.search(chunks, v, top_k, "point_id", "embedding", hybrid.filters(**filters)), chunks, "point_id")

    def ask_stream(self, question: str, mode: str = "hybrid", top_k: int = 3, namespace: str | None = None) -> Iterator[dict]:
        """Events: tokens, then the sources, then done. Retrieval happens once."""
        if self.generate is None:
            raise RuntimeError("no generator is set")
        self.audit("ask", question)
        return rag.ask(self.search(question, mode, top_k, namespace), question, self.generate)

    def ask(self, question: str, mode: str = "hybrid", top_k: int = 3, namespace: str | None = None) -> dict:
        events = list(self.ask_stream(question, mode, top_k, namespace))
        return {"answer": "".join(e["data"] for e in events if e["event"] == "token"), "sources": next(e["data"] for e in events if e["event"] == "sources")}

    # ---- looking ----

    def stats(self, namespace: str | None = None) -> DataFrame:
        return catalog.stats(self.chunks(namespace))

    def files(self, file_type: str | None = None, namespace: str | None = None) -> DataFrame:
        return catalog.file_listing(self.chunks(namespace), file_type)

    def file_chunks(self, path: str, namespace: str | None = None) -> DataFrame:
        return catalog.file_chunks(self.chunks(namespace), path)

    def namespaces(self) -> DataFrame:
        """Those that have chunks, those that were made, and the default one."""
        names = {"default", *(ns for ns, _ in self.store.parts()), *self.store.names()}
        return self.spark.createDataFrame([(x,) for x in sorted(names)], "namespace string")

    def create_namespace(self, name: str) -> bool:
        """Make a namespace; False if it is there already."""
        name = namespace_name(name)
        with self._lock:
            known = name in {r.namespace for r in self.namespaces().collect()}
            if not known:
                self.store.set_names({*self.store.names(), name})
        return not known

    def delete_namespace(self, name: str) -> int:
        """Remove a namespace with its chunks and its index; the number of chunks removed. The default one stays, empty."""
        name = namespace_name(name)
        with self._lock:
            n = self.store.read(name).count()
            if n:
                self.store.commit(self.store.read().limit(0), {part for part in self.store.parts() if part[0] == name})
            self.store.set_names(self.store.names() - {name})
            self.store.remove(f"bm25/{name}")
            self.store.remove(f"ann/{name}")
        self.audit("delete namespace", name)
        return n

    def scroll(self, after: str | None = None, limit: int = 100, namespace: str | None = None) -> tuple[DataFrame, str | None]:
        """The next chunks in order of point_id after a cursor, and the cursor behind them; None at the end. Each page looks at all ids."""
        x = self.chunks(namespace)
        page = (x if after is None else x.where(F.col("point_id") > after)).orderBy("point_id").limit(limit)
        last = page.agg(F.max("point_id"), F.count("*")).first()
        return page, last[0] if last[1] == limit else None

    def scroll_parts(self, after: str | None = None, limit: int = 100, namespace: str | None = None) -> tuple[DataFrame, str | None]:
        """As scroll(), for going through a whole namespace: the next chunks in order of (part, file_path, chunk_index) after a cursor, and the cursor behind them; None at the end.

        A cursor names the version, the part and the place in it. A page reads the parts that it comes from, which are
        sorted, from that place on; it stays with its version as long as the store keeps it, and goes on in the current one
        after that.
        """
        ns = namespace or self.namespace
        version, bucket, path, number = json.loads(after) if after else (self.store.version(), -1, "", -1)
        if not self.store.has(f"versions/{version}"):
            version = self.store.version()
        pages, left, last = [], limit, None
        for b in sorted(b for n, b in self.store.parts(version) if n == ns and b >= bucket):
            x = self.store.read(only={(ns, b)}, version=version)
            x = x if self.grants is None else catalog.allowed(x, self.grants, None)
            if b == bucket:
                x = x.where(F.col("file_path") >= path).where((F.col("file_path") > path) | (F.col("chunk_index") > number))
            page = x.orderBy("file_path", "chunk_index").limit(left)
            n, end = page.agg(F.count("*"), F.max(F.struct("file_path", "chunk_index"))).first()
            if n:
                pages.append(page)
                left, last = left - n, json.dumps([version, b, *end])
            if not left:
                break
        out = reduce(DataFrame.unionByName, pages) if pages else self.store.read().limit(0)
        return out, last if not left else None

    def collection_info(self, namespace: str | None = None) -> DataFrame:
        """One row: points_count, segments_count (the store's parts), indexed_vectors_count, status, payload_schema (columns that any chunk fills)."""
        ns = namespace or self.namespace
        chunks = self.chunks(ns)
        payload = [c for c in chunks.columns if c not in ("point_id", "embedding")]
        filled = F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in payload]))
        segments_count = sum(n == ns for n, _ in self.store.parts())
        status = F.lit("green" if self.store.version() else "empty")
        return chunks.agg(F.count("*").alias("points_count"), F.lit(segments_count).alias("segments_count"), F.count("embedding").alias("indexed_vectors_count"), status.alias("status"), filled.alias("payload_schema"))

    def _note(self, query: str, mode: str) -> None:
        self._recent = [{"query": query, "mode": mode, "at": datetime.now(UTC)}, *self._recent][:20]
        self.audit("search", query)

    def recent(self) -> list[dict]:
        """The last twenty searches of this engine, newest first."""
        return list(self._recent)

    def audit(self, operation: str, detail: str, key: str | None = None) -> None:
        """Append one row to the audit log."""
        row = self.spark.createDataFrame([(datetime.now(UTC), operation, self.namespace, key, detail)], "timestamp timestamp, operation string, namespace string, key string, detail string")
        hashed = row.select(F.uuid().alias("id"), "timestamp", "operation", "namespace", F.substring(F.sha2("key", 256), 1, 16).alias("key_hash"), "detail")
        hashed.coalesce(1).write.mode("append").parquet(f"{self.root}/audit")

    def audit_log(self) -> DataFrame:
        return self.spark.read.schema("id string, timestamp timestamp, operation string, namespace string, key_hash string, detail string").parquet(f"{self.root}/audit")

    def doctor(self) -> DataFrame:
        """check, status (ok, warn or fail) and detail of what the engine needs."""
        rows = []

        def check(name: str, test: Callable[[], str], bad: str = "fail") -> None:
            try:
                rows.append((name, "ok", test()))
            except Exception as e:  # whatever a check raises is its result
                rows.append((name, bad, str(e).splitlines()[0][:200] if str(e) else type(e).__name__))

        def package(name: str) -> Callable[[], str]:
            def test() -> str:
                if importlib.util.find_spec(name) is None:
                    raise ImportError(f"{name} is not installed")
                return name

            return test

        check("spark", lambda: self.spark.version)
        check("time zone", lambda: self.spark.conf.get("spark.sql.session.timeZone"))
        check("store", lambda: f"version {self.store.version()}")
        check("chunks", lambda: f"{self.store.read().count()} rows")
        check("embedder", lambda: f"{len(self.embed('test'))} dimensions")
        check("generator", lambda: "set" if self.generate else (_ for _ in ()).throw(RuntimeError("no generator is set")), "warn")
        check("pdf", package("fitz"), "warn")
        check("spreadsheets", package("openpyxl"), "warn")
        return self.spark.createDataFrame(rows, "check string, status string, detail string")

    # ---- copies of the store ----

    def push(self, other: str, full: bool = False) -> int:
        """Bring another root's rows to this store's: all of them, or only new and changed ones. The number copied.

        The checksums of both stores' parts are compared first, and parts that are equal are neither read nor written.
        Without full, rows that only the other store has stay there; with it, the other store holds this one's rows alone.
        """
        target = Store(self.spark, other)
        version = target.version()
        mine, theirs = self.store.manifest(), target.manifest(version)
        differ = {part for part in (mine.keys() | theirs.keys() if full else mine.keys()) if mine.get(part, ("", ""))[1] != theirs.get(part, ("", ""))[1]}
        if not differ:
            return 0
        own, old = self.store.read(only=differ), target.read(only=differ, version=version)
        rows = (own if full else catalog.sync_delta(own, old)).persist()
        n = rows.count()
        if n or full:
            target.commit(rows if full else catalog.upsert(old, rows.select(*old.columns)), differ, version)
        rows.unpersist()
        return n

    def pull(self, other: str, full: bool = False) -> int:
        return Engine(self.spark, other, self.namespace).push(self.root, full)

    # ---- watching ----

    def watch(self, folder: str, checkpoint: str, debounce: str = "500 milliseconds", once: bool = False):
        """Keep the namespace in step with a folder; the running query. One query runs for each folder."""
        if folder in self._watches:
            return self._watches[folder]
        events = file_sources.watch(self.spark, folder, f"{checkpoint.rstrip('/')}-snapshots", file_sources.SUPPORTED)

        def changed(paths: DataFrame) -> None:
            if not paths.isEmpty():
                self.index(files=file_sources.read_paths(paths), force=True)

        def deleted(paths: DataFrame) -> None:
            if not paths.isEmpty():
                with self._lock:
                    self.store.change(paths.select(F.lit(self.namespace).alias("namespace"), F.col("path").alias("file_path")))

        query = streaming.start(events, changed, deleted, checkpoint, debounce, once)
        self._watches[folder] = query
        if not once:
            self.store.set_watches(self.store.watches() | {folder: [checkpoint, debounce]})
        return query

    def resume_watches(self) -> list[str]:
        """Start the queries of all folders that the store remembers as watched, as after a restart."""
        for folder, (checkpoint, debounce) in self.store.watches().items():
            self.watch(folder, checkpoint, debounce)
        return sorted(self._watches)

    def unwatch(self, folder: str) -> None:
        query = self._watches.pop(folder, None)
        self.store.set_watches({f: w for f, w in self.store.watches().items() if f != folder})
        if query is not None:
            query.stop()

    def watching(self) -> dict[str, bool]:
        return {folder: q.isActive for folder, q in self._watches.items()}


__all__ = ["Column", "Engine", "chunk_files", "namespace_name"]
