"""Commits by several writers, and the watcher's snapshots."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.api import Engine
from quarry.operators.index import Conflict, Store
from quarry.schema import CHUNKS
from quarry.sources import files


def chunk(path, text, n=1):
    base = dict.fromkeys(CHUNKS.fieldNames())
    return [tuple((base | {"namespace": "default", "point_id": f"{path}-{i}", "file_path": path, "file_name": path, "file_type": ".txt", "chunk_index": i, "chunk_text": text, "file_hash": text})[c] for c in CHUNKS.fieldNames()) for i in range(n)]


def frame(spark, *rows):
    return spark.createDataFrame([r for x in rows for r in x], CHUNKS)


def named(spark, *paths):
    return spark.createDataFrame([("default", p) for p in paths], "namespace string, file_path string")


def content(store):
    return {(r.file_path, r.chunk_text) for r in store.read().collect()}


def bucket_of(spark, path):
    return spark.range(1).select(Store.bucket(F.lit(path))).first()[0]


@pytest.fixture
def paths(spark):
    """Two paths of one part, and one of another."""
    found = {}
    for i in range(200):
        found.setdefault(bucket_of(spark, f"p{i}"), []).append(f"p{i}")
        if two := next((p for p in found.values() if len(p) == 2), None):
            return *two, next(p[0] for p in found.values() if p is not two)
    raise AssertionError


def test_two_writers(spark, tmp_path, paths):
    """Of different parts both land; of one part the later is refused, and change() begins anew from the other's version."""
    a, b, c = paths
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.change(named(spark, a), frame(spark, chunk(a, "old")))
    base = one.version()
    part = lambda p: {("default", bucket_of(spark, p))}
    two.commit(frame(spark, chunk(c, "other part")), part(c), base)
    assert one.commit(frame(spark, chunk(a, "new")), part(a), base) == base + 2
    assert content(one) == {(a, "new"), (c, "other part")}
    with pytest.raises(Conflict):
        two.commit(frame(spark, chunk(b, "lost update")), part(b), base)
    assert content(two) == {(a, "new"), (c, "other part")}
    # a whole-table commit from an older version is refused as well
    with pytest.raises(Conflict):
        two.commit(frame(spark, chunk(b, "all")), None, base)

    publish, raced = Store._publish, []

    def race(self, v, parts):
        if not raced:
            raced.append(1)
            one.change(named(spark, b), frame(spark, chunk(b, "first")))  # another writer is faster, in the same part
        return publish(self, v, parts)

    Store._publish = race
    try:
        two.change(named(spark, a), frame(spark, chunk(a, "second")))
    finally:
        Store._publish = publish
    assert content(one) == content(two) == {(a, "second"), (b, "first"), (c, "other part")}


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path, paths, monkeypatch):
    a, b, _ = paths
    store = Store(spark, f"file://{tmp_path}/s")
    store.change(named(spark, a), frame(spark, chunk(a, "old")))
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.change(named(spark, b), frame(spark, chunk(b, "new")))
    assert content(store) == {(a, "old")} and store.version() == 1
    store.change(named(spark, b), frame(spark, chunk(b, "new")))
    assert content(store) == {(a, "old"), (b, "new")}


def reader(root, state):
    return files._Watch({"path": str(root), "state": str(state)})


def events(r, start, end):
    return sorted((e, os.path.basename(p)) for part in r.partitions(start, end) for e, p, _ in r.read(part))


def test_offsets_do_not_grow(tmp_path):
    sizes = []
    for n in (10, 2000):
        root = tmp_path / str(n)
        root.mkdir()
        for i in range(n):
            (root / f"f{i}.txt").write_text("x")
        r = reader(root, tmp_path / f"state{n}")
        start, end = r.initialOffset(), r.latestOffset()
        assert len(events(r, start, end)) == n and r.latestOffset() == end
        sizes.append(len(json.dumps(end)))
    assert sizes[0] == sizes[1]


def test_snapshots_replay_and_are_dropped(tmp_path):
    root, state = tmp_path / "w", tmp_path / "state"
    (root / "sub").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "sub/c.txt"):
        (root / name).write_text("x")
    r = reader(root, state)
    offsets = [r.initialOffset(), r.latestOffset()]
    assert events(r, *offsets) == [("created", "a.txt"), ("created", "b.txt"), ("created", "c.txt")]
    (root / "a.txt").write_text("longer")
    (root / "b.txt").unlink()
    (root / "sub/d.txt").write_text("x")
    offsets.append(r.latestOffset())
    want = [("created", "d.txt"), ("deleted", "b.txt"), ("modified", "a.txt")]
    assert events(r, *offsets[1:]) == want
    (root / "e.txt").write_text("x")
    offsets.append(reader(root, state).latestOffset())
    assert events(reader(root, state), *offsets[1:3]) == want  # a restarted reader replays the same events
    assert events(r, *offsets[2:]) == [("created", "e.txt")]
    r.commit(offsets[3])
    assert sorted(os.listdir(state)) == [str(offsets[3]["snapshot"])]
    late = files._Watch({"path": str(root), "state": str(tmp_path / "late"), "includeexisting": "false"})
    assert events(late, late.initialOffset(), late.latestOffset()) == []


def test_only_named_files_are_opened(spark, tmp_path, monkeypatch):
    for i in range(20):
        (tmp_path / f"f{i}.txt").write_text("word " * 30 + str(i))
    asked = spark.createDataFrame([(f"{tmp_path}/f3.txt",), (f"{tmp_path}/gone.txt",), (f"{tmp_path}/f5.txt",)], "path string")
    rows = {r.file_name: r for r in files.read_paths(asked).collect()}
    scanned = {r.file_name: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"f3.txt", "f5.txt"} and all(rows[n] == scanned[n] for n in rows)
    assert files.read_paths(asked, max_bytes=10).count() == 0


def test_a_watched_change_reads_no_folder(spark, tmp_path, monkeypatch):
    """After the first listing a micro-batch opens the files of its events: scanning is not used at all."""
    d = tmp_path / "w"
    d.mkdir()
    for i in range(5):
        (d / f"f{i}.txt").write_text(f"note {i} of trains, bridges and rivers " * 5)
    monkeypatch.setattr(files, "scan", lambda *_, **__: (_ for _ in ()).throw(AssertionError("scanned")))
    seen = []
    index = Engine.index
    monkeypatch.setattr(Engine, "index", lambda self, *a, files=None, **k: (seen.append({r.file_name for r in files.select("file_name").collect()}), index(self, *a, files=files, **k))[1])
    e = Engine(spark, f"file://{tmp_path}/store")
    q = e.watch(str(d), f"{tmp_path}/cp", debounce="100 milliseconds")
    q.processAllAvailable()
    (d / "f2.txt").write_text("another text about lakes and roads " * 5)
    q.processAllAvailable()
    e.unwatch(str(d))
    assert seen[-1] == {"f2.txt"} and e.files().count() == 5 and e.search("lakes", "keyword").first().file_name == "f2.txt"


def test_push_compares_manifests(spark, tmp_path, paths, monkeypatch):
    """Equal stores move nothing and read no chunk; a changed file moves its part alone; rows of the target stay unless full."""
    a, b, c = paths
    mine, other = Engine(spark, f"file://{tmp_path}/one"), f"file://{tmp_path}/two"
    mine.store.change(named(spark, a, c), frame(spark, chunk(a, "old", 2), chunk(c, "other")))
    assert mine.push(other) == 3 and content(Store(spark, other)) == content(mine.store)
    with monkeypatch.context() as m:
        m.setattr(Store, "read", lambda *_, **__: (_ for _ in ()).throw(AssertionError("read")))
        assert mine.push(other) == 0 and mine.push(other, full=True) == 0 and mine.pull(other) == 0
    before = Store(spark, other).parts()
    mine.store.change(named(spark, a), frame(spark, chunk(a, "new", 1)))
    assert mine.push(other) == 1
    after = Store(spark, other).parts()
    assert {p for p in after if after[p] != before[p]} == {("default", bucket_of(spark, a))}
    Store(spark, other).change(named(spark, b), frame(spark, chunk(b, "theirs")))
    assert mine.push(other) == 0 and (b, "theirs") in content(Store(spark, other))
    assert mine.push(other, full=True) == 1 and content(Store(spark, other)) == content(mine.store)
    assert mine.store.manifest()[("default", bucket_of(spark, a))][1] == Store(spark, other).manifest()[("default", bucket_of(spark, a))][1]


def test_models_get_lists(spark, tmp_path):
    """A model is made once in a worker and called with lists; the vectors are those of single calls."""
    from quarry.operators.index import BatchModel, embedded

    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        import os as _os

        def log(kind, n):
            with open(f"{calls}/{_os.getpid()}", "a") as f:
                f.write(f"{kind} {n}\n")

        log("load", 0)

        def encode(texts):
            log("call", len(texts))
            return [[len(t), t.count("a")] for t in texts]

        return encode

    rows = spark.createDataFrame([(str(i), "a" * (i % 7) + "b" * i) for i in range(300)], "point_id string, chunk_text string").repartition(2)
    model = BatchModel(load, batch=50)
    got = {r.point_id: list(r.embedding) for _ in range(2) for r in embedded(rows, model).collect()}
    assert got == {str(i): [i % 7 + i, i % 7] for i in range(300)}
    logs = [f.read_text().split("\n")[:-1] for f in calls.iterdir()]
    assert all(sum(x == "load 0" for x in one) == 1 for one in logs)
    sizes = [int(x.split()[1]) for one in logs for x in one if x.startswith("call")]
    assert sum(sizes) == 600 and len(sizes) <= 20 and max(sizes) == 50
    assert list(model("abc")) == [3, 1]


def test_scroll_reads_parts_in_turn(spark, tmp_path, monkeypatch):
    """Every chunk once, whatever the page; a page reads no part that it does not come from, and commits between pages do no harm."""
    e = Engine(spark, f"file://{tmp_path}/s")
    names = [f"p{i}" for i in range(40)]
    e.store.change(named(spark, *names), frame(spark, *(chunk(p, "text " + p, 3) for p in names)))
    want = {f"{p}-{i}" for p in names for i in range(3)}
    for limit in (7, 50, 120, 500):
        seen, cursor = [], None
        while True:
            page, cursor = e.scroll_parts(cursor, limit)
            got = page.collect()
            assert len(got) == limit or cursor is None
            seen += [r.point_id for r in got]
            if cursor is None:
                break
        assert len(seen) == len(want) and set(seen) == want
    page, cursor = e.scroll_parts(limit=10)
    first = {r.point_id for r in page.collect()}
    e.store.change(named(spark, "p39"))
    reads, read = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, *a, **k: (reads.append(k.get("only")), read(self, *a, **k))[1])
    page, after = e.scroll_parts(cursor, 10)
    assert not first & {r.point_id for r in page.collect()} and len(reads) <= 5 and all(len(r) == 1 for r in reads)
    rest, end = e.scroll_parts(after, 500)
    assert rest.count() == 100 and end is None  # the version of the first page
    e.store.change(named(spark, "p38"))
    e.store.change(named(spark, "p37"))
    rest, end = e.scroll_parts(after, 500)
    assert 91 <= rest.count() < 100 and end is None


def test_collection_info(spark, tmp_path, paths):
    a, _, c = paths
    e = Engine(spark, f"file://{tmp_path}/s")
    assert e.collection_info().first().asDict() == {"points_count": 0, "segments_count": 0, "indexed_vectors_count": 0, "status": "empty", "payload_schema": []}
    e.store.change(named(spark, a, c), frame(spark, chunk(a, "x", 2), chunk(c, "y")))
    info = e.collection_info().first()
    assert (info.points_count, info.segments_count, info.indexed_vectors_count, info.status) == (3, 2, 0, "green")
    assert info.payload_schema == ["namespace", "file_path", "file_name", "file_type", "chunk_index", "chunk_text", "file_hash"]
