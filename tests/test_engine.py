"""The facade over real files: index, search, refine, ask, delete, sync, watch."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.api import Engine, namespace_name
from quarry.operators import bm25
from quarry.sources import files as sources

FOX = "The quick brown fox jumps over the lazy dog near the river bank while the morning light falls on the meadow and birds sing. "
PRICE = "Pricing strategy for the new product line covers discounts, recurring revenue, quarterly goals and the market in detail. "


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "fox.txt").write_text(FOX * 3)
    (d / "price.md").write_text("# Plan\n" + PRICE * 3)
    (d / "copy.txt").write_text(FOX * 3)
    (d / "data.csv").write_text("Name,City,Score\n" + "".join(f"n{i},c{i},{i}\n" for i in range(20)))
    (d / "hello.py").write_text("def hello():\n" + "    print('hello world')\n" * 8)
    (d / "mail.eml").write_text("From: a@example.com\nTo: b@example.com\nSubject: Hi\nDate: today\n\n" + "Body of the mail about invoices. " * 6)
    (d / "skip.bin").write_bytes(b"\0\1")
    return d


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", generate=lambda p: iter(["an ", "answer"]))
    s = e.index(str(folder))
    assert (s.total, s.new, s.updated, s.duplicates) == (6, 5, 0, 1)
    return e


def test_second_run_skips(engine, folder):
    s = engine.index(str(folder))
    assert (s.new, s.updated, s.chunks) == (0, 0, 0) and s.skipped == 6


def test_first_path_of_equal_files_wins(engine):
    assert {os.path.basename(r.file_path) for r in engine.files().collect()} == {"copy.txt", "price.md", "data.csv", "hello.py", "mail.eml"}


@pytest.mark.parametrize("mode", ["keyword", "semantic", "hybrid"])
def test_search_modes(engine, mode):
    rows = engine.search("pricing revenue", mode, 3).orderBy("rank").collect()
    assert rows and rows[0].file_name == "price.md" and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_search_rejects_modes_and_filters(engine):
    with pytest.raises(ValueError):
        engine.search("x", "magic")
    assert {r.file_type for r in engine.search("the fox and pricing", top_k=5, file_type=".txt").collect()} <= {".txt"}
    assert engine.search("   ").count() == 0


def index_rows(index):
    """Terms, postings and lengths of a kept index, or of one that is built for a search."""
    if isinstance(index, bm25.Index):
        return {(r.term, r.df) for r in index.terms.collect()}, {(r.id, r.term, r.tf) for r in index.postings.collect()}, {(r.id, r.dl) for r in index.lengths.collect()}
    return {(r.term, r.df) for r in index.frequencies().collect()}, {(r.id, r.term, r.tf) for r in index.postings().collect()}, {(r.id, r.dl) for r in index.docs().collect()}


def test_engine_keeps_its_index(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    others = [(f"o{i}.txt", f"Note {i} tells of trains, bridges and rivers of the north, with maps of roads and lakes. " * 3) for i in range(5)]
    for name, text in [("a.txt", FOX * 3), ("b.txt", PRICE * 3), *others]:
        (tmp_path / "docs" / name).write_text(text)
    e = Engine(spark, f"file://{tmp_path}/store")
    e.index(str(tmp_path / "docs"))
    assert {r.file_name for r in e.search("pricing", "keyword").collect()} == {"b.txt"}
    kept = e.keyword_index()
    plan = kept.blocks().where(F.col("term") == "pricing")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,pricing)]" in plan and "Generate" not in plan
    (tmp_path / "docs" / "a.txt").write_text(FOX * 2 + "A pricing note. " * 10)
    (tmp_path / "docs" / "c.txt").write_text("Penguins live on ice and eat fish that they catch in the cold sea near the shore. " * 3)
    e.index(str(tmp_path / "docs"))
    assert len(e.keyword_index().manifest.segments) == 2 and {r.file_name for r in e.search("pricing", "keyword").collect()} == {"a.txt", "b.txt"} and e.search("penguins", "keyword").count() > 0
    assert index_rows(e.keyword_index()) == index_rows(bm25.build(e.chunks(), "point_id", "chunk_text"))
    e.delete(str(tmp_path / "docs" / "c.txt"))
    assert e.search("penguins", "keyword").count() == 0


def test_refine_and_ask(engine):
    assert engine.refine_search("fox", add=["pricing strategy"], subtract=["dog"], top_k=2).count() == 2
    out = engine.ask("pricing?", "semantic", 2)
    assert out["answer"] == "an answer" and out["sources"]
    assert [e["event"] for e in engine.ask_stream("fox", "keyword", 1)] == ["token", "token", "sources", "done"]


def test_stats_doctor_recent_audit(engine):
    row = engine.stats().first()
    assert row.total_files == 5 and ".py=" in row.file_types
    assert {r.status for r in engine.doctor().collect()} <= {"ok", "warn"}
    assert engine.recent()[0]["query"] and engine.audit_log().where("operation = 'index'").count() >= 1


def test_update_delete_push(spark, engine, folder, tmp_path):
    (folder / "price.md").write_text("# Plan\n" + FOX + PRICE)
    s = engine.index(str(folder))
    assert (s.new, s.updated) == (0, 1)
    assert engine.file_chunks(str(folder / "price.md")).count() == 1
    other = f"file://{tmp_path}/other"
    n = engine.store.read().count()
    assert engine.push(other) == n and engine.push(other) == 0
    assert engine.delete(str(folder / "price.md")) == 1
    assert "price.md" not in {r.file_name for r in engine.files().collect()}
    assert Engine(spark, other).store.read().count() == n


def test_namespaces(spark, engine, folder):
    files = sources.scan(spark, str(folder), ["txt"])
    engine.index(files=files, namespace="other")
    assert [r.namespace for r in engine.namespaces().collect()] == ["default", "other"]
    assert engine.files(namespace="other").count() == 1
    assert namespace_name(" Ab-1 ") == "ab-1"
    with pytest.raises(ValueError):
        namespace_name("no spaces")


def test_namespace_life(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(4):
        (tmp_path / "d" / f"{i}.txt").write_text(f"{FOX * 2} number {i}")
    e = Engine(spark, f"file://{tmp_path}/store")
    assert e.create_namespace("Team") and not e.create_namespace("team") and [r.namespace for r in e.namespaces().collect()] == ["default", "team"]
    e.index(str(tmp_path / "d"), namespace="team")
    e.index(str(tmp_path / "d"))
    page, cursor = e.scroll(limit=3)
    rest, end = e.scroll(cursor, 3)
    assert [r.point_id for r in page.collect()] + [r.point_id for r in rest.collect()] == sorted(r.point_id for r in e.chunks().collect()) and cursor and end is None
    assert e.delete_namespace("team") == 4 and e.files(namespace="team").count() == 0 and e.files().count() == 4
    assert [r.namespace for r in e.namespaces().collect()] == ["default"]


def test_commits_touch_changed_parts_only(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(30):
        (tmp_path / "d" / f"{i}.txt").write_text(f"{FOX} number {i}")
    e = Engine(spark, f"file://{tmp_path}/store")
    e.index(str(tmp_path / "d"))
    before = e.store.parts()
    (tmp_path / "d" / "7.txt").write_text(PRICE * 2)
    e.index(str(tmp_path / "d"))
    after = e.store.parts()
    assert sum(before[p] != after[p] for p in before) == 1 and e.chunks().count() == 30
    e.delete(str(tmp_path / "d" / "8.txt"))
    e.delete(str(tmp_path / "d" / "9.txt"))
    assert e.chunks().count() == 28 and len(os.listdir(tmp_path / "store" / "versions")) <= 6


def test_own_embedder(spark, tmp_path):
    """An engine with a model of its own indexes and searches with it."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text(FOX * 2)
    (tmp_path / "d" / "b.txt").write_text(PRICE * 2)

    def embed(t):
        return [t.lower().count("fox") + 0.1, t.lower().count("pric") + 0.1, 0.0]

    e = Engine(spark, f"file://{tmp_path}/store", embed=embed)
    e.index(str(tmp_path / "d"))
    assert {len(r.embedding) for r in e.chunks().collect()} == {3}
    assert e.search("pricing", "semantic", 1).first().file_name == "b.txt"


def test_watch(spark, tmp_path):
    d = tmp_path / "w"
    d.mkdir()
    (d / "a.txt").write_text(FOX * 2)
    (d / "b.txt").write_text(PRICE * 2)
    e = Engine(spark, f"file://{tmp_path}/store")
    q = e.watch(str(d), f"{tmp_path}/cp", debounce="100 milliseconds")
    q.processAllAvailable()
    assert e.files().count() == 2
    (d / "a.txt").unlink()
    (d / "c.txt").write_text((FOX + PRICE) * 2)
    q.processAllAvailable()
    assert {r.file_name for r in e.files().collect()} == {"b.txt", "c.txt"}
    q.stop()
    again = Engine(spark, f"file://{tmp_path}/store")
    assert again.resume_watches() == [str(d)]
    (d / "d.txt").write_text(FOX * 3)
    again._watches[str(d)].processAllAvailable()
    again.unwatch(str(d))
    assert {r.file_name for r in again.files().collect()} == {"b.txt", "c.txt", "d.txt"}
    assert again.watching() == {} and again.resume_watches() == []


def test_grants(spark, engine):
    grants = spark.createDataFrame([("k", "default")], "key string, namespace string").select(F.substring(F.sha2("key", 256), 1, 16).alias("key_hash"), "namespace")
    e = Engine(spark, engine.root, grants=grants)
    assert e.chunks(key="k").count() > 0 and e.chunks(key="other").count() == 0 and e.chunks().count() == 0
