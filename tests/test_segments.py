"""The kept BM25 index: commits, merges and pruned searches against an index that is built anew."""

import math
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, segments
from quarry.plans import queries

WORDS = [f"w{i}" for i in range(400)]


def texts(seed, ids, n=40):
    """Documents whose words follow a steep distribution, as those of language do."""
    r = random.Random(seed)
    return [(i, " ".join(WORDS[min(399, int(r.paretovariate(0.7)) - 1)] for _ in range(r.randint(1, n)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def state(index):
    return {(r.term, r.df) for r in index.frequencies().collect()}, {(r.id, r.term, r.tf, r.dl) for r in index.postings().collect()}, {(r.id, r.dl) for r in index.docs().collect()}, index.manifest.n, round(index.manifest.avgdl, 9), round(index.mean_idf(), 9)


def built(docs):
    x = bm25.build(docs, "id", "text")
    n, avgdl, _, mean = x.corpus.first()
    dl = {r.id: r.dl for r in x.lengths.collect()}
    return {(r.term, r.df) for r in x.terms.collect()}, {(r.id, r.term, r.tf, dl[r.id]) for r in x.postings.collect()}, set(dl.items()), n, round(avgdl or 0.0, 9), round(mean or 0.0, 9)


def hits(df):
    return [(r.rank, r.id, round(r.score, 8)) for r in df.orderBy("rank").collect()]


def same(index, docs, *queries, top_k=10):
    fresh = bm25.build(docs, "id", "text")
    for q in queries:
        assert hits(bm25.search(index, q, top_k)) == hits(bm25.search(fresh, q, top_k)), q
        assert sorted((r.id, round(r.score, 8)) for r in bm25.score(index, q).collect()) == sorted((r.id, round(r.score, 8)) for r in bm25.score(fresh, q).collect())


def test_commits_equal_a_new_build(spark, tmp_path):
    one = [("a", "alpha beta gamma"), ("b", "beta beta delta"), ("c", "fox"), ("d", None)]
    two = [("a", "delta epsilon zeta"), ("b", "beta beta delta"), ("e", "fox fox alpha"), ("f", "")]
    index = segments.Kept.create(frame(spark, one), str(tmp_path), "id")
    assert state(index) == built(frame(spark, one))
    index.commit(frame(spark, [two[0], *two[2:]]), frame(spark, [("a", ""), ("c", ""), ("d", ""), ("never", "")]).select("id"), "id")
    index = segments.Kept.open(spark, str(tmp_path))
    assert state(index) == built(frame(spark, two))
    same(index, frame(spark, two), "fox", "delta beta", "alpha alpha fox", "nothing", "")
    index.commit(None, frame(spark, two).select("id"))
    assert index.manifest.n == 0 and index.frequencies().count() == 0 and hits(index.search("fox")) == []
    index.commit(frame(spark, one), None, "id")
    assert state(index) == built(frame(spark, one))


def test_empty_index(spark, tmp_path):
    index = segments.Kept.create(frame(spark, []), str(tmp_path), "id")
    assert hits(index.search("fox")) == [] and index.mean_idf() == 0.0
    assert index.search_many(spark.createDataFrame([(1, "fox")], "item_id long, text string")).count() == 0
    assert segments.Kept.open(spark, str(tmp_path / "nowhere")) is None


def test_many_commits_merge(spark, tmp_path):
    """Segments stay few, merged ones keep tombstones for older segments, and the average length moves."""
    docs = dict(texts(1, [f"d{i}" for i in range(60)]))
    index = segments.Kept.create(frame(spark, list(docs.items())), str(tmp_path), "id")
    for k in range(9):
        fresh = dict(texts(k + 2, [f"d{k}", f"n{k}"], n=300))
        index.commit(frame(spark, list(fresh.items())), frame(spark, [(f"d{k}", ""), (f"d{50 + k}", ""), (f"n{k - 2}", "")]).select("id"), "id")
        for gone in (f"d{50 + k}", f"n{k - 2}"):
            docs.pop(gone, None)
        docs |= fresh
    assert len(index.manifest.segments) < 9 and any(s.folder.startswith("m") for s in index.manifest.segments)
    now = frame(spark, list(docs.items()))
    assert state(index) == built(now)
    same(index, now, "w0", "w0 w1 w7", "w3 w3 w250")


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_a_commit_writes_what_it_changes(spark, tmp_path):
    written = []
    for n in (200, 4000):
        index = segments.Kept.create(frame(spark, texts(3, [f"d{i}" for i in range(n)])), str(tmp_path / str(n)), "id")
        whole = size(tmp_path / str(n))
        index.commit(frame(spark, [("d7", "one new text of w0 and w3")]), frame(spark, [("d7", "")]).select("id"), "id")
        written.append(size(tmp_path / str(n) / index.manifest.segments[-1].folder))
    assert written[1] < 1.2 * written[0] and written[1] < whole / 5


def test_a_commit_keeps_no_terms_in_memory(spark, tmp_path, monkeypatch):
    """Documents that leave are not cached, texts are counted without a shuffle, and a file of documents has row groups of a few."""
    monkeypatch.setattr(segments, "DOCS_GROUP", 64 << 10, raising=False)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    docs = dict(texts(5, [f"d{i}" for i in range(3000)], n=80)) | {"none": None, "same": "w1 w0 W1 w1", "blank": " .,"}
    index = segments.Kept.create(frame(spark, list(docs.items())).coalesce(1), str(tmp_path), "id")
    fresh = dict(texts(6, ["d1", "x"])) | {"same": "w2 w2"}
    index.commit(frame(spark, list(fresh.items())), frame(spark, [(i, "") for i in (*list(docs)[:1500], "same", "blank")]).select("id"), "id")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
    left = {i: t for i, t in docs.items() if i not in (*list(docs)[:1500], "same", "blank")} | fresh
    assert state(index) == built(frame(spark, list(left.items())))
    sizes = [f.metadata.row_group(k).num_rows for p in (tmp_path / index.manifest.segments[0].folder / "docs").glob("*.parquet") for f in [pq.ParquetFile(p)] for k in range(f.num_row_groups)]
    assert sum(sizes) == 3003 and max(sizes) < 1500
    assert "Exchange" not in segments._counted(bm25.stamped(frame(spark, []), "id"))._jdf.queryExecution().executedPlan().toString()


def test_what_a_task_sorts_does_not_grow_with_the_documents(spark, tmp_path, monkeypatch):
    """More words make more tasks, whatever the number of shuffle partitions, and a pass has few enough of them that rows are not held before the shuffle."""
    monkeypatch.setattr(segments, "TASK_WORDS", 4_000, raising=False)
    monkeypatch.setattr(segments, "RANGES", 4, raising=False)
    docs = frame(spark, texts(7, [f"d{i}" for i in range(3000)]))
    index = segments.Kept.create(docs, str(tmp_path), "id")
    tasks = math.ceil(index.manifest.tokens / 4_000)
    jobs = {}
    for p in (tmp_path / index.manifest.segments[0].folder / "blocks").glob("part-*.parquet"):
        jobs.setdefault(p.name[11:47], []).append(sum(pq.read_table(p, columns=["size"])["size"].to_pylist()))
    assert tasks > 8 and len(jobs) == math.ceil(tasks / 4) and all(len(sizes) <= 4 for sizes in jobs.values())
    assert max(max(sizes) for sizes in jobs.values()) <= 2 * 4_000
    assert state(index) == built(docs)
    same(index, docs, "w0", "w0 w1 w7", "w3 w3 w250")
    index.commit(frame(spark, texts(8, [f"d{i}" for i in range(400)], n=90)), frame(spark, [(f"d{i}", "") for i in range(900)]).select("id"), "id")
    now = docs.where("int(substr(id, 2)) >= 900").unionByName(frame(spark, texts(8, [f"d{i}" for i in range(400)], n=90)))
    assert state(index) == built(now)
    same(index, now, "w0 w1 w7")


def test_a_commit_that_fails_leaves_the_old_version(spark, tmp_path, monkeypatch):
    docs = frame(spark, texts(4, [f"d{i}" for i in range(50)]))
    index = segments.Kept.create(docs, str(tmp_path), "id")
    before = state(index)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(segments.Kept, "_swap", broken)
        with pytest.raises(RuntimeError):
            index.commit(frame(spark, [("x", "fox")]), docs.select("id").limit(5), "id")
    index = segments.Kept.open(spark, str(tmp_path))
    assert state(index) == before
    index.commit(frame(spark, [("x", "fox")]), None, "id")
    assert {p for p in os.listdir(tmp_path) if os.path.isdir(tmp_path / p)} == {s.folder for s in index.manifest.segments}
    assert hits(index.search("fox"))[0][1] == "x"


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path):
    """A rare and a common term: same hits, fewer blocks, and the condition reaches the scan of blocks; lengths stand inside."""
    rows = [(f"d{i}", "common " * (1 + i % 7) + " ".join(f"f{i % 97}x{j}" for j in range(i % 50)) + (" rare" if i % 400 == 0 else "")) for i in range(6000)]
    rows += [(f"e{i}", "nothing of that") for i in range(9000)]  # so that the common term has a positive weight
    docs = frame(spark, rows)
    index = segments.Kept.create(docs, str(tmp_path), "id")
    same(index, docs, "common", "rare common", "common f3x1")
    total = index.blocks().where("term = 'common'").count()
    needed = index.blocks().where(index.needed(index.weights({"common": 1}), 10))
    assert total >= 6000 / segments.BLOCK and needed.where("term = 'common'").count() <= 0.2 * total
    plan = needed._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(impact" in plan
    files = index.search("common").inputFiles()
    assert files and all("/blocks/" in f for f in files)


def test_filters_come_before_ranking(spark, tmp_path):
    docs = frame(spark, texts(6, [f"d{i}" for i in range(500)]))
    index, fresh = segments.Kept.create(docs, str(tmp_path), "id"), bm25.build(docs, "id", "text")
    some = docs.where("id LIKE 'd%7'").select("id")
    for q in ("w0", "w1 w5", "w2 w0 w9"):
        assert hits(bm25.search(index, q, 5, some)) == hits(bm25.search(fresh, q, 5, some)) != []


def test_batches_equal_single_searches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MANY", 0)  # all terms are dealt to several tasks
    docs = frame(spark, texts(8, [f"d{i}" for i in range(700)]))
    index = segments.Kept.create(docs, str(tmp_path), "id")
    index.commit(frame(spark, texts(9, [f"d{i}" for i in range(30)], n=200)), frame(spark, [(f"d{i}", "") for i in range(40)]).select("id"), "id")
    asked = [(1, "w0 w3"), (2, "w7"), (3, "w0 w0 w1 w2 w399"), (4, ""), (5, None), (6, "unknown")]
    got = index.search_many(spark.createDataFrame(asked, "item_id long, text string"), top_k=7).collect()
    for i, q in asked:
        assert [(r.rank, r.id, round(r.score, 8)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == hits(index.search(q or "", 7))


def test_a_search_after_a_change_finds_no_terms_in_memory(spark, sf, monkeypatch):
    """What bm25_changed and bm25_changed_stats read was written by the commit; nothing of it stays cached."""
    monkeypatch.setattr(queries, "_KEPT", {})
    before = {*spark.sparkContext._jsc.getPersistentRDDs()}
    got = hits(queries.QUERIES["bm25_changed"](spark, sf))
    assert {*spark.sparkContext._jsc.getPersistentRDDs()} <= before
    left = queries.docs(spark, sf).where("doc_id % 3 <> 1")
    assert got == hits(queries.rounded(bm25.search(bm25.build(left), queries.ASKED, 20)))
