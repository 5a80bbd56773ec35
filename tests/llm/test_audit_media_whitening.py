"""Operators 11, 12 and 13 against plain Python, on messy, empty and hostile tables."""

import glob
import hashlib
import io
import itertools
import re
import struct
import tarfile
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import audit, media, whitening
from quarry.llm.common import workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- op11 ----------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """{(part, order, step): figures} by applying the filters in every order, document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and first[t] < i}
        rows[lang or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part, those in rows.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = those
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                gone = sum(f in r[0] for r in those) - len(removed)
                shapley[f] += len(removed)
                out[part, order, step] = [len(left), len(removed), gone, sum(r[0] == {f} for r in those), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def got_audit(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_of_messy_rows(messy, labels, spark):
    """Nulls in every column, empty and long texts, equal rows, ids without label, and columns whose names clash."""
    extra = messy.sparkSession.createDataFrame(
        [(20, "SHOUT " * 120, "en"), (21, "SHOUT " * 120, None), (22, "a # b", ""), (None, "a # b", "en"), (None, None, None), (23, "a # b", "en"), (24, " ".join(f"w{i}" for i in range(200)), "fr"), (20, "other $ text", "en")], "doc_id long, text string, lang string"
    )
    docs = messy.select("doc_id", "text", "lang", *["size", "key", "removed"]).unionByName(extra, allowMissingColumns=True).withColumns({"digest": F.lit(1), "part": F.lit("x"), "good": F.lit(True), "n_words": F.lit(2)})
    more = labels.unionByName(spark.createDataFrame([(1, 0, 1), (20, None, 1), (24, 1, None)], "doc_id long, quality int, toxic int")).withColumn("fails", F.lit(3))
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()], [(r.doc_id, r.quality, r.toxic) for r in more.collect() if r.doc_id is not None])
    got = got_audit(audit.filter_audit(docs, more))
    assert got == want and len(got) == 600 * len({p for p, *_ in want})


def test_audit_of_large_groups(spark):
    """A third of all rows is one row, a third has no id, and a third are copies of one text."""
    docs = [(7, "same row", "en")] * 300 + [(None, f"no id {i % 3}", "en") for i in range(300)] + [(100 + i, "A COPY", "de" if i % 2 else None) for i in range(300)]
    labels = [(7, 1, 0), *[(100 + i, i % 2, 1) for i in range(0, 300, 3)]]
    got = got_audit(audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain_audit(docs, labels)


def test_audit_exchanges_texts_once(spark, sf):
    """The words are counted where their text is: the plan deals texts once and words not at all."""
    plan = audit.text_figures(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") >= 4


# ---- op12 ----------------------------------------------------------------------------------------


def test_formats():
    rng = np.random.default_rng(1)
    for n in (1, 2, 100):
        samples = rng.integers(0, 256, n * 192, np.uint8).tobytes()
        picture = media.png(samples)
        assert media.unpng(picture) == samples and media.header_fields(picture[: media.HEADER]) == ("png", 192, n, 1, 8, None)
        at = 8
        while at < len(picture):  # every chunk's checksum holds
            (size,) = struct.unpack(">I", picture[at : at + 4])
            assert zlib.crc32(picture[at + 4 : at + 8 + size]) == struct.unpack(">I", picture[at + 8 + size : at + 12 + size])[0]
            at += size + 12
    with wave.open(sound := io.BytesIO(), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(1)
        w.setframerate(16000)
        w.writeframes(b"\x80" * 100)
    assert media.header_fields(sound.getvalue()[: media.HEADER]) == ("wav", None, None, 2, None, 16000)
    assert media.header_fields(b"GIF89a\x03\x00\x02\x00\xf7\x00\x00") == ("gif", 3, 2, 1, 8, None)
    assert media.header_fields(b"") == media.header_fields(b"plain bytes") == (None,) * 6


def test_shards_hold_each_content_once(spark):
    """Any bytes, of sizes around the block of tar: members are what plain tar readers see, and ranges give them back."""
    bodies = [b"", b"x", b"\0" * 511, b"\n" * 512, b"y" * 513, bytes(range(256)) * 8, b"\0" * 1024, "é\n".encode() * 999, b"\xff\xfe" * 77]
    named = [(hashlib.sha256(b).hexdigest(), b) for b in bodies]
    rows = [*named, *[named[3]] * 200, (None, b"lost"), (named[0][0], None)]
    folder = media.store(spark.createDataFrame(rows, "digest string, media binary").repartition(7), total_bytes=3000, shard_bytes=1000)
    seen = {}
    for f in glob.glob(f"{folder.removeprefix('file:')}/part-*".replace("///", "/").replace("//", "/")):
        with tarfile.open(f) as t:
            for m in t.getmembers():
                if len(m.name) == 64:
                    assert m.name not in seen
                    seen[m.name] = (m.offset_data, m.size, t.extractfile(m).read())
    assert {d: b for d, (_, _, b) in seen.items()} == dict(named)
    members = media.index(spark, folder)
    assert {r.digest: (r.offset, r.length) for r in members.collect()} == {d: x[:2] for d, x in seen.items()}
    back = media.read_back(media.with_headers(members), lambda b: (hashlib.sha256(b).hexdigest(), len(b)), "again string, n long").collect()
    assert len(back) == len(bodies) and all(r.again == r.digest and r.n == r.length and r.format is None for r in back)


def test_index_refuses_other_files(spark):
    folder = workspace(spark)
    spark.range(5000).selectExpr("cast(id as string) as piece").coalesce(1).write.text(folder)
    with pytest.raises(Exception, match="has no index"):
        media.index(spark, folder).collect()


def plain_media(text):
    b = (text or "").encode()
    p = b.ljust(max(192, -(-len(b) // 192) * 192))
    m = media.png(p)
    return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), "png", 192, len(p) // 192


@pytest.mark.parametrize(("shard_bytes", "filter_bits"), [(media.SHARD_BYTES, media.FILTER_BITS), (2000, 3)])
def test_media_columns(messy, empty, monkeypatch, shard_bytes, filter_bits):
    """Also where shards are small and the filter is so small that it lets nearly all through."""
    monkeypatch.setattr(media, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(media, "FILTER_BITS", filter_bits)
    out = media.media_columns(messy)
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.length, r.media_sha256, r.format, r.width, r.height) for r in out.collect()]
    want = [(r.doc_id, *plain_media(r.text)) for r in messy.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    stored = {(r.shard, r.offset) for r in out.collect()}
    assert len(stored) == len({w[3] for w in want})  # one member for each different payload
    assert media.media_columns(empty).count() == 0


def test_op12_query(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, again = (media.op12_media_columns(spark, sf).collect() for _ in range(2))
    assert len(rows) == len(text) and sorted(map(str, rows)) == sorted(map(str, again))
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.format, r.width, r.height) == plain_media(text[r.doc_id])
        x = np.frombuffer(text[r.doc_id].encode().ljust(r.payload_bytes), np.uint8)
        assert r.feature.startswith(f"mean={x.mean():.4f} std={x.std():.4f} entropy=")


# ---- op13 ----------------------------------------------------------------------------------------


def plain_whitening(vectors, k=32):
    """n, deviations, covariance, eigenvalues and centred rows with Python's integers and numpy."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return n, deviation, v, e[::-1][:k], u[:, ::-1][:, :k], centred


def check_whitening(rows, ids, vectors, k):
    n, deviation, v, e, u, centred = plain_whitening(vectors, k)
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    assert len(rows) == n * len(e) and set(by) == set(ids)
    w = np.array([[by[i][c + 1].whitened for c in range(len(e))] for i in ids])
    for i, d in zip(ids, deviation, strict=True):
        assert all(r.deviation == d and r.n == n for r in by[i].values())
    want = centred @ u / np.sqrt(e)
    for c in range(len(e)):  # either sign, the same for all rows
        assert np.allclose(w[:, c], want[:, c], atol=1e-6) or np.allclose(w[:, c], -want[:, c], atol=1e-6)
        assert by[ids[0]][c + 1].explained == pytest.approx(e[c] / np.trace(v), rel=1e-9)
    error = np.abs(w.T @ w / n - np.eye(len(e))).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error <= 1e-9 and error <= 1e-9


def test_op13_query(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check_whitening(whitening.op13_embedding_whitening(spark, sf).collect(), [r.vec_id for r in x], [r.embedding for r in x], 32)


def test_whitening_of_messy_rows(spark):
    """Nulls, not finite entries, other widths, repeated rows, null ids and clashing names; fewer dimensions than components."""
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [1, 2, 3, 4, 5] + 7]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 2.0, 3.0, 4.0]), (103, [float("inf")] + [1.0] * 4), (104, [-float("inf")] * 5), (105, [1.0] * 4), (106, []), (107, [3e38] * 5)]
    rows = [*good, *[good[0]] * 3, (None, good[1][1]), *bad]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, component int, whitened double, w string").repartition(3)
    got = whitening.whiten(df).collect()
    kept = [v for _, v in rows if v in [g for _, g in good]]
    n, deviation, _, e, _, _ = plain_whitening(kept)
    assert n == 64 and len(got) == 64 * 5 and Counter(r.vec_id for r in got)[0] == 4 * 5 and Counter(r.vec_id for r in got)[None] == 5
    assert Counter(r.deviation for r in got) == Counter({d: 5 * k for d, k in Counter(deviation).items()})
    assert all(r.identity_error < 1e-9 for r in got) and {r.component for r in got} == {1, 2, 3, 4, 5}
    check_whitening(whitening.whiten(spark.createDataFrame(good, "vec_id long, embedding array<float>"), 3).collect(), [i for i, _ in good], [v for _, v in good], 3)


def test_whitening_without_variance(spark):
    """No row for no vector; one vector, equal vectors and dimensions that follow from others have null components."""
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert make([(1, None)]) == [] and make([(1, [])]) == []
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in make(rows)) and len(make(rows)) == 2 * len(rows)
    line = make([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9
    assert sum(r.explained for r in line) == pytest.approx(9)


def test_exact_deviation_beyond_doubles():
    x = np.array([[2**55 + 1, -(2**55)], [3, 4], [2**60, 7]], np.int64)
    sums = [int(s) for s in x.astype(object).sum(0)]
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening.exact_deviation(x, 3, sums) == [None if w >= 2**63 else w for w in want]
    small = np.array([[10**6 + 1, 10**6 - 5], [10**6, 10**6]], np.int64)
    assert whitening.exact_deviation(small, 2, [2 * 10**6 + 1, 2 * 10**6 - 5]) == [1 + 25, 1 + 25]
