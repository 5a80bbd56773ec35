"""The pipeline's stages against plain computations on a small table, and each stage's effect on its input."""

from collections import Counter, defaultdict

import corpus_pipeline
from quarry.llm import mixing, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else [])).collect()
        docs = stage(spark, docs, sf).cache()
        seen[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = seen["quality_classifier"]
    kept = {r.doc_id for r in after}
    good = [i for i in quality if quality[i] == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and len(kept) < len(before)

    before, after = seen["line_dedup"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    first, text, near = set(), {r.doc_id: r.text for r in after}, 0
    for r in sorted(before, key=lambda r: r.doc_id):
        lines = r.text.split("\n")
        exact = [x for x in lines if not x.strip() or x not in first and not first.add(x)]
        left = Counter(text[r.doc_id].split("\n") if text[r.doc_id] else [])
        assert not left - Counter(exact)
        near += len(exact) - sum(left.values())  # near lines go as well

    assert near < 0.02 * sum(len(r.text.split("\n")) for r in before)

    before, after = seen["simhash_near_dedup"]
    prints = [(r.doc_id, simhash.fingerprint(r.text.encode())) for r in before]
    group = {i: i for i, _ in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == sorted({find(i) for i in group})

    before, after = seen["source_mixing"]
    size = {r.doc_id: len(r.text.split()) for r in before}
    source = {r.doc_id: r.source for r in before}
    want = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(s, sum(size[i] for i in size if source[i] == s)) for s in set(source.values())], "source string, source_size long")).collect()}
    got, longest = defaultdict(int), defaultdict(int)
    for r in after:
        got[source[r.doc_id]] += size[r.doc_id]
    for i, s in source.items():
        longest[s] = max(longest[s], size[i])
    assert all(abs(got[s] - want[s]) <= longest[s] for s in want)
    assert max(Counter(r.doc_id for r in after).values()) <= 2

    before, after = seen["best_fit_packing"]
    filled = defaultdict(int)
    for r in after:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
