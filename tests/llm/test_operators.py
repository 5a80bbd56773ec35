"""Each operator on a messy table, an empty one, and against a plain computation."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, fingerprints, html, licenses, lines, mixing, packing, perplexity, simhash, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def brute_mix(docs, weights=(3, 1, 2), budget=1.5, passes=2):
    """{(doc_id, text, source): words taken} by serving queues in order of finish times until the budget is spent."""
    n = lambda t: len(WORD.findall(t or ""))
    names = [*sorted({s for _, _, s in docs if s is not None}), *[None] * any(s is None for _, _, s in docs)]
    queue = []
    for k, name in enumerate(names):
        mine = sorted((hashlib.md5(f"mix|{'' if i is None else i}|{t or ''}".encode()).hexdigest(), n(t), (i, t, s)) for i, t, s in docs if s == name)
        at = 0
        for _ in range(passes):
            for key, size, doc in mine:
                queue.append(((at + size) / weights[k % len(weights)], "n" if name is None else "s" + name, at, key, size, doc))
                at += size
    left, out = int(budget * sum(n(t) for _, t, _ in docs)), Counter({d: 0 for d in docs})
    for *_, size, doc in sorted(queue, key=lambda q: q[:4]):
        out[doc] += min(size, left)
        left -= min(size, left)
    return out


def test_mixing(messy, empty, spark):
    out = rows(mixing.mix(messy))
    assert len(out) == 2 * messy.count()
    taken, size, target, longest = Counter(), {}, {}, 0
    for r in out:
        taken[r["source"]] += r["taken"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
        longest = max(longest, r["size"])
        assert 0 <= r["taken"] <= r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 and sum(taken.values()) == int(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] and abs(taken[s] - target[s]) <= longest for s in size)
    order = sorted((r["position"], r["virtual_finish"]) for r in out)
    assert [f for _, f in order] == sorted(f for _, f in order)
    assert sorted(map(str, rows(mixing.mix(messy)))) == sorted(map(str, out))
    kept = mixing.mixed(messy)
    assert kept.columns == messy.columns and kept.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("range_rows", [mixing.RANGE_ROWS, 3])
def test_mixing_is_a_fair_queue(spark, sf, monkeypatch, range_rows):
    """The cut through the global order of finish times decides what is taken, by brute force; repeated rows included."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    some = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    docs = [*some, *some[:5], *[some[7]] * 9, (None, "no id", None), (None, "two words more", None), (900, None, None), (901, "", "x"), (902, "a b c", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    want = brute_mix(docs)
    got = Counter()
    names = {hashlib.md5(f"mix|{'' if i is None else i}|{t or ''}".encode()).hexdigest(): (i, t) for i, t, _ in docs}
    for r in mixing.mix(df).collect():
        got[(*names[r.key], r.source)] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    # the budget cuts within the queues: rows with and without words of theirs in the mix
    sizes = {d: len(WORD.findall(d[1] or "")) * n for d, n in Counter(docs).items()}
    assert any(want[d] == 2 * sizes[d] for d in sizes) and any(want[d] < sizes[d] for d in sizes)


def test_mixed_of_equal_rows(spark):
    """A thousand equal rows, and rows that differ in another column only, meet their source's target to a document."""
    docs = [(1, "one two three four", "a", "x")] * 1000 + [(2, "five six seven", "a", f"y{i % 3}") for i in range(50)] + [(10 + i, f"w{i} v", "b", "z") for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    got, size = Counter(), {"a": 4150, "b": 3000}
    for r in mixing.mixed(df).collect():
        got[r.source] += len(r.text.split())
    want = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    assert all(abs(got[s] - want[s]) <= 4 for s in size), (got, want)
    assert mixing.mixed(df).select("lang").distinct().count() == 5


def test_targets_reshare(spark):
    """Closed form against resharing until no source is above its limit."""
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 5, "e": 0, None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    names = [*sorted(x for x in sizes if x is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in sizes if t not in capped) for s in sizes if s not in capped}
        over = {s for s, v in share.items() if v > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 2 * sizes[s] if s in capped else share[s] for s in sizes})


def brute_base(text):
    words = WORD.findall(text)
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_divergence(messy, empty):
    for t in ["", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x y\nx y\n \n \n#|<", "é b c " * 9, "q " * 30, *(t for _, t in texts(messy))]:
        assert divergence.base_counts(t) == brute_base(t), t[:40]
    out = rows(divergence.quality_rules(messy))
    assert len(out) == messy.count()
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert divergence.quality_rules(empty).count() == 0
    assert divergence.js_distance(np.array([1, 0]), np.array([0, 1])) == 1.0 and divergence.js_distance(np.array([1, 2]), np.array([2, 4])) == 0.0


def test_op2_query(spark, sf, tmp_path):
    """Base counts, histograms, references, distances and verdicts in plain Python, on the table and on one of several scripts."""
    import math
    import unicodedata

    def char_class(c):
        o = ord(c)
        if o < 128:
            return next((k for k, v in divergence._ASCII.items() if c in v), "lower" if c.islower() else "upper" if c.isupper() else "other")
        kind = unicodedata.category(c)
        return divergence._BEYOND.get(kind) or divergence._BEYOND.get(kind[0], "other")

    ascii_marks = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

    def word_ids(t):
        """The words themselves; only ties among equally common ones are told by their hashes."""
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in ascii_marks else c for c in t)
        return Counter(folded.split(" ")) - Counter({"": 10**9})

    def hashed(w, known={}):  # noqa: B006
        if w not in known:
            known[w] = int(divergence._word_ids([w.encode()])[0][0])
        return known[w]

    def distance(p, q):
        a, b = sum(p.values()), sum(q.values())
        if not a or not b:
            return 0.0
        total = 0.0
        for k in {*p, *q}:
            x, y = p.get(k, 0) / a, q.get(k, 0) / b
            total += sum(z * math.log2(2 * z / (x + y)) / 2 for z in (x, y) if z)
        return max(0.0, total) ** 0.5

    greek = "η γλώσσα είναι ο τρόπος με τον οποίο οι άνθρωποι μιλούν και γράφουν για τον κόσμο γύρω τους, κάθε μέρα και κάθε νύχτα. "
    own = [(1, greek + " ".join(f"λέξη{i}" for i in range(40)), "el"), (2, "言語は人々が話し、書くための方法です。 " * 2 + " ".join(f"語{i}" for i in range(60)), "ja"), (3, None, None), (4, "# * $ % " * 3 + " ".join(f"{i}#" for i in range(200)), "el"), (None, " ".join(f"word{i} the" for i in range(60)), None), (6, " ".join(f"w{i} {'of' if i % 9 else 'to'}" for i in range(80_000)), "many")]
    spark.createDataFrame([(i, t, g, 1) for i, t, g in own], "doc_id long, text string, lang string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf, str(tmp_path)):
        docs = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
        chars, words = defaultdict(Counter), defaultdict(Counter)
        base = {d: brute_base(d[1]) for d in docs}
        fails = {d: b[0] < 20 or 100 * b[4] > 30 * b[0] for d, b in base.items()}
        for d in docs:
            if not fails[d]:
                chars[d[2]].update(map(char_class, d[1]))
                words[d[2]].update(word_ids(d[1]))
        all_chars, all_words = sum(chars.values(), Counter()), sum(words.values(), Counter())
        prior = divergence.PRIOR_WORDS / max(1, sum(all_words.values()))
        top = lambda c: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], hashed(x[0])))[: divergence.COMMON]]
        refs = {}
        for lang in {d[2] for d in docs}:
            n = {k: words[lang][k] + prior * all_words[k] for k in {*top(words[lang]), *top(all_words)}}
            common = {k: n[k] for k in top(n)}
            common["rest"] = sum(words[lang].values()) + prior * sum(all_words.values()) - sum(common.values())
            refs[lang] = ({k: chars[lang][k] + prior * all_chars[k] for k in {*chars[lang], *all_chars}}, common)
        out = defaultdict(list)
        for r in rows(divergence.op2_distribution_divergence(spark, folder)):
            out[r["doc_id"]].append(r)
        for d in docs:
            (r,) = out[d[0]]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*base[d], fails[d])
            n, (ref_chars, common) = base[d][0], refs[d[2]]
            mine = word_ids(d[1])
            count = sum(mine.values())
            char_d = distance(Counter(map(char_class, d[1])), ref_chars) if n >= divergence.CHAR_GUARD else 0.0
            hist = Counter()
            for k, v in mine.items():
                hist[k if k in common else "rest"] += v
            word_d = distance(hist, common) if n >= divergence.WORD_GUARD else 0.0
            assert (r["char_distance"], r["word_distance"]) == pytest.approx((char_d, word_d), abs=1e-6), d[1][:50]
            a = char_d / (divergence.CHAR_LIMIT + divergence.CHAR_CHANCE / max(1, n) ** 0.5)
            b = word_d / (divergence.WORD_LIMIT + divergence.WORD_CHANCE / max(1, count) ** 0.5)
            assert r["kept"] == (max(a, b) <= 1 and a + b <= divergence.TOGETHER and not fails[d])


def test_divergence_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    x = divergence.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in x.collect()}
    assert kept[1] > 0.95 and kept[0] < 0.06


def brute_repeats(docs, n=50):
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for p in range(len(t) - n + 1):
            first.setdefault(t[p : p + n], i)
    low = lambda i: float("-inf") if i is None else i
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if low(first[t[p : p + n]]) < low(i):
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes(spark, messy, empty):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffixes.remove_repeats(messy))), key=str)
    assert got == brute_repeats([(i, t.encode()) for i, t in texts(messy)])
    assert suffixes.remove_repeats(empty).count() == 0
    odd = [(1, "a" * 300), (2, "b" + "a" * 120 + "b"), (3, "ab" * 200), (4, "x" * 49), (5, "x" * 49), (6, "x" * 50), (7, "ba" * 100 + "a" * 60)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffixes.remove_repeats(spark.createDataFrame(odd, "doc_id long, text string")))), key=str)
    assert got == brute_repeats([(i, t.encode()) for i, t in odd])


def test_two_stage_sort():
    r = np.random.default_rng(5)
    for alphabet in (1, 2, 4, 200):
        text = r.integers(0, alphabet, 700).astype(np.uint8)
        wanted = np.sort(r.choice(700, 400, replace=False))
        order = suffixes.two_stage_sort(text, wanted, 16)
        whole = text.tobytes() + b"\0\1" + b"\0" * 40
        keys = [whole[i : i + 16] for i in order]
        assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)
        lcp = suffixes.common_prefixes(text, order, 16)
        padded = text.tobytes() + b"\0" * 40
        for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
            x, y = padded[a : a + 16], padded[b : b + 16]
            assert n == next((i for i in range(16) if x[i] != y[i]), 16)


def test_licenses(spark, messy, empty):
    mit = "Copyright (c) 2020 Somebody\n\n" + licenses.TEXTS["MIT"][0].upper().replace(",", " ,")
    docs = spark.createDataFrame([(1, mit), (2, "Text.\nReleased under the MIT LICENCE!\nMore"), (3, None), (4, licenses.TEXTS["Zlib"][0]), (5, "no hint here")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.n_notices, r.notices) for r in licenses.scan(docs).collect()}
    assert got == {1: ("MIT", 0, ""), 2: (None, 1, "MIT"), 3: (None, 0, ""), 4: ("Zlib", 0, ""), 5: (None, 0, "")}
    assert licenses.scan(messy).count() == messy.count() and licenses.scan(empty).count() == 0
    more = spark.createDataFrame([(licenses.canonical_digest("My own license text."), "Own", "text")], "digest string, license string, kind string")
    assert licenses.scan(docs.limit(1).selectExpr("9 as doc_id", "'MY OWN LICENCE: text' as text"), more).first().license == "Own"


def test_licenses_of_any_layout(spark):
    """Known texts match at every width, with decoration and a copyright line; so do texts and notices that a caller adds."""
    import textwrap

    docs = []
    for name, ts in licenses.TEXTS.items():
        for t in ts:
            for width in range(40, 121):
                body = "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))
                docs.append((name, f"Copyright (c) 2021, Some One <a@example.org>\nAll rights reserved.\n\n{body}"))
            docs += [(name, "".join(f"// {x}\r\n" for x in textwrap.wrap(t, 70))), (name, re.sub(" ", "  ", t).upper()), (name, t.replace("copyright holder", "copyright\nowner"))]
    df = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(docs)], "doc_id long, text string, license string").repartition(4)
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [i for i, (name, _) in enumerate(docs) if got[i] != name] == []
    more = spark.createDataFrame([(licenses.canonical_digest("Tous droits cédés."), "FR", "text"), (licenses.canonical_digest("Domaine public."), "PD", "notice"), (licenses.canonical_digest("公有领域 𝒳"), "CN", "text")], "digest string, license string, kind string")
    own = spark.createDataFrame([(1, "Tous  droits\ncédés"), (2, "x\nDomaine public\ny"), (3, "公有领域。𝒳!"), (4, "公有领域")], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.notices) for r in licenses.scan(own, more).collect()} == {1: ("FR", ""), 2: (None, "PD"), 3: ("CN", ""), 4: (None, "")}


def test_copyright_lines_of_every_form(spark):
    """Before a known text at any width: names without a year, parts, blocks of several lines, identifiers; running text stays."""
    heads = [
        "Copyright Jane Doe and contributors", "Copyright: 2019, Jane Doe", "Copyright 2020-2024 Jane Doe <j@example.org>", "Portions Copyright (c) 1999 X", "(c) 2001 Y", "© Z", "# Copyright (C) 2020 A\n#           2021 B",
        "Copyright (c) 2020 A\n              2021 B\nAll rights reserved.", "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: MIT\n// Copyright The Authors", "COPYRIGHT JANE DOE\n", "Copyright",
    ]
    import textwrap

    docs = [(name, f"{head}\n\n{textwrap.fill(texts[0], width)}") for name, texts in licenses.TEXTS.items() for head in heads for width in (40, 57, 72, 96, 120)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [(docs[i][1][:60], got[i]) for i in range(len(docs)) if got[i] != docs[i][0]] == []
    assert all(licenses.canonical_digest(t) == licenses.canonical_digest(licenses.TEXTS[n][0]) for n, t in docs)
    one = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT"), (2, "x = 1  \n# SPDX-License-Identifier: GPL-2.0-only\n"), (3, "copyright law is a field of law\nof its own")], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.notices) for r in licenses.scan(one).collect()} == {1: (None, "MIT"), 2: (None, "GPL-2.0"), 3: (None, "")}
    assert licenses.canonical_text("copyright law is a field of law\nof its own\ue000") == "copyright law is a field of law of its own"


def test_license_digests_of_published_texts(spark):
    """The digests of long licenses are those of their texts, where the system has them."""
    import pathlib

    names = {"Artistic-1.0-Perl": "Artistic", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}
    found = {name: f for name in licenses.DIGESTS if (f := pathlib.Path("/usr/share/common-licenses", names.get(name, name))).exists()}
    for name, f in found.items():
        text = f.read_text(encoding="utf-8")
        assert (len(licenses.canonical_text(text)), licenses.canonical_digest(text)) == licenses.DIGESTS[name]
    docs = spark.createDataFrame([(name, f.read_text(encoding="utf-8")) for name, f in found.items()], "source string, text string").selectExpr("1 as doc_id", "source", "text")
    assert sorted(r.license for r in licenses.scan(docs).collect()) == sorted(found)


def test_perplexity(messy, labels, empty):
    out = rows(perplexity.classify(messy, labels))
    assert len(out) == messy.count()
    for r in out:
        assert (r["perplexity"] is None) == (r["n_words"] == 0) and not (r["n_words"] == 0 and r["accepted"])
    kept = perplexity.keep_accepted(messy, labels)
    assert kept.columns == messy.columns
    assert perplexity.classify(empty, labels).count() == 0
    assert perplexity.classify(messy, labels.limit(0)).where("accepted").count() == sum(r["n_words"] > 0 for r in out)


def test_perplexity_is_kneser_ney(spark):
    """Perplexities against a dictionary model of the same counts."""
    from .conftest import sentence

    docs = spark.createDataFrame([(i, sentence(i, 60), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = {r.doc_id: r.perplexity for r in perplexity.classify(docs, labels).collect()}
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held out")), F.lit(5)) == 0).collect()}
    data = {i: ["<s>", *t.split()] for i, t in texts(docs)}
    c = Counter(p for i, w in data.items() if i not in held for p in zip(w, w[1:], strict=False))
    n = Counter(c.values())
    d = perplexity._discounts(*(n[k] for k in (1, 2, 3, 4)))
    total, types, ends = Counter(), defaultdict(Counter), Counter()
    for (v, w), k in c.items():
        total[v] += k
        types[v][min(k, 3)] += 1
        ends[w] += 1
    m = Counter(ends.values())
    e = perplexity._discounts(*(m[k] for k in (1, 2, 3, 4)))
    spare = sum(e[min(k, 3) - 1] for k in ends.values()) / sum(ends.values()) / (1 << perplexity.VOCAB_BITS)
    low = lambda w: (ends[w] - e[min(ends[w], 3) - 1] if ends[w] else 0) / sum(ends.values()) + spare

    def p(v, w):
        if not total[v]:
            return low(w)
        k = c[v, w]
        return (k - d[min(k, 3) - 1] if k else 0) / total[v] + sum(d[j - 1] * types[v][j] for j in (1, 2, 3)) / total[v] * low(w)

    for i, w in data.items():
        ppl = np.exp(-np.mean([np.log(p(a, b)) for a, b in zip(w, w[1:], strict=False)]))
        assert got[i] == pytest.approx(ppl, rel=1e-3)


def test_html(spark):
    page = '<html><head><title>x</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use</div><article><header><h1>T &amp; t</h1></header><p>One<p>Two <b>bold<br>x</b><script>var t="</p>";</script><ul><li>a<li>b</ul><section class="comments"><p>bad</section><aside>s</aside><form><input>f</form></article><footer>&copy; me</footer>'
    assert html.main_text(page) == "T & t\nOne\nTwo bold x\na\nb"
    assert html.main_text("") == "" and html.main_text("a &lt; b") == "a < b" and html.main_text("<p>un<i>closed") == "unclosed"
    pages = [(i, f"http://h.example/{i}", f"<div>Same line on all pages</div><p>Own text {i}</p>") for i in range(5)] + [(5, None, None), (6, "http://other.example/", "<div>Same line on all pages</div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Own text {i}" for i in range(5)}, 5: "", 6: "Same line on all pages"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_inside_articles(spark):
    """Recurring blocks of neutral classes go from articles too if most pages have them, lists of links of a section as well."""
    page = lambda i, extra="": f"<article><h2>Summary</h2><p>Own text {i}</p><table><tr><td>No {i}</td><td>Yes</td></tr></table><div class='x1'><p>Read our terms</p></div>{extra}</article>"
    pages = [(i, f"http://h.example/{i}", page(i, "<div><a href='/s'>Section list</a></div><div class='x2'>Kept</div><p>Said often</p>" if i < 25 else "")) for i in range(300)]
    pages += [(400 + k, f"http://h.example/copy{k}", "<main><article><p>One article at many places</p></article></main>") for k in range(40)]
    pages += [(500, "http://h.example/same", "<article><p>One row many times</p></article>")] * 40
    pages += [(600 + k, "http://small.example/", page(k)) for k in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: f"Summary\nOwn text {i}\nNo {i}\nYes" + ("\nKept\nSaid often" if i < 25 else "") for i in range(300)} | {400 + k: "One article at many places" for k in range(40)} | {500: "One row many times"}
    want |= {600 + k: f"Summary\nOwn text {k}\nNo {k}\nYes\nRead our terms" for k in range(2)}
    for broadcast in (1000, 0):  # both ways to bring the templates to the pages
        assert {r.page_id: r.text for r in html.extract(df, broadcast=broadcast).collect()} == want


def test_html_keeps_what_articles_say():
    """Words of slugs and ids of sections are no furniture in an article; main keeps its text beside articles."""
    page = "<article><h2 id='related-work'>Related</h2><section id='discussion'><p>We discuss</p></section><h2 id='search'>Search</h2><div class='social-impact'>Impact</div><div class='box share'><a href='/s'>Share</a></div><div id='comments'>Bad</div></article>"
    assert html.main_text(page) == "Related\nWe discuss\nSearch\nImpact"
    assert html.main_text(f"<body><p>out</p><main><h1>Title</h1><p>Lead</p>{page}<nav>x</nav></main></body>") == "Title\nLead\nRelated\nWe discuss\nSearch\nImpact"
    assert html.main_text("<main><nav>x</nav><div class='sidebar'>y</div><article>One</article></main>") == "One"
    assert html.main_text("<article>One</article><article class='related-post'>Teaser</article>") == "One"
    assert html.main_text("<main><section id='discussion'><article>One</article></section></main>") == "One"
    assert html.main_text("<article><div class='search'>Search engines work by crawling.</div><div class='search'><input>Find</div></article>") == "Search engines work by crawling."
    assert html.main_text("<article><p>a</p><div class='notice'>Notice</div>b<div class='advert'>x</div></article>") == "a\nb"


def test_html_loses_no_words_of_articles(spark):
    """Quotations, refrains and formulae that three of a host's thirty articles share stay, and so do titles and last lines."""
    shared = "<blockquote>To be or not to be</blockquote><p>Refrain.</p><h2>Notes</h2><ul><li>One</li></ul><pre>E = mc2</pre><p class='verse'>Verse</p>"
    pages = [(i, f"http://h.example/{i}", f"<body><nav><a href='/'>Home</a></nav><article><h1>{'Same title' if i < 9 else i}</h1><p>Own {i}</p>{shared if i < 3 else ''}<p>The end.</p></article></body>") for i in range(30)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(30):
        middle = "To be or not to be\nRefrain.\nNotes\nOne\nE = mc2\nVerse\n" if i < 3 else ""
        assert got[i] == f"{'Same title' if i < 9 else i}\nOwn {i}\n{middle}The end."


def test_op6_query(spark):
    """Every given page: against a plain recomputation of the templates, and nothing of an article's body is lost."""
    sf = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf}/pages.parquet").collect()
    name = lambda url: re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    host = {r.page_id: (name(r.url)[1].lower() if name(r.url) else "") for r in given}
    parsed = {r.page_id: html.blocks(html.tree(r.html or "")) for r in given}
    places, most = defaultdict(set), {}
    for i, (_, marks) in parsed.items():
        for m, place, strict, _, _ in marks:
            places[host[i], m].add(place or ("page", i))
            most[host[i], m] = most.get((host[i], m), True) and strict
    total = Counter(host.values())
    gone = {k for k, at in places.items() if len(at) >= 3 and len(at) >= (total[k[0]] * 0.5 if most[k] else min(total[k[0]] * 0.1, 20))}
    got = {r.page_id: r for r in html.op6_site_templates(spark, sf).collect()}
    assert len(got) == len(given)
    for r in given:
        texts, marks = parsed[r.page_id]
        out = {i for m, _, _, start, end in marks if (host[r.page_id], m) in gone for i in range(start, end)}
        want = "\n".join(t for i, t in enumerate(texts) if i not in out)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
        assert "<article" not in (r.html or "") or got[r.page_id].text == html.main_text(r.html)


def test_html_hostile_pages():
    """Pages that a parser with backtracking or stack walks would take minutes for."""
    import time

    n = 50_000
    pages = [
        "<a " + '"' * 10**6 + ">x", "<a b=" + '"' * (10**6 + 1) + ">x", "<a " * n, "<div>" * 2 * n + "t", "<b>" * n + "</p>" * n, "<p><button>" + "<b>" * n + "<ul>" * n,
        "<main>" * 20_000 + "<article>x</article>", "<table>" + "<tr><td>" * n, "<ul><li>" * n, "<!--" * n, "<a " + "x='" * n, "<script>" * n, "</b" * n, "<p>a very long text " * n,
    ]
    for page in pages:
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 20, page[:40]
    assert html.main_text(pages[0]) == "x" and html.main_text(pages[3]) == "t"
    assert html.main_text("<p>one</p><a title='x>y' b=\"<p>z</p>\">two</a><p>cut <b") == "one\ntwo\ncut"


def test_html_repeats_nulls_and_clashes(spark):
    """Repeated rows keep their text, templates count pages by brute force, other columns do not matter."""
    block = lambda i: f"<div class='k{i}'><p>Common block {i}</p></div>"
    pages = [(i, f"http://h.example/{i}", f"<html><body>{block(0)}<p>Own {i}</p>{block(1) if i % 2 else ''}{block(2) if i < 2 else ''}</body></html>") for i in range(8)]
    pages += [(50, "http://one.example/", "<h1>Title</h1><p>Only on this page.</p>")] * 3 + [(None, None, "<p>a</p>"), (60, "", ""), (61, None, None), (62, "http://h.example/long", "<p>" + "word " * 200_000 + "</p>")]
    df = spark.createDataFrame([(*p, "x", 1, 2, 3) for p in pages], "page_id long, url string, html string, text string, hash long, _key int, _host int").repartition(3)
    got = [(r.page_id, r.text) for r in html.extract(df).collect()]
    on = defaultdict(set)
    for i, url, page in pages:
        for h, *_ in html.blocks(html.tree(page or ""))[1]:
            on[(url or "").split("/")[2] if url else "", h].add((i, url, page))
    total = {host: len({p for h, x in on for p in on[h, x] if h == host}) for host, _ in on}
    assert any(len(p) >= 3 for p in on.values()) and total["h.example"] == 9
    want = [(i, f"Own {i}" + (f"\nCommon block 2" if i < 2 else "")) for i in range(8)]
    want += [(50, "Title\nOnly on this page.")] * 3 + [(None, "a"), (60, ""), (61, ""), (62, ("word " * 200_000).strip())]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op7_query(spark, sf, tmp_path):
    """Every column of the query against plain Python, on the table and on one with nulls, repeats and ties."""
    import unicodedata

    def canon(t):
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
        return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")

    own = [(1, "Café  X"), (2, "CAFÉ x"), (3, None), (4, ""), (5, "ﬁn straße " * 30), (6, "ab\u00a0c"), (7, "Ab c"), (8, "😀" * 9), (None, "no id")]
    spark.createDataFrame([(i, t, i) for i, t in own], "doc_id long, text string, fingerprint long").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf, str(tmp_path)):
        docs = sorted(texts(spark.read.parquet(f"{folder}/documents.parquet")), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
        out = {r["doc_id"]: r for r in rows(fingerprints.op7_canonical_digest(spark, folder))}
        assert len(out) == len(docs)
        prints = defaultdict(set)
        for k, (i, t) in enumerate(docs):
            after = docs[(k + 1) % len(docs)][1]
            move = len(t) // 4
            edited = t[: len(t) - move] + after[:move]
            r = out[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["near_edited"], r["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(after))), i
            prints[r["fingerprint"]].add(canon(t))
            prints[r["edited_fingerprint"]].add(canon(edited))
        assert all(len(x) == 1 for x in prints.values()) and len(prints) == len(set.union(*prints.values()))


def test_op10_query(spark, sf):
    out = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows(simhash.op10_simhash_components(spark, sf))), key=str)
    assert out == brute_components(texts(spark.read.parquet(f"{sf}/documents.parquet")))


def test_fingerprints(messy, empty, spark):
    out = rows(fingerprints.with_fingerprint(messy.select("doc_id", "text")))
    by = defaultdict(set)
    for r in out:
        by[r["fingerprint"]].add(" ".join(__import__("unicodedata").normalize("NFKC", (r["text"] or "")).casefold().split()))
    assert all(len(v) == 1 for v in by.values()) and len(out) == messy.count()
    pair = spark.createDataFrame([(1, "Café  ﬁn\nSTRASSE"), (2, "café fin straße ")], "doc_id long, text string")
    assert fingerprints.with_fingerprint(pair).select("fingerprint").distinct().count() == 1
    assert fingerprints.with_fingerprint(empty).count() == 0
    many = spark.range(3000).selectExpr("cast(id * 7 % 3001 as long) as doc_id", "concat('t', id * 7 % 3001) as text").repartition(5)
    nxt = {r.doc_id: r.next_text for r in fingerprints.with_next(many).collect()}
    ids = sorted(nxt)
    assert all(nxt[a] == f"t{b}" for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)) and len(nxt) == 3000
    assert fingerprints.with_next(messy).count() == messy.count() and fingerprints.with_next(empty).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(spark):
    import random

    r = random.Random(2)
    pairs = []
    for _ in range(400):
        a = [r.choice("ab😀é") for _ in range(r.randint(0, 20))]
        b = a[:]
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 1)] = [r.choice("ab😀é")] * r.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "_x string, _y string").withColumn("i", F.monotonically_increasing_id()).cache()
    for k in (1, 2, 3):
        close = {x.i: x.d for x in lines.trimmed(df, k).withColumn("d", lines.banded_distance(F.col("_x"), F.col("_y"), k)).collect()}
        for x in df.withColumn("d", lines.banded_distance(F.col("_x"), F.col("_y"), k)).collect():
            true = edit(x._x, x._y)
            assert (x.d == true and close[x.i] == true) if true <= k else (x.d > k and close.get(x.i, 99) > k)


def limit_of(n):
    return 3 if n >= 512 else 2 if n >= 32 else -1


def brute_lines(docs):
    """(doc_id, text) -> (numbers of removed lines, links), rows equal in both being one document."""
    docs = sorted({(i, t or "") for i, t in docs}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    places = [(k, p, x) for k, (_, t) in enumerate(docs) for p, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\x0c\r")]
    first = {}
    for k, p, x in places:
        first.setdefault(x, (k, p))
    distinct = sorted(first)
    near = defaultdict(list)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            k = limit_of(min(len(x), len(y)))
            if abs(len(x) - len(y)) <= k and edit(x, y) <= k:
                near[x].append(y)
                near[y].append(x)
    out = {d: ([], 0) for d in docs}
    for k, p, x in places:
        gone, links = out[docs[k]]
        if min([first[x], *(first[y] for y in near[x])]) < (k, p):
            gone.append(p)
        out[docs[k]] = (gone, links + len(near[x]))
    return out


def test_lines(messy, empty, spark):
    base = "A line that is long enough to count for this."
    docs = [(1, f"{base}\nother short"), (2, base), (3, base.replace("long", "lng")), (4, f"own\n{base[:-1]}!\n{base}"), (5, base.replace("line", "row")), (6, None), (7, ""), (8, "own\n\n \t\nown"), (9, "\n \t"), (2, base)]
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: docs[0][1], 2: "", 3: "", 4: "own", 5: docs[4][1], 6: None, 7: "", 8: "\n \t", 9: docs[8][1]} and out.count() == len(docs)
    got = lines.dedup_lines(messy)
    assert got.columns == messy.columns and got.count() == messy.count()
    assert lines.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        lines.check_limits(((33, 2),))


@pytest.mark.parametrize(("crowd", "block"), [(lines.CROWD, lines.BLOCK), (1, 2)])
def test_line_links_against_brute_force(spark, monkeypatch, crowd, block):
    """Lines around the classes' borders with zero to five planted edits, periodic lines, hot lines and repeated rows.

    Once as they are, once with every key crowded and split into blocks.
    """
    import random

    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "BLOCK", block)
    r, docs = random.Random(7), []
    for n in (30, 32, 33, 36, 63, 64, 127, 128, 130, 143, 145, 510, 511, 512, 514):
        base = [r.choice("abcdé 日") for _ in range(n - 1)] + ["."]
        for _ in range(6):
            x = base[:]
            for _ in range(r.randint(0, 5)):
                at = r.randint(0, len(x))
                x[at : at + r.randint(0, 1)] = [r.choice("abx")] * r.randint(0, 1)
            docs.append("".join(x))
    docs += ["ab" * 20, "ab" * 21, "ba" * 20 + "b", "a" * 33, "a" * 34, "a" * 36, "short", "short", "", " \t"]
    r.shuffle(docs)
    rows_ = [(i // 3 if i % 7 else None, "\n".join(docs[i : i + 3])) for i in range(0, len(docs), 3)] + [(100 + i, docs[0] + "\nown line") for i in range(30)]
    rows_ += rows_[:4]
    df = spark.createDataFrame([(*x, "s") for x in rows_], "doc_id long, text string, source string").repartition(4)
    want = brute_lines(rows_)
    # documents of one id are ordered by a hash of the text here, which plain Python does not know: take ids of one text
    alone = {i for i, n in Counter(i for i, _ in want).items() if n == 1}
    got = {(x.doc_id, x.th): (sorted(x.removed), x.n_links) for x in lines.duplicate_lines(df).collect()}
    names = {(x.doc_id, x.text): x.th for x in df.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    for (i, t), (gone, links) in want.items():
        mine = got.get((i, names[i, t]), ([], 0))
        assert mine[1] == links, t[:60]
        assert i not in alone or mine[0] == gone, t[:60]


def test_packing(messy, empty):
    out = rows(packing.best_fit_packing(messy, 256))
    encode = packing.make_encoder()
    per = defaultdict(list)
    for r in out:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    want = []
    for i, t in texts(messy):
        ids = encode(t) + b"\0\0\0\0"
        want += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(ids) // 4, 256))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in out)
    assert packing.best_fit_packing(empty).count() == 0


def pack_one_by_one(lengths, capacity):
    """Sequences that best-fit decreasing opens."""
    import bisect

    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(left, n)
        rest = (left.pop(i) if i < len(left) else capacity) - n
        bisect.insort(left, rest)
    return len(left)


def test_op9_query(spark, sf):
    """The whole query: texts tokenized one by one, gapless sequences, and as many as packing piece by piece opens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    out = rows(packing.op9_best_fit_packing(spark, sf))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in texts(spark.read.parquet(f"{sf}/documents.parquet")):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted(want) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    per = defaultdict(list)
    for r in out:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in per.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(per) == pack_one_by_one([r["length"] for r in out], 2048)


def test_best_fit_plan():
    """The histogram's plan opens as many bins as packing piece by piece."""
    import random

    for seed in range(30):
        r = random.Random(seed)
        lengths = [r.randint(1, 40) for _ in range(r.randint(0, 120))]
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, left in enumerate(bins) if left >= n]
            if fits:
                i = min(fits, key=lambda i: bins[i])
                bins[i] -= n
            else:
                bins.append(40 - n)
        plan = packing.plan_best_fit(Counter(lengths), 40)
        used, pieces = defaultdict(list), Counter()
        for n, a, b, first, offset in plan:
            pieces[n] += b - a
            for k in range(b - a):
                used[first + k].append((offset, n))
        assert pieces == Counter(lengths) and len(used) == len(bins)
        for places in used.values():
            places.sort()
            assert all(x + n == y for (x, n), (y, _) in zip(places, places[1:], strict=False)) and places[-1][0] + places[-1][1] <= 40


@pytest.mark.parametrize("marks_as_text", [False, True])
def test_encoder_equals_the_tokenizer(marks_as_text):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = marks_as_text
    encode = packing.make_encoder(marks_as_text=marks_as_text)
    r = random.Random(3)
    some = ["".join(r.choices(["a", "Zé", " ", "  ", "\n", "<|endoftext|>", "'s", "12", "😀", "，", "\u00a0", "the"], k=12)) for _ in range(300)]
    for text in ["a<|endoftext|>", "<|endoftext|>  <|endoftext|>b", "<|endoftext", "", " ", "a", " a b  c\n\nd ", "it's we'll\tx", "é b 　c", "<|endoftext|> x", "\r\n a b", "1234 56.7, (x)", "a\x1cb c", "😀 ok " * 5, *some]:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def brute_components(docs, bits=4):
    prints = [(i, simhash.fingerprint((t or "").encode())) for i, t in docs]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        if i is not None:
            low[find(k)].append(i)
    return sorted(((i, fp, min(low[find(k)], default=None)) for k, (i, fp) in enumerate(prints)), key=str)


def test_simhash(messy, empty, spark):
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows(simhash.simhash_components(messy))), key=str)
    assert got == brute_components(texts(messy))
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and kept.select("doc_id").distinct().count() == len({r[2] for r in got})
    assert simhash.simhash_components(empty).count() == 0


def test_keep_one_of_equal_rows(messy, spark):
    """A table loaded several times gives what it gives once: one row of each component."""
    components = len({r["root"] for r in rows(simhash.simhash_components(messy))})
    once = simhash.keep_one(messy)
    assert once.count() == components
    thrice = messy.union(messy).union(messy)
    assert sorted(map(str, simhash.keep_one(thrice).collect())) == sorted(map(str, once.collect()))
    assert sorted(map(str, simhash.keep_one(lines.dedup_lines(thrice)).collect())) == sorted(map(str, simhash.keep_one(lines.dedup_lines(messy)).collect()))


def test_pigeonring_loses_no_link(spark):
    """Random fingerprints with planted chains of neighbours at 0 to 4 bits."""
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fps[:100].copy()
    for k in range(100):
        for bit in r.choice(64, k % 6, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    every = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(v),) for v in every.view(np.int64)], "fp long")
    roots = {x.node: x.root for x in simhash.connected(simhash.link_edges(df, 4)).collect()}
    links = {(int(a), int(b)) for a in every.view(np.int64) for b in every.view(np.int64) if a < b and ((int(a) ^ int(b)) % (1 << 64)).bit_count() <= 4}
    assert links and all(roots.get(a, a) == roots.get(b, b) for a, b in links)
    assert {*roots, *roots.values()} == {x for p in links for x in p}
    x = r.integers(0, 1 << 63, 5000, dtype=np.uint64) & r.integers(0, 1 << 63, 5000, dtype=np.uint64) & r.integers(0, 1 << 63, 5000, dtype=np.uint64) & r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert not (~simhash.chain_ok(x, 4) & (np.bitwise_count(x) <= 4)).any()
