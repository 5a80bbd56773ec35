"""Operator 2: quality rules by distribution divergence.

Each document's histograms of character classes and of its language's commonest words are compared with the language's
own, summed over all documents that pass the base rules, by Jensen-Shannon distance. A histogram over few items strays
from its source by chance, so each test has a minimum length below which it does not run, and its limit has a term that
falls with the square root of the length.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, span_hashes, table, text_blocks, word_spans

#: The commonest words of a language that make the word histogram (the rest is one class). Words are known by 64-bit hashes.
COMMON = 64
#: Tasks that a language's words are dealt to for their first ranking.
DEALS = 256
#: A language's reference has, besides its own counts, the shares of all languages together at the weight of this many words.
PRIOR_WORDS = 5_000
#: Minimum words and limits of the two tests: the limit of a text of n words is limit + chance / sqrt(n). A distance over
#: its limit rejects, and so do two that are both near: shares of their limits that add up to more than TOGETHER.
CHAR_GUARD, CHAR_LIMIT, CHAR_CHANCE = 20, 0.09, 1.35
WORD_GUARD, WORD_LIMIT, WORD_CHANCE = 50, 0.06, 3.3
TOGETHER = 1.8

#: Character classes: those of ASCII by character, those beyond it by the first letter or both of the Unicode category.
_ASCII = {"space": " \t\x0b\x0c", "newline": "\n\r", "digit": "0123456789", "stop": ".", "comma": ",;:", "quote": "'\"`", "bracket": "()[]{}", "hyphen": "-_/", "exclamation": "!?", "symbol": "#*$%&<>@^~=+\\", "bar": "|"}
_BEYOND = {"Ll": "lower beyond", "Lu": "upper beyond", "Lt": "upper beyond", "L": "letter", "M": "mark", "N": "number", "P": "punctuation", "S": "sign", "Z": "space"}
_CLASSES = [*_ASCII, "lower", "upper", *dict.fromkeys(x for x in _BEYOND.values() if x not in _ASCII), "other"]


def _class(c: int) -> str:
    if c < 128:
        return next((name for name, chars in _ASCII.items() if chr(c) in chars), "lower" if 97 <= c < 123 else "upper" if 65 <= c < 91 else "other")
    kind = unicodedata.category(chr(c))
    return _BEYOND.get(kind) or _BEYOND.get(kind[0], "other")


@functools.cache
def _class_table() -> np.ndarray:
    """The class of every code point."""
    number = {name: i for i, name in enumerate(_CLASSES)}
    return np.fromiter((number[_class(c)] for c in range(0x110000)), np.uint8, 0x110000)


_ASCII_BYTES = bytes(range(128))
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_SYMBOLS = "#*$%&|<>"


def base_counts(text: str, window: int = 8) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = Counter(x for x in raw.split(b"\n") if x.split()) if b"\n" in raw else {}
    repeated = 0
    if n > window:
        ids: dict[bytes, int] = {}
        a = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
        if len(ids) < n:
            # windows as rows of ids, made small numbers exactly by doubling: rank pairs of ranks
            rank, length = a, 1
            while length < window:
                pair = rank[:-length] * np.uint64(n + 1) + rank[length:]
                rank, length = np.unique(pair, return_inverse=True)[1].astype(np.uint64), 2 * length
            again = (np.bincount(rank.astype(np.int64)) > 1)[rank.astype(np.int64)]
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, np.flatnonzero(again), 1)
            np.add.at(cover, np.flatnonzero(again) + window, -1)
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    return n, chars, sum(map(text.count, _SYMBOLS)), sum(lines.values()) - len(lines), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def _fails(text: bytes) -> bool:
    n, *_, repeated = base_counts(text.decode("utf-8", "replace"))
    return base_failed(n, repeated)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; 0 to 1. An empty one is at distance 0."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def _word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, lower-cased and without ASCII punctuation, and each word's text number."""
    blob = (b" " + b" ".join(texts) + b" ").lower().translate(_PLAIN)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens + 1) - lens
    begin, end = word_spans(np.frombuffer(blob, np.uint8))
    return span_hashes(np.frombuffer(blob, np.uint8), begin, end).view(np.int64), np.searchsorted(starts, begin, "right") - 1


def _char_hist(text: bytes) -> np.ndarray:
    """Code points by class: ASCII by counts of bytes, the rest, which is decoded alone, by looking each one up."""
    table = _class_table()
    hist = np.bincount(table[:128], np.bincount(np.frombuffer(text, np.uint8), minlength=256)[:128], len(_CLASSES))
    beyond = text.translate(None, _ASCII_BYTES)
    if beyond:
        hist += np.bincount(table[np.frombuffer(beyond.decode("utf-8", "replace").encode("utf-32-le"), "<u4")], minlength=len(_CLASSES))
    return hist.astype(np.int64)


def _groups(batches, limit: int = 1 << 20) -> Iterator[tuple[list, list, list[str]]]:
    for others, data, starts, ends in text_blocks(batches, limit):
        whole = data.tobytes()
        yield [c.to_pylist() for c in others], [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def references(docs: DataFrame) -> dict:
    """Histograms per language: {lang: (char histogram, common words' hashes, their counts and the rest)}.

    Counts are summed over every document that passes the base rules; to them come the shares of all languages together,
    times PRIOR_WORDS (for characters, as many as that many words have), so that a language of few words leans on the
    others, the less the more it has. Every word is counted under its own hash, partially in the tasks; what is gathered
    is a fixed number of figures for each value of lang.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (langs,), texts in _groups(batches):
            good = [i for i, t in enumerate(texts) if not _fails(t)]
            if not good:
                continue
            ids, of = _word_ids([texts[i] for i in good])
            names = ["" if langs[i] is None else "l" + langs[i] for i in good]
            order = {name: k for k, name in enumerate(dict.fromkeys(names))}
            lang = np.array([order[name] for name in names])[of] if len(of) else of
            chars = {name: np.zeros(len(_CLASSES), np.int64) for name in order}
            for i, name in zip(good, names, strict=True):
                chars[name] += _char_hist(texts[i])
            for name, k in order.items():
                words, n = np.unique(ids[lang == k], return_counts=True)
                cells = np.concatenate([words, np.arange(len(_CLASSES))])
                is_word = np.arange(len(cells)) < len(words)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells)), pa.array(is_word), pa.array(cells), pa.array(np.concatenate([n, chars[name]]))], names=["lang", "is_word", "cell", "n"])

    cells = docs.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, is_word boolean, cell long, n long")
    cells = materialize(cells.groupBy("lang", "is_word", "cell").agg(F.sum("n").alias("n")))
    words = cells.where("is_word").select("lang", "cell", "n")
    first = words.withColumn("_deal", F.pmod("cell", F.lit(DEALS)))
    for keys in (["lang", "_deal"], ["lang"]):  # the best of each deal, then of those
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "cell"))).where(F.col("_r") <= COMMON).drop("_r")
    own_top = first.select("lang", "cell", "n")
    all_top = words.groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(COMMON)
    shared = words.join(F.broadcast(all_top.select("cell")), "cell", "left_semi")  # COMMON rows are broadcast
    rows = own_top.union(shared.select("lang", "cell", "n")).distinct().collect()  # 2 * COMMON rows of a language
    totals = dict(words.groupBy("lang").agg(F.sum("n")).collect())  # one number of a language
    letters = cells.where("NOT is_word").select("lang", F.col("cell").cast("int"), "n").collect()  # a number for each class
    wanted = docs.sparkSession.createDataFrame(sorted({(c,) for _, c, _ in rows}), "cell long")
    every = dict(words.join(F.broadcast(wanted), "cell").groupBy("cell").agg(F.sum("n")).collect())  # as many as rows
    drop_tables(docs.sparkSession, cells)
    total = sum(totals.values())
    prior = PRIOR_WORDS / total if total else 0.0
    pooled = np.zeros(len(_CLASSES))
    out: dict[str, tuple] = {"*": (np.zeros(len(_CLASSES)), {}, [0])}
    for lang, c, n in letters:
        pooled[c] += n
        out.setdefault(lang, (np.zeros(len(_CLASSES)), {}, [totals.get(lang, 0)]))[0][c] = n
    for lang, c, n in rows:
        out[lang][1][c] = n
    shares = pooled * prior
    common = every
    top = sorted(common, key=lambda c: (-common[c], c))[:COMMON]
    done = {}
    for lang, (chars, words, size) in out.items():
        n = {c: words.get(c, 0) + prior * common[c] for c in {*words, *top}}
        ids = sorted(n, key=lambda c: (-n[c], c))[:COMMON]
        counts = [n[c] for c in ids]
        done[lang] = (chars + shares, np.array(ids, np.int64), np.array([*counts, max(0.0, size[0] + prior * total - sum(counts))], float))
    return done


def verdict(n_words: int, text: bytes, ids: np.ndarray, ref) -> tuple[float, float, bool]:
    """char distance, word distance, kept: a distance is 0 where its minimum-length guard skips the test."""
    chars, common, counts = ref
    hist = _char_hist(text)
    char_d = js_distance(hist, chars) if n_words >= CHAR_GUARD else 0.0
    word_d = 0.0
    if n_words >= WORD_GUARD and len(ids) and len(common):
        order = np.argsort(common)
        at = np.minimum(np.searchsorted(common[order], ids), len(common) - 1)
        place = np.where(common[order][at] == ids, order[at], len(common))
        word_d = js_distance(np.bincount(place, minlength=len(common) + 1), counts)
    char_share = char_d / (CHAR_LIMIT + CHAR_CHANCE / max(1, n_words) ** 0.5)
    word_share = word_d / (WORD_LIMIT + WORD_CHANCE / max(1, len(ids)) ** 0.5)
    return char_d, word_d, max(char_share, word_share) <= 1 and char_share + word_share <= TOGETHER


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document (SCHEMA). Null text: no words, so base_failed. Null lang is a language of its own.

    Repeated rows give repeated rows, null doc_ids stay null, columns other than doc_id, lang and text are ignored, and
    an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))  # a fixed number of figures per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for (doc, langs), texts in _groups(batches):
            ids, of = _word_ids(texts)
            cut = np.searchsorted(of, np.arange(len(texts) + 1))
            out = []
            for i, t in enumerate(texts):
                counts = base_counts(t.decode("utf-8", "replace"))
                failed = base_failed(counts[0], counts[4])
                ref = refs.get("" if langs[i] is None else "l" + langs[i]) or refs["*"]
                char_d, word_d, good = verdict(counts[0], t, ids[cut[i] : cut[i + 1]], ref)
                out.append((doc[i], *counts, failed, char_d, word_d, good and not failed))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "lang", F.col("text").cast("binary")).mapInArrow(run, SCHEMA)


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (SCHEMA) for every row of documents; nulls and repeats as in quality_rules()."""
    return quality_rules(table(spark, sf_dir, "documents"))
