"""The recursive chunker with separators by language. Offsets are characters of the text.

A separator's matches are places where the text may be cut. An interval that is too long is cut at the places of the
coarsest separator that has any inside it, as far apart as the size allows; what is still too long is cut at the next
separator, and at last between words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, OVERLAP, MIN_CHARS = 1000, 50, 100
WORD = re.compile(r"\w+(?:['’.]\w+)*")


@dataclass(frozen=True)
class Language:
    name: str
    aliases: tuple[str, ...]
    extensions: tuple[str, ...]
    separators: tuple[str, ...]


# The languages with their other names, file extensions and separators from coarse to fine.
LANGUAGES = (
    Language("python", ("py", "python3"), ("py",), (r"(?m)^class ", r"(?m)^def ", r"(?m)^async def ", r"(?m)^\s+def ", r"\n\n", r"\n")),
    Language("javascript", ("js", "ecmascript"), ("js",), (r"(?m)^function ", r"(?m)^const .* = ", r"(?m)^class ", r"(?m)^export ", r"\n\n", r"\n")),
    Language("typescript", ("ts",), ("ts",), (r"(?m)^function ", r"(?m)^const .* = ", r"(?m)^class ", r"(?m)^export ", r"(?m)^interface ", r"(?m)^type ", r"\n\n", r"\n")),
    Language("tsx", (), ("tsx",), (r"(?m)^function ", r"(?m)^const .* = ", r"(?m)^class ", r"(?m)^export ", r"(?m)^interface ", r"(?m)^type ", r"\n\n", r"\n")),
    Language("rust", ("rs",), ("rs",), (r"(?m)^fn ", r"(?m)^pub fn ", r"(?m)^impl ", r"(?m)^struct ", r"(?m)^enum ", r"(?m)^mod ", r"\n\n", r"\n")),
    Language("go", ("golang",), ("go",), (r"(?m)^func ", r"(?m)^type ", r"(?m)^package ", r"\n\n", r"\n")),
    Language("java", (), ("java",), (r"(?m)^public ", r"(?m)^private ", r"(?m)^protected ", r"(?m)^class ", r"(?m)^interface ", r"@", r"\n\n", r"\n")),
    Language("c", (), ("c",), (r"(?m)^#", r"(?m)^\w+.*\{", r"\n\n", r"\n")),
    Language("cpp", ("c++", "cxx", "cc"), ("cpp", "cc", "cxx", "h", "hpp"), (r"(?m)^#", r"(?m)^\w+.*\{", r"(?m)^class ", r"(?m)^template", r"(?m)^namespace ", r"\n\n", r"\n")),
    Language("csharp", ("cs", "c#"), ("cs",), (r"(?m)^public ", r"(?m)^private ", r"(?m)^class ", r"(?m)^namespace ", r"\n\n", r"\n")),
    Language("ruby", ("rb",), ("rb",), (r"(?m)^class ", r"(?m)^module ", r"(?m)^def ", r"(?m)^end", r"\n\n", r"\n")),
    Language("php", (), ("php",), (r"(?m)^function ", r"(?m)^class ", r"(?m)^namespace ", r"\n\n", r"\n")),
    Language("swift", (), ("swift",), (r"(?m)^func ", r"(?m)^class ", r"(?m)^struct ", r"(?m)^protocol ", r"\n\n", r"\n")),
    Language("kotlin", ("kt",), ("kt", "kts"), (r"(?m)^fun ", r"(?m)^class ", r"(?m)^object ", r"(?m)^interface ", r"\n\n", r"\n")),
    Language("scala", (), ("scala",), (r"(?m)^def ", r"(?m)^class ", r"(?m)^object ", r"(?m)^trait ", r"\n\n", r"\n")),
    Language("markdown", ("md", "mdx"), ("md", "mdx"), (r"(?m)^#{1,6} ", r"\n\n", r"\n", r"\.\x20")),
    Language("html", ("htm",), ("html", "htm"), (r"<h[1-6]", r"<div", r"<section", r"<p", r"\n\n", r"\n")),
    Language("css", ("scss",), ("css", "scss"), (r"(?m)^\}", r"(?m)^\.", r"(?m)^#", r"(?m)^@", r"\n\n", r"\n")),
    Language("json", (), ("json",), (r'(?m)^\s*"[^"]+"\s*:', r"\n")),
    Language("yaml", ("yml",), ("yaml", "yml"), (r"(?m)^[a-zA-Z_].*:", r"\n-\x20", r"\n")),
    Language("toml", (), ("toml",), (r"(?m)^\[", r"\n\n", r"\n")),
    Language("xml", (), ("xml",), (r"<[a-zA-Z]", r"\n")),
    Language("sql", (), ("sql",), (r"(?m)^SELECT ", r"(?m)^INSERT ", r"(?m)^UPDATE ", r"(?m)^DELETE ", r"(?m)^CREATE ", r"(?m)^ALTER ", r"(?m)^DROP ", r";", r"\n")),
    Language("r", (), ("r",), (r"(?m)^\w+ <- function", r"\n\n", r"\n")),
    Language("fortran", ("f90", "f95", "f03"), ("f", "f90", "f95", "f03"), (r"(?m)^subroutine ", r"(?m)^function ", r"(?m)^module ", r"(?m)^program ", r"\n\n", r"\n")),
    Language("pascal", ("pas", "delphi", "dpr"), ("pas", "dpr"), (r"(?m)^procedure ", r"(?m)^function ", r"(?m)^begin", r"(?m)^end", r"\n\n", r"\n")),
    Language("solidity", ("sol",), ("sol",), (r"(?m)^contract ", r"(?m)^function ", r"(?m)^modifier ", r"(?m)^event ", r"\n\n", r"\n")),
    Language("dtd", (), ("dtd",), (r"<!ELEMENT", r"<!ATTLIST", r"<!ENTITY", r"\n")),
)
# Separators of other texts.
PLAIN = (r"\n\n", r"\n", r"\. ")


def languages() -> tuple[Language, ...]:
    return LANGUAGES


_BY_KEY: dict[str, Language] = {}
for _keys in (lambda x: [x.name], lambda x: x.aliases, lambda x: x.extensions):
    for _language in LANGUAGES:
        for _key in _keys(_language):
            _BY_KEY.setdefault(_key, _language)


def lookup(key: str) -> Language | None:
    """By name, other name, or extension with or without its dot."""
    key = key.lower()
    return _BY_KEY.get(key) or _BY_KEY.get(key.removeprefix("."))


@dataclass
class Chunk:
    text: str
    start: int
    end: int


def _word_chunks(text: str, a: int, b: int, size: int, least: int, overlap: int) -> list[Chunk]:
    """Chunks of text[a:b] as windows over its words joined by single spaces.

    A window takes as many words as fit, and one new word at least; the next one begins with the words that start within
    the last `overlap` characters. Offsets are those of the first and last word.
    """
    spans = [m.span() for m in WORD.finditer(text, a, b)]
    if not spans:
        return [Chunk(text[a:b], a, b)]
    ends = list(accumulate((y - x + 1 for x, y in spans), initial=-1))[1:]  # of words in the joined string
    starts = [end - (y - x) for end, (x, y) in zip(ends, spans, strict=True)]
    joined = " ".join(text[x:y] for x, y in spans)
    out, first, done = [], 0, 0  # words before `done` are in a window
    while done < len(spans):
        done = max(done + 1, bisect_right(ends, starts[first] + size))
        end = ends[done - 1]
        out.append(Chunk(joined[starts[first] : end], spans[first][0], spans[done - 1][1]))
        if end - starts[first] > overlap:
            first = bisect_right(starts, end - overlap)
    return [c for c in out if len(c.text) >= least] or out


def _pieces(text: str, separators: tuple[str, ...], size: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it still has to be cut between words) of the intervals that separators make of a text."""
    patterns = [re.compile(x) for x in separators]
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            yield a, b, False
        elif level == len(patterns):
            yield a, b, True
        else:
            places = [a, *sorted({m.start() for m in patterns[level].finditer(text, a, b)} - {a}), b]
            parts, i = [], 0
            while i + 1 < len(places):
                far = max(i + 1, bisect_right(places, places[i] + size) - 1)
                parts.append((places[i], places[far], level + 1))
                i = far
            todo += reversed(parts)


def chunk(text: str | None, language: str | None = None, size: int = SIZE, overlap: int = OVERLAP, least: int = MIN_CHARS) -> list[Chunk]:
    """Chunks of at most size characters (before overlap), split at the coarsest separators that do.

    A chunk that does not already overlap the one before begins with the words of up to `overlap` characters before it.
    Chunks below `least` go unless all are. Unknown languages split at blank lines, newlines and sentences.
    """
    if not text:
        return []
    found = lookup(language) if language else None
    out: list[Chunk] = []
    for a, b, long in _pieces(text, found.separators if found else PLAIN, size):
        made = _word_chunks(text, a, b, size, least, overlap) if long else [Chunk(text[a:b], a, b)]
        if out and made[0].start >= out[-1].end:
            _, _, before = text[max(0, a - overlap) : a].partition(" ")
            if before:
                made[0] = Chunk(before + made[0].text, a - len(before), made[0].end)
        out += made
    return [c for c in out if len(c.text) >= least] or out


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language: str | None = None, type_col: str | None = None, size: int = SIZE, overlap: int = OVERLAP, least: int = MIN_CHARS) -> DataFrame:
    """id, chunk_index, chunk_text, start_offset, end_offset for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, c.text, c.start, c.end) for i, t, ft in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True) for k, c in enumerate(chunk(t.as_py(), language or ft, size, overlap, least))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "chunk_index", "chunk_text", "start_offset", "end_offset"])

    ft = F.col(type_col) if type_col else F.lit("")
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), ft.alias("ft"))
    return x.mapInArrow(run, f"id {dict(x.dtypes)['id']}, chunk_index int, chunk_text string, start_offset int, end_offset int")


def language_table(spark: SparkSession) -> DataFrame:
    rows = [(x.name, list(x.aliases), list(x.extensions)) for x in languages()]
    return spark.createDataFrame(rows, "name string, aliases array<string>, extensions array<string>")
