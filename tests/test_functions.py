"""Parser, chunkers, extractors, scans and schema evolution."""

import hashlib
import io
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import chunking, extract, query_parser, recursive, text
from quarry.operators import bm25, hybrid
from quarry.schema import VECTOR, IncompatibleSchema, SchemaLog
from quarry.sources import files


@pytest.mark.parametrize(
    ("raw", "terms", "arithmetic"),
    [
        ("pricing strategy", "+pricing +strategy", False),
        ("climate change -demographics", "+climate +change -demographics", True),
        ("pricing +recent -draft -internal", "+pricing +recent -draft -internal", True),
        ('+"pricing strategy" -"internal draft"', "+pricing strategy -internal draft", True),
        ("C++ programming", "+C++ +programming", False),
        ("well-known a - b", "+well-known +a -b", True),
        ("auth -test +web", "+auth -test +web", True),
        ("", "", False),
        ("   ", "", False),
    ],
)
def test_parser(raw, terms, arithmetic):
    q = query_parser.parse(raw)
    assert " ".join(("+" if t.sign > 0 else "-") + t.text for t in q.terms) == terms and q.arithmetic == arithmetic


def test_vectors():
    v = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    q = query_parser.parse("a -b")
    assert query_parser.combine(q, v.get) == pytest.approx([2**-0.5, -(2**-0.5)])
    assert query_parser.combine(query_parser.parse("a +a"), v.get) == pytest.approx([1, 0]) and q.base_text == "a"
    assert query_parser.refine([1, 0], [[0, 1]], []) == pytest.approx([1 / 1.09**0.5, 0.3 / 1.09**0.5])
    with pytest.raises(ValueError):
        query_parser.combine(query_parser.parse(""), v.get)


def test_windows():
    t = "word " * 300
    c = chunking.chunk(t, 200, 20)
    assert all(100 <= len(x) <= 200 for x in c) and c[0] == ("word " * 40).strip()
    assert chunking.chunk("x" * 1000, 200, 20) == ["x" * 200] * 5 + ["x" * 100] and chunking.chunk("short") == []
    assert chunking.chunk(None) == chunking.chunk(" \n") == []


def test_structural_chunkers():
    a, b = "alpha " * 30, "beta " * 30
    assert chunking.chunk(f"intro\n# One\n{a}\n## Two\n{b}", 500, 50, ".md") == [f"# One\n{a}".strip(), f"## Two\n{b}".strip()]
    assert chunking.chunk(f"def f():\n{a}\nclass X:\n{b}", 500, 50, ".py") == [f"def f():\n{a}".strip(), f"class X:\n{b}".strip()]
    p = chunking.chunk(f"{a}\n\ntiny\n\n{b}\n\nend", 190, 20, ".pdf")
    assert p == [f"{a.strip()}\n\ntiny", f"{b.strip()}\n\nend"]
    assert chunking.chunk(f"tiny\n\n{'y' * 490}", 490, 20, ".pdf") == ["y" * 490]
    rows = "\n".join(f"name: n{i}; city: c{i}" for i in range(40))
    s = chunking.chunk(f"Sheet: A\n{rows}\n\nSheet: B\n{a}", 300, 20, ".csv")
    assert s[-1] == f"Sheet: B\n{a}".strip() and all(100 <= len(x) <= 300 for x in s) and s[0].startswith("Sheet: A\nname: n0")


def test_recursive_chunker():
    assert len(recursive.languages()) == 28
    for key, name in [("py", "python"), (".hpp", "cpp"), ("c#", "csharp"), ("YML", "yaml"), ("f90", "fortran"), ("Solidity", "solidity")]:
        assert recursive.lookup(key).name == name
    assert recursive.lookup("nope") is None
    r = random.Random(1)
    t = "\n\n".join(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 28))) + "." for _ in range(60))
    for lang in (None, "md", "py", "json"):
        c = recursive.chunk(t, lang, 300, 0, 1)
        assert all(len(x.text) <= 300 for x in c)
        if lang != "json":
            assert "".join(x.text for x in c) == t and all(t[x.start : x.end] == x.text for x in c)
    over = recursive.chunk(t, None, 300, 50, 1)
    assert all(b.start <= a.end and t[b.start : b.end] == b.text for a, b in zip(over, over[1:], strict=False))
    assert all(len(x.text) <= 50 for x in recursive.chunk("word " * 100, "json", 50, 10, 1))
    assert recursive.chunk("") == [] and recursive.chunk("abc")[0].text == "abc"


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_extractors():
    get = lambda p, c, **k: extract.extract(p, c, **k).text
    assert get("a.txt", "é".encode("latin-1")) == "é" and get("x/b.py", b"pass") == "# File: b.py\npass"
    assert get("d.csv", b'Name,City\nAnn,"Old\nTown",extra\n , \nBob,\n') == "Sheet: d\nName: Ann; City: Old\nTown; col_2: extra\nName: Bob"
    assert get("d.tsv", b"a\tb\n1\t2\n") == "Sheet: d\na: 1; b: 2" and get("e.csv", b"") == ""
    assert get("m.eml", b"From: a@x\nTo: b@x\nSubject: Hi\nDate: D\n\nBody\n") == "Subject: Hi / From: a@x / To: b@x / Date: D\n\nBody"
    multi = b'From: a\nSubject: S\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="q"\n\n--q\nContent-Type: text/html\n\n<b>h</b>\n--q\nContent-Type: text/plain\n\nplain\n--q--\n'
    assert get("m.eml", multi).endswith("\n\nplain")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    assert get("a.docx", _zip(**{"word__document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'})) == "One\nTwo"
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="ch_one-x.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>'
    assert get("b.epub", _zip(**{"o.opf": opf, "ch_one-x.xhtml": "<html><body><p>Text</p></body></html>"})) == "## ch one x\n\nText"
    assert get("n.md", b"---\nt: 1\n---\n[[P]] and [[Q|shown]]", vault=True) == "P and shown" and "[[P]]" in get("n.md", b"[[P]]")
    assert get("p.html", b"<h1>T</h1><script>x</script><p>a &amp; b") == "T\na & b"
    assert extract.extract("a.unknown", b"") is None and get("bad.docx", b"no zip") == ""
    assert extract.join_pages(["ab", "c"]) == ("ab\nc", [0, 3]) and extract.needs_ocr(["", "x"]) and not extract.needs_ocr(["y" * 120])
    with pytest.raises(TypeError):
        extract.register(str)

    class Own(extract.Extractor):
        def supported_extensions(self):
            return [".own", ".txt"]

        def extract(self, path, content):
            return "own"

    extract.register(Own)
    assert get("a.own", b"") == "own" and get("a.txt", b"t") == "t"


def test_vault_rows(spark):
    rows = [("/v/.obsidian/app.md", bytearray(b"x")), ("/v/sub/n.md", bytearray(b"[[A|b]]")), ("/o/n.md", bytearray(b"[[A|b]]")), ("/o/z.zzz", bytearray(b""))]
    got = {r.path: (r.text, r.extractor) for r in extract.extract_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"/v/sub/n.md": ("b", "obsidian"), "/o/n.md": ("[[A|b]]", "text")}


@pytest.fixture
def tree(tmp_path):
    for p, data in {"a.py": b"1", "b.py": b"2", "sub/c.md": b"3", "sub/d.txt": "é".encode("latin-1"), ".hidden/e.py": b"4", "big.py": b"x" * 5000, "LOUD.PY": b"5", "_x.md": b"6", "node_modules/f.js": b"7", "ig/skip.log": b"8"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    return tmp_path


def test_walk(spark, tree):
    names = lambda paths: [str(p).removeprefix(f"{tree}/") for p in paths]
    assert names(files.walk(str(tree), ["py"], 2000)) == ["LOUD.PY", "a.py", "b.py"]
    assert "_x.md" in names(files.walk(str(tree))) and ".hidden/e.py" in names(files.walk(str(tree), skip_hidden=False))
    assert files.walk(str(tree / "none")) == []
    (tree / ".git").mkdir()
    (tree / ".gitignore").write_text("*.log\n/sub/\n!keep.log\n")
    assert names(files.walk(str(tree), git_aware=True)) == [".gitignore", ".hidden/e.py", "LOUD.PY", "_x.md", "a.py", "b.py", "big.py"]
    got = files.scan(spark, str(tree), ["py", "txt"], 2000, filesPerPartition=2)
    assert {r.path.rpartition("/")[2]: r.sha256 for r in got.collect()} == {n: hashlib.sha256(d).hexdigest() for n, d in {"a.py": b"1", "b.py": b"2", "LOUD.PY": b"5", "d.txt": "é".encode("latin-1")}.items()}
    assert {r.path.rpartition("/")[2]: r.text for r in files.bulk_texts(got).collect()}["d.txt"] == "é"


def test_changes():
    assert files.changes({"a": [1, 1], "b": [1, 1]}, {"a": [2, 1], "c": [1, 1]}) == [("modified", "a"), ("deleted", "b"), ("created", "c")]


def test_point_ids(spark):
    rows = [("/a/ü.txt", 0), ("/b", 12), ("x", 3)]
    got = spark.createDataFrame(rows, "p string, i int").select("p", "i", text.point_id(F.col("p"), F.col("i")).alias("u"), text.file_suffix(F.col("p")).alias("s")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(text.NAMESPACE_ID), f"{r.p}:{r.i}")) for r in got) and [r.s for r in got] == [".txt", "", ""]


def test_schema(spark, tmp_path):
    log = SchemaLog(spark, f"file://{tmp_path}/store")
    base = {"file_path": "keyword", "chunk_text": "text", "chunk_index": "integer"}
    assert log.history().count() == 0 and log.migrate("a", base) == 1 and log.migrate("a", base) == 1
    assert log.migrate("a", base | {"tags": "keyword"}) == 2 and log.migrate("b") == 1
    assert {(r.collection, r.version) for r in log.current().collect()} == {("a", 2), ("b", 1)}
    assert [r.version for r in log.history().where("collection = 'a'").orderBy("version").collect()] == [1, 2]
    for fields, vector in ((base, None), (base | {"tags": "text"}, None), (base | {"tags": "keyword"}, VECTOR | {"size": 768})):
        with pytest.raises(IncompatibleSchema):
            log.migrate("a", fields, vector)
    assert SchemaLog(spark, f"file://{tmp_path}/store").current().where("collection = 'a'").first().fields == base | {"tags": "keyword"}


def test_tiny_corpora(spark):
    one = spark.createDataFrame([(1, "fox dog")], "doc_id long, text string")
    assert bm25.search(bm25.build(one), "fox").count() == 0
    two = spark.createDataFrame([(1, "fox dog"), (2, "cat")], "doc_id long, text string")
    assert bm25.search(bm25.build(two), "fox").count() == 0  # a term in half of all documents weighs nothing
    three = spark.createDataFrame([(1, "fox dog"), (2, "cat"), (3, None)], "doc_id long, text string")
    rows = bm25.search(bm25.build(three), "fox fox").collect()
    single = bm25.search(bm25.build(three), "fox").first()
    assert [r.id for r in rows] == [1] and rows[0].score == pytest.approx(2 * single.score)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.8)], "rank int, id int, score double")
    b = spark.createDataFrame([(1, 3, 10.0), (2, 1, 8.0)], "rank int, id int, score double")
    got = hybrid.hybrid(a, b, 10).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3, 2] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert [r.id for r in hybrid.hybrid(a, b, 10, compat=True).orderBy("rank").collect()] == [1, 2]
    assert [(r.id, r.score) for r in hybrid.hybrid(a, b.limit(0), 1).collect()] == [(1, 0.9)]
