"""Text extraction from file contents: a registry of extractors, and the operator that applies it.

An optional parser comes before the built-in extractors, and these before plugins. Files of unknown type have no
extractor and are skipped. Broken content gives an empty text.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import re
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters per page below which a PDF's text counts as missing and is read optically where that is possible.
OCR_CHARS = 50


@dataclass
class Extracted:
    text: str
    extractor: str
    page_offsets: list[int] = field(default_factory=list)


class Extractor(ABC):
    """What a plugin implements."""

    @abstractmethod
    def supported_extensions(self) -> list[str]: ...

    @abstractmethod
    def extract(self, path: str, content: bytes) -> str: ...

    def name(self) -> str:
        return type(self).__name__.lower()

    def pages(self, path: str, content: bytes) -> Extracted:
        return Extracted(self.extract(path, content), self.name())


def decode(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


class Text(Extractor):
    def supported_extensions(self):
        return [".txt", ".md"]

    def extract(self, path, content):
        return decode(content)

    def name(self):
        return "text"


class Code(Extractor):
    def supported_extensions(self):
        return ".py .js .ts .go .rs .java .c .cpp .rb".split()

    def extract(self, path, content):
        return f"# File: {PurePosixPath(path).name}\n{decode(content)}"

    def name(self):
        return "code"


def rows_to_text(title: str, rows: list[list]) -> str:
    """A sheet as text: its title, then each row's cells as "column: cell"; blank cells and rows without any go."""
    if not rows:
        return ""
    names = [f"col_{i}" if h is None else str(h) for i, h in enumerate(rows[0])]
    lines = [f"Sheet: {title}"]
    for row in rows[1:]:
        cells = [(names[i] if i < len(names) else f"col_{i}", "" if c is None else str(c)) for i, c in enumerate(row)]
        line = "; ".join(f"{n}: {c}" for n, c in cells if c.strip())
        if line:
            lines.append(line)
    return "\n".join(lines)


class Spreadsheet(Extractor):
    def supported_extensions(self):
        return [".csv", ".tsv", ".xlsx", ".xls"]

    def extract(self, path, content):
        p = PurePosixPath(path)
        if p.suffix.lower() in (".csv", ".tsv"):
            text = content.decode("utf-8", "replace")
            return rows_to_text(p.stem, list(csv.reader(io.StringIO(text, newline=""), delimiter="\t" if p.suffix.lower() == ".tsv" else ",")))
        try:
            import openpyxl
        except ImportError:
            return self._plain(content)
        book = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True)
        return "\n\n".join(rows_to_text(s, rows) for s in book.sheetnames if (rows := [list(r) for r in book[s].iter_rows(values_only=True)]))

    @staticmethod
    def _plain(content: bytes) -> str:
        """Cells of an .xlsx read from its XML: shared and inline strings and values as they stand."""
        main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
            target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            out = []
            for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
                rows = []
                for row in ElementTree.fromstring(z.read("xl/" + target[sheet.get(link)].removeprefix("/xl/"))).iter(f"{main}row"):
                    cells: list = []
                    for c in row.iter(f"{main}c"):
                        letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                        at = 0
                        for ch in letters:
                            at = at * 26 + ord(ch) - 64
                        cells += [None] * (at - 1 - len(cells)) if at else []
                        v = c.find(f"{main}v")
                        value = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                        cells.append(shared[int(value)] if c.get("t") == "s" and value is not None else value)
                    rows.append(cells)
                if rows:
                    out.append(rows_to_text(sheet.get("name"), rows))
        return "\n\n".join(out)

    def name(self):
        return "spreadsheet"


class Docx(Extractor):
    def supported_extensions(self):
        return [".docx"]

    def extract(self, path, content):
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        return "\n".join("".join({f"{w}t": x.text or "", f"{w}tab": "\t", f"{w}br": "\n"}.get(x.tag, "") for x in p.iter()) for p in body.findall(f"{w}p"))

    def name(self):
        return "docx"


class Pptx(Extractor):
    def supported_extensions(self):
        return [".pptx"]

    def extract(self, path, content):
        a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
            return "\n\n".join("\n".join("".join(t.text or "" for t in p.iter(f"{a}t")) for p in ElementTree.fromstring(z.read(n)).iter(f"{a}p")).strip() for _, n in slides)

    def name(self):
        return "pptx"


class Email(Extractor):
    """.eml by the standard library, .msg where an optional package reads it."""

    def supported_extensions(self):
        return [".eml", ".msg"]

    def extract(self, path, content):
        if path.lower().endswith(".msg"):
            try:
                import extract_msg
            except ImportError:
                return ""
            m = extract_msg.Message(io.BytesIO(content))
            head, body = (m.subject, m.sender, m.to, m.date), m.body or ""
        else:
            m = email.message_from_bytes(content, policy=email.policy.default)
            head = tuple(m.get(k, "") for k in ("Subject", "From", "To", "Date"))
            parts = list(m.walk()) if m.is_multipart() else [m]
            found = {}
            for part in parts:
                kind = part.get_content_type()
                if kind not in found and (kind in ("text/plain", "text/html") or not m.is_multipart()):
                    value = part.get_content()
                    if isinstance(value, str):
                        found[kind] = value
            body = found.get("text/plain") or found.get("text/html") or next(iter(found.values()), "")
        return "Subject: {} / From: {} / To: {} / Date: {}\n\n{}".format(*(x or "" for x in head), body).strip()

    def name(self):
        return "email"


class _Data(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(source: str) -> str:
    """Text of an HTML page without tags, scripts and styles; blocks become lines, blank lines go."""
    parser = _Data()
    parser.feed(source)
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.parts).split("\n")) if x)


class Html(Extractor):
    def supported_extensions(self):
        return [".html"]

    def extract(self, path, content):
        return html_text(decode(content))

    def name(self):
        return "html"


class Epub(Extractor):
    """Chapters in the order of the spine, each under a title from its file's name."""

    def supported_extensions(self):
        return [".epub"]

    def extract(self, path, content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            opf = next(n for n in z.namelist() if n.endswith(".opf"))
            root = ElementTree.fromstring(z.read(opf))
            items = {x.get("id"): x for x in root.iter() if x.tag.endswith("}item")}
            order = [items[x.get("idref")] for x in root.iter() if x.tag.endswith("}itemref") and x.get("idref") in items]
            base, out = PurePosixPath(opf).parent, []
            for item in order or items.values():
                if "html" not in (item.get("media-type") or ""):
                    continue
                parser = _Data()
                parser.handle_starttag = lambda tag, attrs: None
                parser.feed(z.read(str(base / item.get("href"))).decode("utf-8", "replace"))
                text = "".join(parser.parts).strip()
                if text:
                    title = PurePosixPath(item.get("href")).stem.replace("_", " ").replace("-", " ")
                    out.append(f"## {title}\n\n{text}")
        return "\n\n".join(out)

    def name(self):
        return "epub"


def join_pages(pages: list[str]) -> tuple[str, list[int]]:
    """Pages joined by newlines, and the offset at which each begins."""
    offsets, at = [], 0
    for p in pages:
        offsets.append(at)
        at += len(p) + 1
    return "\n".join(pages), offsets


class Pdf(Extractor):
    """Needs an optional PDF package; without it the text is empty."""

    def supported_extensions(self):
        return [".pdf"]

    def pages(self, path, content):
        try:
            import fitz
        except ImportError:
            return Extracted("", self.name())
        with fitz.open(stream=content, filetype="pdf") as doc:
            pages, used = [p.get_text() for p in doc], self.name()
            if needs_ocr(pages):
                try:
                    import pytesseract
                    from PIL import Image

                    seen = [pytesseract.image_to_string(Image.open(io.BytesIO(p.get_pixmap(dpi=200).tobytes("png")))) for p in doc]
                    if any(s.strip() for s in seen):
                        pages, used = seen, "ocr_tesseract"
                except ImportError:
                    pass
        return Extracted(*(lambda t, o: (t, used, o))(*join_pages(pages)))

    def extract(self, path, content):
        return self.pages(path, content).text

    def name(self):
        return "pdf"


def needs_ocr(pages: list[str]) -> bool:
    return bool(pages) and len("".join(pages).strip()) < OCR_CHARS * len(pages)


class Obsidian(Extractor):
    """Markdown notes below a folder that has .obsidian: no front matter, links as their shown text."""

    def supported_extensions(self):
        return [".md"]

    def extract(self, path, content):
        text = re.sub(r"\A---\s*\n.*?\n---\s*\n", "", decode(content), flags=re.S)
        return re.sub(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", lambda m: m[2] or m[1], text)

    def name(self):
        return "obsidian"


BUILT_IN = (Text(), Code(), Spreadsheet(), Docx(), Pptx(), Email(), Html(), Epub(), Pdf())
_plugins: dict[str, Extractor] = {}


def register(plugin: Extractor | type[Extractor]) -> None:
    """Add a plugin for the extensions that no built-in extractor has. What is no Extractor is refused."""
    plugin = plugin() if isinstance(plugin, type) and issubclass(plugin, Extractor) else plugin
    if not isinstance(plugin, Extractor):
        raise TypeError(f"{plugin!r} is no Extractor")
    for ext in plugin.supported_extensions():
        _plugins[ext.lower()] = plugin


def discover(group: str = "quarry.extractors") -> list[str]:
    """Register the plugins that installed packages announce; names that begin with builtin_ are skipped."""
    import importlib.metadata
    import warnings

    names = []
    for point in importlib.metadata.entry_points(group=group):
        if point.name.startswith("builtin_"):
            continue
        try:
            register(point.load())
            names.append(point.name)
        except Exception as e:  # a broken plugin must not stop the others
            warnings.warn(f"plugin {point.name}: {e}", stacklevel=2)
    return names


def registry() -> dict[str, Extractor]:
    """Extractor by extension."""
    return _plugins | {ext: x for x in BUILT_IN for ext in x.supported_extensions()}


def extract(path: str, content: bytes, vault: bool = False, known: dict[str, Extractor] | None = None) -> Extracted | None:
    """The text of one file, or None for an unknown type; vault: the file stands in a folder of notes."""
    ext = PurePosixPath(path).suffix.lower()
    found = Obsidian() if vault and ext == ".md" else (registry() if known is None else known).get(ext)
    if found is None:
        return None
    try:
        return found.pages(path, content)
    except Exception:  # whatever a broken file raises, it has no text
        return Extracted("", found.name())


OUT = "text string, extractor string, page_offsets array<int>"


def extract_files(files: DataFrame) -> DataFrame:
    """files (path, content, and further columns but text, extractor, page_offsets) with OUT; files of unknown type go.

    A folder is one of notes if a path of the table leads through its .obsidian folder.
    """
    vaults = files.where(F.col("path").contains("/.obsidian/")).select(F.regexp_extract("path", r"^(.*?)/\.obsidian/", 1).alias("_root")).distinct()
    plain = files.where(~F.col("path").contains("/.obsidian/"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    in_vault = plain.select("path", F.explode(above).alias("_root")).join(vaults, "_root", "left_semi").select(F.col("path").alias("_p")).distinct()
    x = plain.join(in_vault, plain.path == in_vault["_p"], "left").withColumn("_vault", F.col("_p").isNotNull()).drop("_p")
    kept = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{n}` {t}" for n, t in files.select(*kept).dtypes) + f", {OUT}"
    known = registry()  # plugins travel with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(p, c or b"", v, known) for p, c, v in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), batch.column("_vault").to_pylist(), strict=True)]
            keep = pa.array([g is not None for g in got])
            some = [g for g in got if g is not None]
            cols = [batch.column(c).filter(keep) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g.text for g in some], pa.string()), pa.array([g.extractor for g in some], pa.string()), pa.array([g.page_offsets or None for g in some], pa.list_(pa.int32()))], names=[*kept, "text", "extractor", "page_offsets"])

    return x.select(*kept, "content", "_vault").mapInArrow(run, schema)
