"""Operator 6: HTML main text with removal of site templates.

Every page is parsed once, into elements; each element's subtree gets a hash of its tags, classes and text. A page leaves
the blocks of its main text, by the rules of tags, roles and class names below, each with the hashes of the subtrees that
hold it. Spark counts, per host, the pages on which each subtree occurs, and blocks of subtrees that recur go.

Inside an article a subtree goes only if it bears the marks of furniture: mostly links or controls, or a class or id, at
the same place of most of the host's pages. Plain paragraphs, quotations and headings stay however often they are said.
"""

from __future__ import annotations

import bisect
import functools
import html as _html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: A subtree is a template if it is on this many pages of its host and on this share of them.
MIN_PAGES, MIN_SHARE = 3, 0.1
#: Where the share of a host is more pages than this, this many are enough: a section of a large host has its own templates.
ENOUGH_PAGES = 20
#: In an article, a marked subtree that is not mostly links must be on this share of the host's pages.
MOST_PAGES = 0.5
#: Templates that are broadcast (16 bytes each); beyond it they are joined to the pages by shuffles.
BROADCAST_TEMPLATES = 1_000_000

# Elements by role in the HTML standard, and words of class, id and role attributes that mark page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe xmp noembed noframes title".split())
DROPPED = set("script style noscript template textarea iframe xmp noembed noframes title head nav footer aside form button input select option datalist label fieldset object embed applet canvas svg math audio video map menu dialog".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "caption", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
FURNITURE = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription share sharing social sidebar sidebars rail widget widgets related recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation masthead topbar footer comment comments commentlist disqus reply replies respond discussion login signin signup register search pagination pager toolbar copyright disclaimer hidden offscreen".split())
#: Words of FURNITURE that an article may be about: its elements of that name are furniture only with links or controls.
AMBIGUOUS = set("consent copyright disclaimer discussion promotion rail register related search share sharing social subscription".split())
LINKS = set("a button datalist form input label option select textarea".split())
#: Elements of an article that are deleted with what holds them only: alone, equal ones are headings, items and cells.
PARTS = set("caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup legend li summary tbody td tfoot th thead tr".split())
#: Elements whose ids name their subject.
ANCHORED = set("a dd dt h1 h2 h3 h4 h5 h6 li p section".split())
P, P_SCOPE = {"p"}, {"td", "th", "table", "button", "li", "blockquote", "div", "section", "article"}
#: Start tags that close the nearest of their siblings; the others close all up to their scope.
NEAREST = {"li", "td", "th", "dt", "dd", "option"}
HEAD_WORDS = {"header", "heading"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

# No part can match a text in two ways, so the time is linear. Quotes hold a > only after an equals sign; a tag that the
# page's end cuts off is dropped.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)(>|\Z)|[^<]++|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("attrs", "core", "hash", "items", "linked", "own", "size", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.items, self.core, self.hash, self.own = tag, attrs, [], False, 0, False
        self.size = self.linked = 0  # characters of text, and those in links and controls


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2].strip("\"'") if m[2] else "") for m in _ATTR.finditer(source)} if source.strip() else {}


class _Open:
    """The open elements, with the places of each tag and of the blocks, so that no search walks the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the element at this place and all in it."""
        for x in reversed(self.stack[at:]):
            self.places[x.tag].pop()
            if x.tag in BLOCKS:
                self.blocks.pop()
        del self.stack[at:]

    def last(self, tags: set[str] | frozenset[str]) -> int:
        """The innermost place of any of these tags, the root aside; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags: set[str], at: int) -> int:
        """The outermost place of any of these tags beyond a place; 0 if there is none."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect.bisect_right(p, at)) < len(p)]
        return min(found, default=0)


def parse(page: str) -> Node:
    """A tree of a page; unclosed and stray tags are mended as browsers do in the common cases. Linear in the page."""
    root = Node("html", {})
    opened, at, n = _Open(root), 0, len(page)
    stack, token = opened.stack, _TOKEN.match
    while at < n:
        m = token(page, at)
        at = m.end()
        text = m[0]
        if text[0] != "<" or len(text) == 1:
            stack[-1].items.append(_html.unescape(text))
        elif m[2] and m[4]:
            tag = m[2].lower()
            if tag == "html" or tag == "body" and opened.places.get("body"):
                continue
            if tag in CLOSES_P and (p := opened.last(P)) > opened.last(P_SCOPE):
                opened.cut(p)
            if tag in SIBLINGS:
                stop = opened.last(SCOPE[tag])
                if tag in NEAREST:
                    closed = opened.last(SIBLINGS[tag])
                else:
                    closed = opened.first_after(SIBLINGS[tag], stop)
                if closed > stop:
                    opened.cut(closed)
            node = Node(tag, _attributes(m[3]))
            stack[-1].items.append(node)
            if tag in RAW:
                end = _raw_end(tag).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path", "g")):
                opened.push(node)
        elif m[1]:
            tag = m[1].lower()
            place = opened.last({tag})
            if tag == "p" and not place:
                stack[-1].items.append(Node("p", {}))
            if place and (tag in BLOCKS or opened.blocks[-1] < place):  # a stray inline end tag closes no block
                opened.cut(place)
    return root


@functools.cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)


def _finish(node: Node) -> None:
    """Hash every subtree and note which hold an article or main element. Children come first, without recursion."""
    import xxhash

    todo = [(node, False, False)]
    while todo:
        x, seen, within = todo.pop()
        within = within or x.tag in ("article", "main")
        if not seen:
            todo.append((x, True, within))
            todo += [(c, False, within) for c in x.items if isinstance(c, Node)]
            continue
        if x.tag not in RAW:
            x.size = sum(c.size if isinstance(c, Node) else len("".join(c.split())) for c in x.items)
        # a control counts as a character of text
        x.linked = max(x.size, x.tag != "a") if x.tag in LINKS else sum(c.linked for c in x.items if isinstance(c, Node))
        x.core = any(isinstance(c, Node) and (c.core or c.tag in ("article", "main")) and not _is_furniture(c, True, within) for c in x.items)
        parts = [x.tag, x.attrs.get("class", ""), x.attrs.get("id", "")]
        parts += [str(c.hash) if isinstance(c, Node) else " ".join(c.split()) for c in x.items]
        x.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace")) - (1 << 63)
        x.own = x.tag == "main" and x.core and _has_text(x)


def _is_furniture(x: Node, inside: bool, whole: bool = True) -> bool:
    """Whether an element is page furniture by its tag, role, class or id; inside: it stands in an article or main.

    Inside, names count as a whole (unless whole is false); elsewhere any word of a name counts.
    """
    if x.tag in DROPPED or (x.tag == "header" and not inside and not x.core):
        return True
    if not x.attrs or x.tag in ("html", "body", "main") or x.core:
        return False
    a = x.attrs
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if inside and whole:  # ids of headings and sections are anchors that repeat their titles
        names = set(a.get("class", "").lower().split())
        if x.tag not in ANCHORED:
            names.add(a.get("id", "").strip().lower())
        return bool(names & FURNITURE - AMBIGUOUS) or x.linked > 0 and bool(names & FURNITURE)
    words = {w.lower() for w in _WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    return bool(words & FURNITURE) or (not inside and bool(words & HEAD_WORDS))


def _has_text(x: Node) -> bool:
    """Whether an element has text that is neither furniture nor in an article. Inner main elements know it of themselves."""
    todo = [x]
    while todo:
        for c in todo.pop().items:
            if isinstance(c, str):
                if c.strip():
                    return True
            elif c.tag == "main" and c.core:
                if c.own and not _is_furniture(c, True):
                    return True
            elif c.tag != "article" and not _is_furniture(c, True):
                todo.append(c)
    return False


def _roots(page: Node) -> tuple[list[Node], bool]:
    """The elements that hold the main text, and whether they are articles or main elements.

    A main element with text beside its articles is taken whole.
    """
    for wanted in ("article", "main"):
        found, todo = [], [(page, False)]
        while todo:
            x, within = todo.pop()
            if (x.tag == wanted or x.own) and not _is_furniture(x, True, within):
                found.append(x)
            elif not _is_furniture(x, within):
                todo += [(c, within or x.tag == "main") for c in reversed(x.items) if isinstance(c, Node)]
        if found:
            return found, True
    return [page], False


def _removable(x: Node, inside: bool) -> bool:
    """Whether template removal may delete an element; inside: it stands in an article or main."""
    if x.tag not in BLOCKS or x.core or x.tag in ("html", "body", "article", "main"):
        return False
    return not inside or x.tag not in PARTS and (_mostly_links(x) or "class" in x.attrs or "id" in x.attrs)


def _mostly_links(x: Node) -> bool:
    return x.linked > 0 and 2 * x.linked >= x.size


def tree(page: str) -> Node:
    root = parse(page)
    _finish(root)
    return root


def blocks(root: Node) -> tuple[list[str], list[tuple[int, int, bool, int, int]]]:
    """The blocks of a page's main text, and what template removal may delete of them.

    A block is its text, white space inside as one space. Each removable element gives (mark, place, most, start, end): it
    holds the blocks from start to before end. Its mark is the subtree's hash, inside an article with its path from there;
    most tells whether it must be on most of the host's pages. The place is 0 outside articles, else the hash of the
    innermost article or main, so that one article on several pages counts once.
    """
    roots, inside = _roots(root)
    out: list[list[str]] = [[]]
    spans: list[list] = []
    # (element or text, innermost core's hash, path from it); a number closes a block, and the span of that number
    todo: list = [(x, 0, 0) for x in reversed(roots)]
    while todo:
        x, core, path = todo.pop()
        if isinstance(x, str):
            out[-1].append(x)
        elif isinstance(x, Node):
            if _is_furniture(x, inside):
                continue
            if x.tag == "br":
                out[-1].append(" ")
                continue
            core, path = (x.hash, 0) if x.tag in ("article", "main") else (core, _chain(path, x.tag))
            if x.tag in BLOCKS:
                marked = _removable(x, inside)
                if marked:
                    spans.append([_chain(x.hash, path) if inside else x.hash, core if inside else 0, inside and not _mostly_links(x), len(out), 0])
                out.append([])
                todo.append((len(spans) - 1 if marked else -1, 0, 0))
            todo += [(c, core, path) for c in reversed(x.items)]
        else:
            if x >= 0:
                spans[x][4] = len(out)
            out.append([])
    texts = [" ".join("".join(t).split()) for t in out]
    before = [0, *itertools.accumulate(map(bool, texts))]
    held = ((mark, place, most, before[start], before[end]) for mark, place, most, start, end in spans)
    return [t for t in texts if t], [x for x in held if x[3] < x[4]]


def _chain(*parts: int | str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("|".join(map(str, parts)).encode()) - (1 << 63)


def main_text(page: str | Node, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the main text joined by newlines, without those of elements whose marks are templates."""
    texts, spans = blocks(tree(page) if isinstance(page, str) else page)
    gone = [(start, end) for mark, _, _, start, end in spans if mark in templates]
    return "\n".join(t for i, t in enumerate(texts) if not any(start <= i < end for start, end in gone))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough_pages: int = ENOUGH_PAGES, most_pages: float = MOST_PAGES, broadcast: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text for every row of pages (page_id, url, html).

    Null html is empty and gives an empty text. Pages with a null url share one host. Equal text in different articles
    stays unless its elements are marked as furniture is (see above). Repeated rows give repeated rows (and count once for
    templates); other columns are ignored; an empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.select("page_id", "url", F.xxhash64(F.col("page_id").cast("string"), "url", "html").alias("_key"), F.xxhash64(host).alias("_host"), "html")
    kept = [c for c in pages.columns if c != "html"]
    span = "struct<mark long, place long, most boolean, start int, end int>"
    arrow = pa.list_(pa.struct([("mark", pa.int64()), ("place", pa.int64()), ("most", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, marked = [], []
            for key, page in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                texts, spans = blocks(tree(page.as_py()))
                found.append(texts)
                marked.append([dict(zip(("mark", "place", "most", "start", "end"), (m, place or key, *rest), strict=True)) for m, place, *rest in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.string())), pa.array(marked, arrow)], names=[*kept, "blocks", "spans"])

    kind = dict(pages.dtypes)["page_id"]
    parsed = materialize(pages.mapInArrow(scan, f"page_id {kind}, url string, _key long, _host long, blocks array<string>, spans array<{span}>"))
    seen = parsed.where(F.size("spans") > 0).select("_key", "_host", F.explode("spans").alias("m")).select("_key", "_host", "m.mark", "m.place", "m.most")
    sizes = parsed.groupBy("_host").agg(F.count_distinct("_key").alias("pages"))
    counts = seen.groupBy("_host", "mark").agg(F.count_distinct("place").alias("n"), F.min("most").alias("most")).where(F.col("n") >= min_pages)
    enough = F.when(F.col("most"), F.col("pages") * most_pages).otherwise(F.least(F.col("pages") * min_share, F.lit(float(enough_pages))))
    recurring = materialize(counts.join(sizes, "_host").where(F.col("n") >= enough).select("_host", "mark"))
    if recurring.count() <= broadcast:
        hits = seen.join(F.broadcast(recurring), ["_host", "mark"])
    else:
        salts = 16  # a subtree may be on most pages
        salted = recurring.select("_host", "mark", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        hits = seen.withColumn("_salt", F.pmod("_key", F.lit(salts))).join(salted, ["_host", "mark", "_salt"])
    templates = materialize(hits.groupBy("_key").agg(F.collect_set("mark").alias("templates")))  # of one page
    plain = parsed.where(F.size("spans") == 0).withColumn("templates", F.lit(None).cast("array<long>"))
    x = parsed.where(F.size("spans") > 0).join(templates, "_key", "left").select(*parsed.columns, "templates").unionByName(plain)
    gone = F.filter("spans", lambda g: F.coalesce(F.array_contains("templates", g["mark"]), F.lit(False)))
    stays = F.filter("blocks", lambda _, i: ~F.exists(F.col("gone"), lambda g: (g["start"] <= i) & (i < g["end"])))
    return x.withColumn("gone", gone).select("page_id", "url", F.array_join(stays, "\n").alias("text"))


def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; nulls, repeated rows and an empty table as in extract()."""
    x = extract(table(spark, sf_dir, "pages"))
    return x.withColumn("n_chars", F.char_length("text").cast("long"))
