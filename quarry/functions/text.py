"""Column functions of the retrieval engine; all of them are JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is a run of letters, digits and underscores.
TERM = r"[\p{L}\p{N}_]+"
NAMESPACE_ID = "d1b4c5e8-7f3a-4e2b-9a1c-6d8e0f2b3c4a"
NAMESPACE_NAME = r"^[a-z0-9][a-z0-9_-]{0,62}$"

# Words that mark an intent, in order of precedence.
EXIT_WORDS = ("quit", "exit", "stop", "goodbye")
SEARCH_WORDS = ("search for", "find", "look for", "where is")
SEARCH_WORDS_SERVICE = ("search for", "find", "look for", "where is", "locate")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def point_id(path: Column, index: Column) -> Column:
    """uuid5 of "path:index": SHA-1 of the namespace's bytes and the name, with version and variant bits."""
    name = F.concat(path.cast("string"), F.lit(":"), index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_ID.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; names that only begin with a dot, or end with one, have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def preview(text: Column, size: int = 200, mark: str = "...") -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Mark every occurrence of a query word, whatever its case."""
    words = [re.escape(w) for w in dict.fromkeys(query.split())]
    if not words:
        return text
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", f"{before}$1{after}")


def intent(text: Column, service: bool = False) -> Column:
    """exit, search or ask by the first list with a word in the text; the service has no exit words and one search word more."""
    low = F.lower(text)
    has = lambda words: F.coalesce(F.greatest(*[low.contains(w) for w in words]), F.lit(False))
    if service:
        return F.when(has(SEARCH_WORDS_SERVICE), "search").otherwise("ask")
    return F.when(has(EXIT_WORDS), "exit").when(has(SEARCH_WORDS), "search").otherwise("ask")


def collection_name(namespace: Column, base: str = "quarry") -> Column:
    return F.when(F.coalesce(namespace, F.lit("default")) == "default", base).otherwise(F.concat(F.lit(f"{base}_"), namespace))


def key_hash(key: Column) -> Column:
    """First 16 hex digits of the SHA-256 of an API key."""
    return F.substring(F.sha2(key, 256), 1, 16)


def decode_text(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are no UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def decode_strict(content: Column) -> Column:
    """UTF-8 text, or null where the bytes are no UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def resolve_links(text: Column) -> Column:
    """[[page]] becomes page and [[page|shown]] becomes shown."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), r"\[\[([^\]|]+)\]\]", "$1")


def page_numbers(chunks: Column, text: Column, offsets: Column, probe: int = 80) -> Column:
    """For an array of chunk texts, their 1-based pages: each chunk's first characters are sought from where the last were found.

    A chunk that is not found keeps the place before. Without offsets every page is null.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("pages"))

    def step(s: Column, chunk: Column) -> Column:
        hit = F.call_function("locate", F.substring(chunk, 1, probe), text, s["at"] + 1)
        at = F.when(hit > 0, hit - 1).otherwise(s["at"])
        page = F.greatest(F.lit(1), F.size(F.filter(offsets, lambda o: o <= at)))
        return F.struct(at.cast("int").alias("at"), F.concat(s["pages"], F.array(page.cast("int"))).alias("pages"))

    found = F.aggregate(chunks, start, step)["pages"]
    none = F.transform(chunks, lambda _: F.lit(None).cast("int"))
    return F.when(offsets.isNull() | (F.size(offsets) == 0), none).otherwise(found)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * done / total, 1)).otherwise(0.0)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null before the first is done."""
    return F.when(done > 0, F.round(elapsed / done * (total - done), 1))
