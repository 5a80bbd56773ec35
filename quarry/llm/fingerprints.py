"""Operator 7 [native]: canonical exact digests of whole documents.

A text is put into NFKC, case-folded, put into NFKC again and its runs of white space become one space; the ICU classes
that Spark ships do this inside the JVM. The digest is 128 bits of xxhash under two seeds. Rows of equal digest are
compared byte by byte: their distinct canonical texts are gathered (copies collapse map-side, so a group of copies of any
size stays small), and where a digest has more than one, each gets its own ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Documents of one range of doc_ids, on average, and most ranges.
RANGE_ROWS, MOST_RANGES = 1_000, 10_000


def _icu(cls: str, method: str, text: Column, flag: bool) -> Column:
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """Canonical form of a text column; null is empty. Texts that only ASCII makes up skip the ICU calls."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    nfkc = lambda t: _icu("text.Normalizer", "compose", t, True)
    folded = nfkc(_icu("lang.UCharacter", "foldCase", nfkc(text), True))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits: xxhash64 under two seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0")))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add `out`: equal exactly for rows of equal canonical text. Null texts count as empty; all columns stay.

    Byte comparison: the distinct canonical texts of each digest, gathered with map-side combining; a digest with
    several gets ordinals in their byte order.
    """
    df = df.withColumn("_canon", canonical(F.col(text))).withColumn("_digest", digest(F.col("_canon")))
    return _separate(df, df.select("_digest", "_canon"), [("_digest", "_canon", out)]).drop("_canon", "_digest")


def _separate(df: DataFrame, seen: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """For each (digest, canonical text, out): out = digest, with an ordinal where `seen` has unequal bytes under it."""
    sets = seen.groupBy("_digest").agg(F.collect_set("_canon").alias("_texts")).where(F.size("_texts") > 1)
    clash = sets.select(F.col("_digest").alias("_d"), F.posexplode(F.array_sort("_texts")).alias("_n", "_c"))
    for key, canon, out in columns:
        side = clash.select(F.col("_d").alias("_d_"), F.col("_c").alias("_c_"), F.col("_n").alias("_n_"))
        df = df.join(side, (F.col(key) == F.col("_d_")) & (F.col(canon) == F.col("_c_")), "left")
        df = df.withColumn(out, F.when(F.coalesce("_n_", F.lit(0)) > 0, F.concat(key, F.lit("-"), F.col("_n_").cast("string"))).otherwise(F.col(key))).drop("_d_", "_c_", "_n_")
    return df


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by (doc_id nulls first, text), after the last the first.

    Documents are dealt to ranges of doc_ids that begin at values of the table; the rows at a beginning also go to the
    range before as its end, so one shuffle suffices and no task holds more than one range at a time. Equal doc_ids are
    ordered by text. Extra columns are ignored.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    want = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    at = [k / want for k in range(1, want)]
    low, cuts = docs.agg(F.min("_id"), F.percentile_approx("_id", at or [0.5], 100_000)).first()  # at most MOST_RANGES numbers
    starts = sorted({low, *(cuts if at else [])}) if n else [0]
    coarse = max(1, int(len(starts) ** 0.5))
    groups = [starts[i : i + coarse] for i in range(0, len(starts), coarse)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("_id")))
    first = below(F.lit([g[0] for g in groups])) - 1
    if len(groups) == 1:
        rank = below(F.lit(groups[0])) - 1
    else:
        rank = first * coarse + below(F.element_at(F.array(*[F.lit(g) for g in groups]), (first + 1).cast("int"))) - 1
    docs = docs.withColumn("_range", rank.cast("int"))
    begins = F.array_contains(F.lit(starts), F.col("_id")) if len(starts) < 64 else F.array_contains(F.element_at(F.array(*[F.lit(g) for g in groups]), (first + 1).cast("int")), F.col("_id"))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("end"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(starts))).cast("int").alias("r"), F.lit(1).alias("end"))
    dealt = docs.withColumn("_to", F.explode(F.when(begins, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "_id", "text", F.col("_to.r").alias("_r"), F.col("_to.end").alias("_end"))
    follow = Window.partitionBy("_r").orderBy("_end", "_id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(follow)).where("_end = 0").select("doc_id", "text", "next_text")


def op7_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text; likeness is 1.0 for equal fingerprints, else 0.0.

    One row for every row of documents. Null texts are empty; null doc_ids come first, equal ones are ordered by text, and
    repeated rows follow one another. A table of one row follows itself; an empty one gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    x = with_next(docs)
    n = F.char_length("text")
    move = F.floor(n / 4).cast("int")
    x = x.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.left("text", n - move), F.left("next_text", move)))
    x = x.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("_canon"), canonical(F.col("_edited")).alias("_edited_canon"), canonical(F.col("next_text")).alias("_next_canon"))
    # edited texts meet only their own original and are compared with it here, byte by byte
    x = x.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("_canon")).alias("_digest"), digest(F.col("_edited_canon")).alias("_edited_digest"), F.xxhash64(F.lit("third"), "_canon").alias("_check"), F.xxhash64(F.lit("third"), "_edited_canon").alias("_edited_check"),
        (F.col("_canon") == F.col("_edited_canon")).cast("double").alias("near_edited"), (F.col("_canon") == F.col("_next_canon")).cast("double").alias("near_next"),
    )
    texts = docs.select(canonical(F.col("text")).alias("_canon"))
    seen = texts.select(digest(F.col("_canon")).alias("_digest"), "_canon")
    sets = seen.groupBy("_digest").agg(F.collect_set("_canon").alias("_texts")).where(F.size("_texts") > 1)
    clash = sets.select("_digest", F.posexplode(F.array_sort("_texts")).alias("_n", "_c")).select(F.col("_digest").alias("_d"), F.xxhash64(F.lit("third"), "_c").alias("_k"), "_n")
    for key, check, out in (("_digest", "_check", "fingerprint"), ("_edited_digest", "_edited_check", "edited_fingerprint")):
        side = clash.select(F.col("_d").alias("_d_"), F.col("_k").alias("_k_"), F.col("_n").alias("_n_"))
        x = x.join(side, (F.col(key) == F.col("_d_")) & (F.col(check) == F.col("_k_")), "left")
        x = x.withColumn(out, F.when(F.coalesce("_n_", F.lit(0)) > 0, F.concat(key, F.lit("-"), F.col("_n_").cast("string"))).otherwise(F.col(key))).drop("_d_", "_k_", "_n_")
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
