"""Operator 8 [native]: line dedup by a segment-partition edit join.

Exact repeats: a line that has a word goes where an equal line comes earlier, whatever its length.

Near lines: lengths fall into classes that keep the top bits of a length, and a class has an edit limit k, which grows
with the length (LIMITS). In a class, k + 1 disjoint segments of one size lie at fixed places, the first ones counted
from the line's start, the last ones from its end. Of two lines within k edits, one has a segment i that the other holds
unharmed, with no more than i edits before it and no more than k - i after it; so a line is indexed under (class,
segment number, segment), and probes the substrings moved by up to min(i, k - i) places. A line within reach of the class
below its own takes part there as well. Keys under which one line alone stands, which is nearly all of them, go after one
shuffle. What meets under a key is pruned by letter counts: an edit changes the counts of whole lines by two at most, and
edits before a place and after it add up. Under crowded keys, where many near copies meet, the counts before and after
several places of the line must agree as well, and a pair is let out only at the first segment that it shares. What is
left is verified by a banded bit-parallel edit distance: 2 * k + 1 diagonals in one word.

A line is removed if an equal or near line comes earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Edit limits by the length of the shorter line: (length from which it holds, edits). Lines shorter than the first length
#: are near no other line. Lengths start a class: at most four leading bits, then zeros; edits fit the narrowest class.
LIMITS = ((32, 2), (512, 3))
#: Candidate line ids that are broadcast to filter the scan for their texts (8 bytes each); beyond it a join is used.
BROADCAST_IDS = 1_000_000
#: Common ends of up to 2**TRIM_BITS - 1 characters are cut off before verification.
TRIM_BITS = 17
#: A line on more than a share 1 / HOT of all places is joined by broadcast; there are fewer than HOT of them.
HOT = 1_000
#: Under keys of more lines than CROWD, pairs are pruned by counts at PLACES places of the line before they come out.
CROWD, PLACES = 32, 15
#: Lines of a crowded key that one task compares with all lines of the key.
BLOCK = 4_096
#: Characters whose counts (modulo 8) a pair of lines must nearly share, two words of 16 each.
COUNTED = ("etaoinsrhldcumfp", "gwybvkxjqz ,.éáó")
LOW, STORED = 32, 64
#: Characters that do not make a line a line with a word.
BLANK = " \t\x0b\x0c\r"


def _call(name: str, *cols) -> Column:
    return F.call_function(name, *cols)


def _floor(n: Column) -> Column:
    """The smallest length of a length's class: its four leading bits, then zeros."""
    low = F.greatest(F.char_length(F.bin(n)) - 4, F.lit(0))
    return _call("shiftleft", _call("shiftright", n, low), low)


def edit_limit(n: Column, limits: tuple = LIMITS) -> Column:
    """Edits allowed for pairs whose shorter line has n characters; -1 below the shortest length."""
    out = F
    for start, edits in reversed(limits):
        out = out.when(n >= start, F.lit(edits))
    return out.otherwise(F.lit(-1))


def _limit_sql(n: str, limits: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {start} THEN {edits}" for start, edits in reversed(limits)) + " ELSE -1 END"


def check_limits(limits: tuple) -> None:
    for start, edits in limits:
        width = 1 << max(0, start.bit_length() - 4)
        if start % width or not 0 <= edits <= width or edits + 1 > start:
            raise ValueError(f"{(start, edits)}: the length must start a class, and the edits must not exceed the class's width {width}")


def _moves(k: int, low: bool) -> str:
    """SQL for (low, segment number, move) of every substring that a line of a class with limit k looks up."""
    return f"array({', '.join(f'struct({low} AS low, {i} AS i, {s} AS move)' for i in range(k + 1) for s in range(-min(i, k - i), min(i, k - i) + 1))})"


def _segment_key(wide: Column, n: Column, c: Column, k: Column, i: Column, move: Column) -> Column:
    """The key of a line's substring at the place of segment i of class c (limit k), moved; wide has four bytes a character."""
    size = F.floor(c / (k + 1)).cast("int")
    start = F.when(2 * i <= k, i * size).otherwise(n - (k + 1 - i) * size) + move
    return F.xxhash64(c, i, F.substring(wide, 4 * start + 1, 4 * size))


def segment_keys(lines: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """key, id, at: for each line (columns id, line) the keys of its segments and of the substrings that it only probes.

    at: STORED if the key is that of a segment, plus LOW if it is one of the class below the line's, plus the segment's
    number.
    """
    x = lines.select("id", F.encode("line", "UTF-32").alias("wide"), F.char_length("line").alias("n")).where(F.col("n") >= limits[0][0])
    x = x.withColumn("f1", _floor(F.col("n"))).withColumn("f0", _floor(F.col("f1") - 1)).withColumn("k1", edit_limit(F.col("f1"), limits)).withColumn("k0", edit_limit(F.col("f0"), limits))
    every = sorted({k for _, k in limits})
    own, below = (F.expr("CASE " + " ".join(f"WHEN {name} = {k} THEN {_moves(k, low)}" for k in every) + " END") for name, low in (("k1", False), ("k0", True)))
    reach = F.col("n") - F.col("f1") + 1 <= F.col("k0")  # the longest line of the class below is that near in length
    moves = F.when(reach, F.concat(own, below)).otherwise(own)
    x = x.select("id", "wide", "n", "f1", "f0", "k1", "k0", F.explode(moves).alias("m"))
    low = F.col("m.low")
    x = x.select("id", "wide", "n", F.when(low, F.col("f0")).otherwise(F.col("f1")).alias("c"), F.when(low, F.col("k0")).otherwise(F.col("k1")).alias("k"), F.col("m.i").alias("i"), F.col("m.move").alias("move"), low.alias("low"))
    at = F.col("i") + F.when(F.col("low"), F.lit(LOW)).otherwise(0) + F.when(F.col("move") == 0, F.lit(STORED)).otherwise(0)
    return x.select(_segment_key(F.col("wide"), F.col("n"), F.col("c"), F.col("k"), F.col("i"), F.col("move")).alias("key"), "id", at.alias("at"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two strings by code points if it is k or less, else a number above k; k up to 30.

    The vertical differences of the 2k + 1 diagonals around the main one are the bits of two words; a column of the
    table is a dozen word operations. The value is followed down the lowest diagonal, then along the last row.
    """
    ones, top = (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    m, n = F.char_length(a), F.char_length(b)
    pad = F.unhex(F.lit("FFFFFFFF" * k))
    wide_a, wide_b = F.concat(pad, F.encode(a, "UTF-32"), pad), F.encode(b, "UTF-32")

    def column(s: Column, j: Column) -> Column:
        at = F.substring(wide_b, 4 * j - 3, F.lit(4))
        eq = sum(((F.substring(wide_a, 4 * (j + t) - 3, F.lit(4)) == at).cast("long") * (1 << t) for t in range(2 * k + 1)), F.lit(0).cast("long"))
        vp, vn = s["vp"], s["vn"]

        def with_d0(d: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d["d0"].bitwiseOR(vp))).bitwiseAND(F.lit(ones).cast("long"))
            return _let(F.struct(d["d0"].alias("d0"), hp.alias("hp"), d["d0"].bitwiseAND(vp).alias("hn")), finish)

        def finish(d: Column) -> Column:
            down = F.shiftright(d["d0"], 1)
            row = F.lit(2 * k) - F.greatest(F.lit(0), j + k - m)  # bit of the last row once the lowest diagonal has met it
            bit = lambda word: F.call_function("shiftright", word, row.cast("int")).bitwiseAND(F.lit(1).cast("long"))
            step = F.when(j + k <= m, (d["d0"].bitwiseAND(F.lit(top).cast("long")) == 0).cast("long")).otherwise(bit(d["hp"]) - bit(d["hn"]))
            return F.struct(
                d["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(d["hp"]))).bitwiseAND(F.lit(ones).cast("long")).alias("vp"),
                down.bitwiseAND(d["hp"]).alias("vn"),
                (s["dist"] + step).alias("dist"),
            )

        sum_bits = lambda x: (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(ones).cast("long"))
        return _let(eq, lambda x: _let(F.struct(sum_bits(x).alias("d0")), with_d0))

    # column 0: rows 1 to k + 1 go up by one each
    start = F.struct(F.lit(ones - ((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).cast("long").alias("dist"))
    far = F.abs(m - n) > k
    longest, shortest = F.greatest(m, n).cast("long"), F.least(m, n)
    # where the band is wider than a string the lowest diagonal starts below its last row
    small = shortest <= k
    run = F.aggregate(F.sequence(F.lit(1), n), start, column)["dist"]
    return F.when(far, longest + k).when(small, F.levenshtein(a, b).cast("long")).otherwise(run)


def _common_prefix(x: Column, y: Column) -> Column:
    """Number of leading characters that two strings share, up to 2**TRIM_BITS - 1, by binary search."""
    longest = F.least(F.char_length(x), F.char_length(y))
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(TRIM_BITS))])
    return F.aggregate(steps, F.lit(0), lambda p, step: F.when((p + step <= longest) & (F.left(x, p + step) == F.left(y, p + step)), p + step).otherwise(p))


def trimmed(pairs: DataFrame, max_edits: int, limit: Column | None = None) -> DataFrame:
    """pairs (_x, _y) without their common ends, less those that cannot be within max_edits edits, or a row's own limit.

    Trimming keeps the distance. Edits in the front half and in the back half add up, so their letter counts tell. Where both rests are longer than max_edits, an edit stands at either end; the inside of
    one, cut into max_edits - 1 parts, has at most max_edits - 2 edits, so one part is in the other as it is.
    """
    cols = [c for c in pairs.columns if c not in ("_x", "_y")]
    rest = lambda t, n: F.reverse(F.substring(t, n + 1, F.char_length(t)))

    def ends(p: Column) -> Column:
        return _let(F.struct(rest(F.col("_x"), p).alias("x"), rest(F.col("_y"), p).alias("y")), lambda r: _let(_common_prefix(r["x"], r["y"]), lambda s: F.struct(rest(r["x"], s).alias("_x"), rest(r["y"], s).alias("_y"), F.greatest(p, s).alias("_cut"))))

    # the generator keeps the filter below from copying these expressions
    x = pairs.select(*cols, F.explode(F.array(_let(_common_prefix(F.col("_x"), F.col("_y")), ends))).alias("_t")).select(*cols, "_t.*")
    m, n = F.char_length("_x"), F.char_length("_y")
    short = F.least(m, n) <= max_edits
    if max_edits < 2:
        possible = F.greatest(m, n) <= 1
    else:
        size = F.floor((m - 2) / (max_edits - 1)).cast("int")
        possible = F.lit(False)
        for i in range(max_edits - 1):
            # an edit stands before the part and another after it, so it moves by max_edits - 1 places at most
            start = F.lit(2) + size * i
            window = F.greatest(start - (max_edits - 1), F.lit(1))
            possible = possible | F.contains(F.substring(F.col("_y"), window, start - window + size + max_edits - 1), F.substring(F.col("_x"), start, size))
    whole = F.col("_cut") < (1 << TRIM_BITS) - 1  # else the ends may not be cut off in full
    limit = F.lit(max_edits) if limit is None else limit
    half = F.floor(F.least(m, n) / 2).cast("int")
    x = x.where((F.greatest(m, n) - F.least(m, n) <= limit) & (short | ~whole | possible))
    ends = F.struct(*[letter_counts(part(line, half)).alias(name + line) for name, part in (("l", F.left), ("r", F.right)) for line in ("_x", "_y")])
    x = x.withColumn("_ends", F.explode(F.array(ends)))
    return x.where(short | ~whole | (F.expr(_apart("_ends.l_x", "_ends.l_y") + " + " + _apart("_ends.r_x", "_ends.r_y")) <= 2 * limit)).select(*cols, "_x", "_y")

def letter_counts(line: Column) -> Column:
    """Two longs: for each of COUNTED how often it occurs in the lower-cased line, modulo 8, as a circular unary code.

    The codes of two counts differ in as many bits as the counts differ around the circle, so an edit changes two bits at
    most. Lines of other scripts have like codes, and are left to the verification.
    """
    words = [", ".join(f"struct('{c}' AS c, {len(c.encode())} AS n, {4 * i} AS at)" for i, c in enumerate(chars)) for chars in COUNTED]
    sets = F.expr("array(" + ", ".join(f"array({w})" for w in words) + ")")
    code = F.expr("array(0L, 1L, 3L, 7L, 15L, 14L, 12L, 8L)")

    def word(letters: Column, low: Column) -> Column:
        times = lambda x: F.floor((F.octet_length(low) - F.octet_length(F.replace(low, x["c"], F.lit("")))) / x["n"])
        return F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(_call("shiftleft", F.element_at(code, (times(x) % 8 + 1).cast("int")), x["at"])))

    return _let(F.lower(line), lambda low: F.transform(sets, lambda letters: word(letters, low)))


def _apart(a: str, b: str, at: int = 0) -> str:
    """SQL for the bits that differ between two letter counts, which begin at an item of their arrays."""
    return "(" + " + ".join(f"bit_count({a}[{at + i}] ^ {b}[{at + i}])" for i in range(len(COUNTED))) + ")"


def _profile(line: Column, c: Column) -> Column:
    """Letter counts before each of PLACES places of a line of class c, and as far from the end as the place leaves of c.

    The two parts are disjoint in every line of the class, so their edits add up.
    """
    def parts(t: Column) -> Column:
        place = F.floor(c * t / (PLACES + 1)).cast("int")
        return F.concat(letter_counts(F.left(line, place)), letter_counts(F.right(line, c - place)))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PLACES)), parts))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, line, h, h2: every line that has a word; th hashes the document's text, h and h2 the line."""
    x = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return x.where(F.btrim("line", F.lit(BLANK)) != "").select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def _place() -> Column:
    """Where a line stands; documents are in order of doc_id (null first), then of th."""
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("th").alias("t"), F.col("pos").alias("p"))


def near_line_links(docs: DataFrame, limits: tuple = LIMITS, often: DataFrame | None = None) -> DataFrame:
    """a, a2, b, b2, distance: pairs of distinct lines, named by their two hashes, within the edit limit of the shorter.

    A table without near lines gives no pair. docs: doc_id, text. often: (h, h2) of lines on so many places that their copies must not meet under one key; they
    are few and broadcast.
    """
    check_limits(limits)
    most = max(k for _, k in limits)
    lines = _lines(docs).where(F.char_length("line") >= limits[0][0]).select("line", "h", "h2")
    once = lines
    if often is not None and not often.isEmpty():
        one = lines.join(F.broadcast(often), ["h", "h2"], "left_semi").groupBy("h", "h2").agg(F.first("line").alias("line"))  # copies collapse before the shuffle
        once = lines.join(F.broadcast(often), ["h", "h2"], "left_anti").unionByName(one.select("line", "h", "h2"))
    # one shuffle by key serves both the search for shared keys and the selection of their rows
    rows = segment_keys(once.select(F.col("h").alias("id"), "line"), limits).repartition("key")
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("at").alias("at")).where(f"low <> high and at >= {STORED}").select("key")
    members = materialize(rows.join(shared.hint("shuffle_hash"), "key").groupBy("key", "id").agg(F.max("at").alias("at")))
    ids = members.select(F.col("id").alias("h")).distinct()
    few = members.count() <= BROADCAST_IDS
    texts = lines.join(F.broadcast(ids) if few else ids, "h", "left_semi").groupBy("h", "h2").agg(F.first("line").alias("line"))
    texts = materialize(texts.select(F.col("h").alias("id"), "h2", "line", F.char_length("line").alias("n"), letter_counts(F.col("line")).alias("s")))

    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    known = materialize(members.join(sizes, "key").join(texts.drop("line"), "id"))
    pairs = materialize(_few_met(known.where(F.col("size") <= CROWD), limits).union(_crowds_met(known.where(F.col("size") > CROWD), texts, limits)).distinct())
    x = texts.select(F.col("id").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("_x"))
    y = texts.select(F.col("id").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("_y"))
    tried = trimmed(pairs.join(x, ["a", "a2"]).join(y, ["b", "b2"]), most, F.col("k"))
    return tried.withColumn("distance", banded_distance(F.col("_x"), F.col("_y"), most)).where(F.col("distance") <= F.col("k")).select("a", "a2", "b", "b2", "distance")


def _sides(known: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The rows as x and as y: key, then all else as one struct."""
    row = F.struct("id", "h2", "n", "s", "at", *[c for c in more if c != "block"])
    keys = ["key", *[c for c in more if c == "block"]]
    return known.select(*keys, row.alias("x")), known.select(*keys, row.alias("y"))


def _possible(limits: tuple) -> tuple[Column, Column]:
    """(edit limit of a pair of rows x and y, whether the pair must be looked at), by lengths and letter counts."""
    x, y = F.col("x"), F.col("y")
    k = edit_limit(F.least(x["n"], y["n"]), limits)
    ordered = (x["id"] < y["id"]) | ((x["id"] == y["id"]) & (x["h2"] < y["h2"]))
    return k, ordered & ((x["at"] >= STORED) | (y["at"] >= STORED)) & (F.abs(x["n"] - y["n"]) <= k) & (F.expr(_apart("x.s", "y.s")) <= 2 * k)


def _pairs(met: DataFrame, k: Column) -> DataFrame:
    return met.select(F.col("x.id").alias("a"), F.col("x.h2").alias("a2"), F.col("y.id").alias("b"), F.col("y.h2").alias("b2"), k.alias("k"))


def _few_met(known: DataFrame, limits: tuple) -> DataFrame:
    """a, a2, b, b2, k: pairs that meet under keys of CROWD lines at most."""
    left, right = _sides(known)
    k, possible = _possible(limits)
    return _pairs(left.join(right, (left["key"] == right["key"]) & possible), k)


def _crowds_met(known: DataFrame, texts: DataFrame, limits: tuple) -> DataFrame:
    """a, a2, b, b2, k: pairs that meet under crowded keys, block by block, so that a key's work is spread."""
    f1 = _floor(F.col("n"))
    low = (F.col("at") % STORED) >= LOW
    known = known.withColumn("c", F.when(low, _floor(f1 - 1)).otherwise(f1))
    marked = known.select("id", "h2", "c").distinct().join(texts.select("id", "h2", "line", "n"), ["id", "h2"])
    k, wide = edit_limit(F.col("c"), limits), F.encode("line", "UTF-32")
    segments = _let(wide, lambda w: F.transform(F.sequence(F.lit(0), k), lambda i: _segment_key(w, F.col("n"), F.col("c"), k, i, F.lit(0))))
    marked = materialize(marked.select("id", "h2", "c", segments.alias("segments"), _profile(F.col("line"), F.col("c")).alias("profile")))
    known = known.join(marked, ["id", "h2", "c"])
    blocks = F.floor(F.col("size") / BLOCK).cast("int")
    left, _ = _sides(known.withColumn("block", F.pmod("id", blocks + 1).cast("int")), "block", "segments", "profile")
    _, right = _sides(known.withColumn("block", F.explode(F.sequence(F.lit(0), blocks))), "block", "segments", "profile")
    k, possible = _possible(limits)
    # a pair that shares segments comes out at the first of them alone, not where one line only probes the other; the
    # higher-order functions keep the generated code of the cheap tests small
    x, y, width = F.col("x"), F.col("y"), len(COUNTED)
    upto = F.when((x["at"] >= STORED) & (y["at"] >= STORED), x["at"] % LOW).otherwise(F.size(x["segments"]))
    first = F.forall(F.zip_with(F.slice(x["segments"], F.lit(1), upto), F.slice(y["segments"], F.lit(1), upto), lambda a, b: a != b), lambda differ: differ)
    at = [f"bit_count(x.profile[{2 * width} * t + {i}] ^ y.profile[{2 * width} * t + {i}])" for i in range(2 * width)]
    near = F.expr(f"forall(sequence(0, {PLACES - 1}), t -> {' + '.join(at)} <= 2 * {{k}})".replace("{k}", _limit_sql("least(x.n, y.n)", limits)))
    return _pairs(left.join(right, (left["key"] == right["key"]) & (left["block"] == right["block"]) & possible & first & near), k)


def duplicate_lines(docs: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """doc_id, th, removed, n_links: for each document with such lines, the 0-based numbers of lines to remove.

    A line with a word is removed if an equal line, or one within the edit limit, stands earlier. n_links sums, over the
    document's lines, the number of distinct lines near each. Rows equal in doc_id and text are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    places = materialize(_lines(docs).drop("line"))
    repeated = materialize(places.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    often = materialize(repeated.where(F.col("n") * HOT > places.count()).select("h", "h2"))  # fewer than HOT rows
    links = materialize(near_line_links(docs, limits, often))
    both = links.select(F.col("a").alias("h"), F.col("a2").alias("h2"), F.col("b").alias("o"), F.col("b2").alias("o2")).union(links.select("b", "b2", "a", "a2"))
    marked = repeated.select("h", "h2").join(both.groupBy("h", "h2").agg(F.count("*").alias("links")), ["h", "h2"], "full").select("h", "h2", F.coalesce("links", F.lit(0)).alias("links"))

    def beside(rows: DataFrame, marks: DataFrame) -> DataFrame:
        """Rows of places with the marks of their lines; lines on very many places meet their marks by broadcast."""
        hot = marks.join(F.broadcast(often), ["h", "h2"], "left_semi")
        return rows.join(F.broadcast(hot), ["h", "h2"]).unionByName(rows.join(F.broadcast(often), ["h", "h2"], "left_anti").join(marks, ["h", "h2"]))

    seen = materialize(beside(places, marked))
    first = seen.groupBy("h", "h2").agg(F.min(_place()).alias("first"))
    near = both.join(first.select(F.col("h").alias("o"), F.col("h2").alias("o2"), "first"), ["o", "o2"]).groupBy("h", "h2").agg(F.min("first").alias("near_first"))
    earliest = materialize(first.join(near, ["h", "h2"], "left").select("h", "h2", F.least("first", "near_first").alias("earliest")))
    judged = beside(seen, earliest).select("doc_id", "th", F.struct("pos", "links", (F.col("earliest") < _place()).alias("late")).alias("x")).where("x.late or x.links > 0")
    found = judged.groupBy("doc_id", "th").agg(F.collect_set("x").alias("x"))  # a set: equal rows count once
    removed = F.transform(F.filter("x", lambda x: x["late"]), lambda x: x["pos"])
    return found.select("doc_id", "th", removed.alias("removed"), F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["links"]).alias("n_links"))


def dedup_lines(docs: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """docs with the later of equal or near lines taken out of text; all columns stay, n_chars is counted anew if present.

    Lines are what newlines part, compared as they are. Lines without a word stay; lines below the first length of limits
    go only where they repeat exactly. Null texts stay null and texts without such lines stay as they are; a document
    whose lines all go keeps an empty text. Documents are ordered by doc_id, null first; rows equal in doc_id and text
    are one document, so neither loses lines to the other. An empty table gives an empty result.
    """
    gone = duplicate_lines(docs, limits).where(F.size("removed") > 0)
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "removed")
    # the row travels as one struct, so no column of docs can clash with those used here
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_h"))
    x = x.join(gone, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    kept = F.filter(F.split("_row.text", "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    row = F.col("_row").withField("text", F.when(F.col("removed").isNull(), F.col("_row.text").cast("string")).otherwise(F.array_join(kept, "\n")))
    x = x.select(row.alias("_row"))
    if "n_chars" in docs.columns:
        x = x.select(F.col("_row").withField("n_chars", F.char_length("_row.text").cast("long")).alias("_row"))
    return x.select("_row.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, removed_lines (1-based, ascending, joined by commas) for every row of documents.

    Null texts are one empty line. Rows equal in doc_id and text are one document and give equal rows; null doc_ids come
    first in the order of documents. An empty table gives an empty result; other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    gone = duplicate_lines(docs).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "removed", "n_links")
    x = every.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    listed = F.array_join(F.transform(F.array_sort(removed), lambda p: (p + 1).cast("string")), ",")
    return x.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), listed.alias("removed_lines"))


# Letters beyond ASCII of the tables' languages. DuckDB's levenshtein counts bytes, so each becomes one byte.
ACCENTED = "äçèéêíñóößüÄÇÈÉÊÍÑÓÖÜ"
_ONE_BYTE = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)])
_LIMIT = "CASE WHEN {0} >= 512 THEN 3 ELSE 2 END"

OP8_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, u.pos - 1 AS pos, u.line AS line, {{'d': coalesce(doc_id, -9223372036854775808), 'p': u.pos}} AS place
  FROM (SELECT doc_id, text, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'line': x, 'pos': i}})) AS u FROM d) WHERE regexp_matches(u.line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, length(line) AS n, min(place) AS first FROM l GROUP BY line),
o AS (SELECT line, n, translate(line, '{ACCENTED}', {_ONE_BYTE}) AS plain, {_LIMIT.format("n")} AS k FROM f WHERE n >= 32),
k AS (SELECT a.line AS x, b.line AS y FROM o a JOIN o b ON b.n BETWEEN a.n AND a.n + 3 AND b.n - a.n <= a.k AND (a.n < b.n OR a.line < b.line)
  WHERE CASE WHEN list_bool_or(list_transform(range(a.k + 1), lambda i: contains(b.plain, substr(a.plain, 1 + i * (a.n // (a.k + 1)), a.n // (a.k + 1))))) THEN levenshtein(a.plain, b.plain) <= a.k ELSE false END),
b AS (SELECT x AS line, y AS other FROM k UNION ALL SELECT y, x FROM k),
m AS (SELECT b.line, min(f.first) AS near, count(*) AS links FROM b JOIN f ON b.other = f.line GROUP BY b.line),
j AS (SELECT l.doc_id, l.text, l.pos, coalesce(m.links, 0) AS links, least(f.first, coalesce(m.near, f.first)) < l.place AS gone FROM l JOIN f USING (line) LEFT JOIN m USING (line)),
g AS (SELECT doc_id, text, count(*) FILTER (gone) AS n_removed, sum(links) AS n_links, string_agg(CAST(pos + 1 AS VARCHAR), ',' ORDER BY pos) FILTER (gone) AS removed_lines FROM j GROUP BY doc_id, text)
SELECT e.doc_id, CAST(len(string_split(coalesce(e.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links, coalesce(g.removed_lines, '') AS removed_lines
FROM documents e LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM e.doc_id AND g.text = coalesce(e.text, '')
"""
