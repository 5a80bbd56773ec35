"""Operator 4: license scans by canonical digest lookup.

A text is lower-cased, copyright lines and lines that name the license by its identifier go, all but letters and digits becomes single spaces, and equivalent spellings
become one; its SHA-256 is joined with the digests of known license texts. Entire texts are matched: the whole document
against license texts, and each line as a text of its own against the notices by which licenses are invoked. How a text
is wrapped, indented, decorated or capitalised makes no difference.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Spellings that count as equal, in the order of replacement (both sides lower case, in words parted by spaces).
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("judgement", "judgment"), ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("per cent", "percent"), ("centre", "center"), ("programme", "program"), ("copyright owner", "copyright holder"), (" http ", " https ")]
# Words with which running text of licenses goes on after "copyright" at the beginning of a line.
RUNNING = ["act", "and", "applicable", "as", "at", "attribution", "disclaimer", "for", "from", "holder", "if", "in", "infringement", "interest", "is", "law", "license", "licensor", "line", "notice", "of", "on", "or", "owner", "page", "permission", "protection", "statement", "status", "that", "to", "treaties", "treaty", "under", "which", "with"]
#: A line of running text that happens to begin with "copyright": the word is put aside as MASK before copyright lines go.
RUNNING_LINE = rf"^([^a-z0-9\n]*)copyright([ \t]+(?:{'|'.join(RUNNING)})s?(?:[^a-z]|$))"
MASK = "\ue000"
#: Lines that name a copyright, with or without a year, mark or name of a part, and lines right below that go on with a year.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(?:(?:portions|parts)[^a-z0-9\n]+)?(?:copyright(?:[^a-z\n\x22\x27”»]|$)|\(c\)[^a-z0-9\n]*(?:copyright|[0-9<\[{])|©|all rights reserved)[^\n]*(?:\n[^a-z0-9\n]*[ \t](?:19|20)[0-9][0-9][^0-9\n][^\n]*)*"
#: The line that names a license by its identifier; it is a notice, and no part of a license's text.
SPDX_LINE = r"^ *spdx license identifier [^\n]*"
_PARTING = r"[^\p{L}\p{M}\p{N}\n]+"

# Texts of short licenses.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, "The MIT License\n\n" + _MIT],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL, "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."],
}
# One-line notices.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0.", "Released under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0."],
}
for _name in ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-3.0-only", "MIT", "MPL-2.0", "Zlib", "0BSD"]:
    NOTICES.setdefault(_name.removesuffix("-only").removesuffix("-or-later"), []).append(f"SPDX-License-Identifier: {_name}")
# Lengths and digests of the canonical forms of the long licenses' published texts.
DIGESTS = {
    "Apache-2.0": (9889, "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    "Artistic-1.0-Perl": (5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    "CC0-1.0": (6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    "GFDL-1.2": (19579, "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    "GFDL-1.3": (22015, "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    "GPL-1.0": (11763, "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    "GPL-2.0": (17115, "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    "GPL-3.0": (33407, "df71f3c423c11bc52456a9775329f1d9a3168a6f071654750b9eb155fb3ec0eb"),
    "LGPL-2.0": (24128, "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    "LGPL-2.1": (25215, "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    "LGPL-3.0": (7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    "MPL-1.1": (22448, "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    "MPL-2.0": (14343, "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
}


def canonical_text(text: str) -> str:
    """What canonical() makes of a text in Spark."""
    import regex

    text = re.sub("(?m)" + RUNNING_LINE, rf"\1{MASK}\2", text.lower().replace(MASK, " "))
    text = re.sub("(?m)" + COPYRIGHT_LINE, "", text).replace(MASK, "copyright")
    text = regex.sub(_PARTING, " ", text)
    whole = re.sub("(?m)" + SPDX_LINE, "", text) if "\n" in text.strip() else text
    text = f" {' '.join(whole.replace(chr(10), ' ').split(' '))} "
    text = re.sub(" +", " ", text)
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return text.strip(" ")


def canonical_digest(text: str) -> str:
    """The digest by which a text is looked up."""
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def _folded(text: Column) -> Column:
    """Lower case, no copyright lines, words parted by spaces and newlines."""
    text = F.regexp_replace(F.replace(F.lower(text), F.lit(MASK), F.lit(" ")), "(?dm)" + RUNNING_LINE, f"$1{MASK}$2")
    text = F.replace(F.regexp_replace(text, "(?dm)" + COPYRIGHT_LINE, ""), F.lit(MASK), F.lit("copyright"))
    return F.regexp_replace(text, _PARTING, " ")


def _spelled(folded: Column) -> Column:
    """One spelling for each word; texts without other spellings, which are most, are only searched once."""
    text = F.concat(F.lit(" "), folded, F.lit(" "))
    one = text
    for a, b in SPELLINGS:
        one = F.replace(one, F.lit(a), F.lit(b))
    return F.trim(F.when(text.rlike("|".join(a for a, _ in SPELLINGS)), one).otherwise(text))


def canonical(text: Column) -> Column:
    return _spelled(_joined(_folded(text)))


def _joined(folded: Column) -> Column:
    """The lines of a folded text as one, without one that only names the license."""
    return F.regexp_replace(F.when(F.trim(folded, F.lit(" \n")).contains("\n"), F.regexp_replace(folded, "(?dm)" + SPDX_LINE, "")).otherwise(folded), "[ \\n]+", " ")


def known() -> list[tuple[str, str, str, int]]:
    """(digest, license, kind, length of the canonical form) for every known text; kind is text or notice."""
    rows = {(canonical_digest(t), name, kind, len(canonical_text(t))) for kind, texts in (("text", TEXTS), ("notice", NOTICES)) for name, ts in texts.items() for t in ts}
    return sorted(rows | {(d, name, "text", n) for name, (n, d) in DIGESTS.items()})


def scan(docs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """doc_id, license, n_notices, notices: one row per document.

    license: the license whose known text the entire document is, else null. n_notices: lines that are a known notice;
    notices: their distinct licenses in order, joined by commas. Null texts are empty. Repeated rows give repeated rows;
    null doc_ids stay; other columns are ignored; an empty table gives an empty result. extra: more known texts
    (digest, license, kind), joined by shuffle unless Spark sees that they are small.

    Without extra the lengths of all known canonical forms are known, and only forms of such a length are digested.
    """
    spark = docs.sparkSession
    rows = known()
    table_ = spark.createDataFrame([r[:3] for r in rows], "digest string, license string, kind string")
    table_ = F.broadcast(table_) if extra is None else table_.unionByName(extra.select("digest", "license", "kind")).dropDuplicates(["digest", "kind"])
    texts = table_.where("kind = 'text'").select("digest", "license")
    notices = table_.where("kind = 'notice'").select(F.col("digest").alias("_nd"), F.col("license").alias("_nl"))

    def digest(canon: Column, kind: str) -> Column:
        if extra is not None:
            return F.sha2(canon, 256)
        return F.when(F.char_length(canon).isin(sorted({n for _, _, k, n in rows if k == kind})), F.sha2(canon, 256))

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(_folded(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("_folded"))  # the generator keeps the form from being made twice
    x = x.select("doc_id", "_folded", F.explode(F.array(_spelled(_joined(F.col("_folded"))))).alias("_canon"))
    lines = F.transform(F.split("_folded", "\n", -1), lambda l: F.element_at(F.transform(F.array(_spelled(F.trim(l))), lambda c: digest(c, "notice")), 1))
    x = x.select("doc_id", digest(F.col("_canon"), "text").alias("digest"), lines.alias("_lines"))
    if extra is None:
        # few known notices: a map from digest to license, looked up in place
        lookup = F.create_map(*[F.lit(v) for d, name, kind, _ in rows if kind == "notice" for v in (d, name)])
        found = F.filter(F.transform("_lines", lambda d: F.try_element_at(lookup, d)), lambda n: n.isNotNull())
        x = x.withColumn("_found", found)
    else:
        x = x.withColumn("_row", F.monotonically_increasing_id())
        hits = x.select("_row", F.explode("_lines").alias("_nd")).join(notices, "_nd").groupBy("_row").agg(F.collect_list("_nl").alias("_found"))
        x = x.join(hits, "_row", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    x = x.join(texts, "digest", "left")
    return x.select("doc_id", "license", F.size("_found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"))


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, n_notices, notices for every row of documents; nulls and repeats as in scan()."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_spelled(x: str) -> str:
    x = f"' ' || {x} || ' '"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim({x}, ' ')"


def _sql() -> str:
    values = ", ".join(f"('{d}', '{name}', '{kind}')" for d, name, kind, _ in known())
    masked = rf"regexp_replace(replace(lower(coalesce(text, '')), '{MASK}', ' '), '(?m){RUNNING_LINE}', '\1{MASK}\2', 'g')"
    folded = rf"regexp_replace(replace(regexp_replace({masked}, '(?m){COPYRIGHT_LINE}', '', 'g'), '{MASK}', 'copyright'), '{_PARTING}', ' ', 'g')"
    whole = _sql_spelled(rf"regexp_replace(CASE WHEN contains(trim(d.folded, ' ' || chr(10)), chr(10)) THEN regexp_replace(d.folded, '(?m){SPDX_LINE}', '', 'g') ELSE d.folded END, '[ \n]+', ' ', 'g')")
    return f"""
WITH k(digest, license, kind) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, {folded} AS folded FROM documents),
l AS (SELECT r, unnest(string_split(folded, chr(10))) AS line FROM d),
n AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k ON kind = 'notice' AND digest = sha256({_sql_spelled("trim(line, ' ')")}) GROUP BY r)
SELECT d.doc_id, k.license, CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN k ON k.kind = 'text' AND k.digest = sha256({whole}) LEFT JOIN n ON n.r = d.r
"""


OP4_SQL = _sql()
