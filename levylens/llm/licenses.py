"""Operator 5: licence scan by canonical digests, in DataFrame functions only.

A text's canonical form is lower case, without lines that state a copyright, with equivalent
spellings made one, and with every run of other characters than letters and digits as one space. Its
SHA-256 is joined with the digests of known licences, taken through the same expressions. Whole texts
are looked up, and each line as a text of its own, for notices of one line. The known table is a
parameter; it is broadcast only below BROADCAST_ROWS rows.

Before digests are made, texts without any of MARKERS are set aside: every known text has one of them
in its canonical form, which is checked, so none of those can match.

Defined cases: a null or empty text has no licence; a row without doc_id takes no part; repeated rows
give a row each with the same finding; a document of only copyright lines has an empty canonical form,
which matches nothing; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices by SPDX name.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
]
#: Public licences' entire texts, a file each by SPDX name.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "texts")


def entire_texts(folder: str = TEXTS) -> list[tuple[str, str]]:
    """SPDX names and texts, each also as it is often given: without what follows its terms, with points in place of numbers, under its title, and with the reservation of rights."""
    out = []
    for file in sorted(os.listdir(folder)):
        with open(os.path.join(folder, file), encoding="utf-8") as f:
            name, text = file.removesuffix(".txt"), f.read()
        forms = [text, text.split("END OF TERMS AND CONDITIONS")[0], text.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS"]
        if name.startswith("BSD"):
            plain = re.sub(r"(?m)^\s*(\d\.|\*)\s", "", text)
            numbers = iter(range(1, 9))
            numbered = re.sub(r"(?m)^(\s*)(\d\.|\*)(\s)", lambda m: f"{m[1]}{next(numbers)}.{m[3]}", text)
            forms = [a + b + c for a in ("", f"BSD {name[4]}-Clause License\n", f"The BSD {name[4]}-Clause License\n") for b in ("", "All rights reserved.\n") for c in (plain, numbered)]
        out += [(name, x) for x in dict.fromkeys(forms)]
    return out


KNOWN += entire_texts()
#: Spellings that count as the same.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("https", "http"), ("acknowledgement", "acknowledgment")]
MARKERS = ("licen", "permission", "redistribution")
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;]*(copyright|\(c\)|©)[^\n]*"
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Java and DuckDB read these patterns alike; see canonical_sql()."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same for DuckDB."""
    out = f"' ' || regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', chr(10), 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out}, ' ')"


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = spark.createDataFrame(known or KNOWN, "license string, text string")
    form = canonical(F.col("text"))
    lacking = rows.where((form != "") & ~F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(form, m))).count()
    if lacking:
        raise ValueError(f"{lacking} known texts have none of {MARKERS}")
    return rows.where(form != "").select(F.sha2(form, 256).alias("digest"), "license").dropDuplicates(["digest"])


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license (of the whole text, or null), n_notices (lines that are known notices) and notices (their licences, in order, by commas)."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = lambda c: F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(F.lower(c), m))
    units = F.array_union(
        F.array(F.struct(F.lit(True).alias("whole"), F.lit(0).alias("at"), F.col("text").alias("unit"))),
        F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit(False).alias("whole"), i.alias("at"), x.alias("unit"))), lambda u: marked(u.unit)),
    )
    known_rows = known_digests(docs.sparkSession, known)
    if len(known or KNOWN) <= BROADCAST_ROWS:
        known_rows = F.broadcast(known_rows)
    found = (
        rows.where(marked(F.col("text"))).select("doc_id", F.xxhash64("text").alias("t"), F.explode(units).alias("u"))
        .select("doc_id", "t", "u.whole", "u.at", digest(F.col("u.unit")).alias("digest"))
        .join(known_rows, "digest").dropDuplicates(["doc_id", "t", "whole", "at"])
        .groupBy("doc_id", "t").agg(
            F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
            F.count(F.when(~F.col("whole"), 1)).alias("n_notices"),
            F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
        )
    )
    return rows.select("doc_id", F.xxhash64("text").alias("t")).join(found, ["doc_id", "t"], "left").select("doc_id", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT sha256({canonical_sql('t')}) AS digest, l AS license FROM (VALUES {values}) v(l, t)),
whole AS (SELECT doc_id, license FROM documents JOIN known ON digest = sha256({canonical_sql('text')}) WHERE {canonical_sql('text')} <> ''),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notices AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
            FROM lines JOIN known ON digest = sha256({canonical_sql('line')}) WHERE lower(line) LIKE '%licen%' OR lower(line) LIKE '%permission%' OR lower(line) LIKE '%redistribution%' GROUP BY doc_id)
SELECT d.doc_id, w.license, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM documents d LEFT JOIN whole w USING (doc_id) LEFT JOIN notices x USING (doc_id)"""
