"""Op 10, license scans: canonical digest lookup.

A text's canonical form is its lines in lower case, runs of anything but letters and digits as one space,
equivalent spellings made equal, copyright lines and empty lines left out, joined by a space. Whole texts (also
without title lines), each line as a text of its own, and runs of words inside the text are hashed and joined with
the digests of known licences (a small fixed table, broadcast): statements and bodies in KNOWN, whole texts in the
folder licenses, each as its file, from its body on, and to the end of its terms. A run starts wherever the first
words of a known text stand and has that text's number of words, whatever the line breaks or what is around it.
Holders' names in BSD texts and numbers of their clauses are taken as equal. DataFrame functions only; only ids and
digests of matches are shuffled. The SQL of this query knows statements, KNOWN and whole documents alone.

Null and empty texts have no licence; rows of equal id share what any of them matches; a repeated line counts
once. Other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence texts and the usual statements by which texts name a licence.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
#: Spellings taken as equal, applied in turn to " word word " with single spaces.
SPELLINGS = [(" licence ", " license "), (" licences ", " licenses "), (" sub license ", " sublicense "), (" licenced ", " licensed "), (" v ", " version "), (" non infringement ", " noninfringement ")]
COPYRIGHT = "^(c )?copyright (c |[12][0-9]{3})|^c [12][0-9]{3}"


#: Title lines of licence files, and lines around them that aren't of the body.
TITLE = "^(the )?(mit|isc|bsd|bsd [234] clause|[234] clause bsd|new bsd|simplified bsd|modified bsd|zlib|apache|unlicense|mozilla public|gnu (lesser |library )?general public|0bsd|bsd zero clause) license( mit| isc| version [0-9]( [0-9])?)*$|^version 2 0 january 2004$|^https? (www )?(apache org licenses|opensource org licenses [a-z0-9 ]+)$|^all rights reserved$|^copyright yyyy name of copyright owner$"
#: Applied in turn to whole texts and runs: what differs from file to file.
HOLDERS = [
    ("neither the name of .{1,120}? nor the names of [a-z]+ contributors", "neither the name of the holder nor the names of its contributors"),
    ("this software is provided by .{1,120}? as is and any", "this software is provided by the holder as is and any"),
    ("in no event shall .{1,120}? be liable for any direct", "in no event shall the holder be liable for any direct"),
    (" 1 redistributions of source", " redistributions of source"), (" 2 redistributions in binary", " redistributions in binary"), (" 3 neither the name", " neither the name"),
]
#: Where bodies begin and terms end, in canonical form; first words that name a known text.
BODIES, TERMS, OPENING = ("terms and conditions for use reproduction and distribution", "everyone is permitted to copy"), "end of terms and conditions", 6


def canonical_line(line: Column) -> Column:
    """One line's canonical form."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty and copyright lines."""
    return F.filter(F.transform(F.split(text, "\n", -1), canonical_line), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def body(lines: Column, titles: bool = False) -> Column:
    """Lines (without titles, if not asked for) joined, with what differs from file to file made equal."""
    out = F.concat(F.lit(" "), F.array_join(lines if titles else F.filter(lines, lambda x: ~x.rlike(TITLE)), " "), F.lit(" "))
    for a, b in HOLDERS:
        out = F.regexp_replace(out, a, b)
    return F.trim(out)


def texts() -> list[tuple[str, str]]:
    """Licence and text of each file in the folder licenses."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def known_digests(spark, known=None) -> DataFrame:
    """license, digest of each known text."""
    rows = spark.createDataFrame(list(known or KNOWN), "license string, text string")
    return rows.select("license", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest")).distinct()


def known_bodies(spark, known=None) -> DataFrame:
    """license, body of each known text: as it is, from its body on, and each of these to the end of its terms."""
    rows = spark.createDataFrame(list(known or KNOWN + texts()), "license string, text string").select("license", canonical_lines(F.col("text")).alias("lines"))
    # without titles as whole texts are, with them as runs are: a title inside a text may share a line in another
    rows = rows.select("license", F.explode(F.array(body(F.col("lines")), body(F.col("lines"), titles=True))).alias("body"))
    starts = F.array(F.lit(1), *(F.instr("body", b) for b in BODIES))
    rows = rows.select("license", "body", F.explode(starts).alias("at")).where("at > 0").select("license", F.expr("substring(body, at)").alias("body"))
    upto = F.instr("body", TERMS)
    return rows.select("license", F.explode(F.array("body", F.when(upto > 0, F.substring("body", F.lit(1), upto - 1 + len(TERMS))))).alias("body")).where("body <> ''").distinct()


def runs(text: Column, lengths: list[tuple[str, int]]) -> Column:
    """Digests of the runs of words that start with a known text's first words and are as long."""
    openings = sorted({o for o, _ in lengths})
    said = F.concat(F.lit("| "), text, F.lit(" "))
    sizes = F.array(*(F.struct(F.lit(o + " ").alias("opening"), F.lit(n).alias("n")) for o, n in lengths))
    rests = F.transform(F.array(F.split(said, f"(?= (?:{'|'.join(openings)}) )", -1)), lambda parts: F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda k: F.ltrim(F.array_join(F.slice(parts, k, F.size(parts)), ""))))
    hashed = F.transform(F.get(rests, 0), lambda rest: F.transform(
        F.filter(sizes, lambda o: rest.startswith(o["opening"])), lambda o: F.sha2(F.call_function("substring_index", rest, F.lit(" "), o["n"]), 256)))
    found = F.lit(False)
    for o in openings:
        found = found | F.contains(said, F.lit(f" {o} "))
    return F.when(found, F.flatten(hashed)).otherwise(F.array().cast("array<string>"))


def license_scan(docs: DataFrame, known=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, whole_license (null, or the licence whose text it is), licenses (ids of lines, runs and whole, sorted, comma-separated), n_licenses."""
    spark = docs.sparkSession
    bodies = known_bodies(spark, known)
    lengths = [(r.opening, r.n) for r in bodies.select(F.substring_index("body", " ", OPENING).alias("opening"), F.size(F.split("body", " ")).alias("n")).where(f"n > {OPENING}").distinct().collect()]
    table = F.broadcast(known_digests(spark, known).unionByName(bodies.select("license", F.sha2("body", 256).alias("digest"))).distinct())
    lines = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    lines = lines.select("id", "lines", body(F.col("lines")).alias("body"), body(F.col("lines"), titles=True).alias("text"))
    part = lambda x, whole: F.struct(x.alias("digest"), F.lit(whole).alias("whole"))
    digests = lines.select(
        "id", F.inline(F.array_distinct(F.concat(
            F.transform("lines", lambda x: part(F.sha2(x, 256), False)),
            F.array(part(F.sha2(F.array_join("lines", " "), 256), True), part(F.sha2("body", 256), True)),
            F.transform(runs(F.col("text"), lengths), lambda x: part(x, False)),
        ))),
    )
    found = (digests.join(table, "digest").groupBy("id")
             .agg(F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"), F.collect_set("license").alias("found")))
    return docs.select(F.col(id_col).alias("asked")).join(found, F.col("asked").eqNullSafe(F.col("id")), "left").select(
        F.col("asked").alias(id_col), "whole_license", F.array_join(F.sort_array(F.coalesce("found", F.array().cast("array<string>"))), ",").alias("licenses"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"),
    )
