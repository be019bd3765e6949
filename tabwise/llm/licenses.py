"""Licence scan by canonical digest: texts, runs of blocks between blank lines, and lines
that are a known licence text once case, punctuation, copyright lines and spellings are
made alike.  In runs of blocks, titles and rights lines that head a block do not count.

One heavy pass canonicalises each text and keeps its line breaks; the units are cut from
that, and only their digests are joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import table, text_or_empty
from tabwise.llm.standard_licenses import standard_texts, titles

#: The standard texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Licence, text: those that the SQL holds; the query has the standard table besides.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Equivalent spellings, replaced wherever they stand, on both sides of the join.
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"), ("copyright owner", "copyright holder"))
#: A line of its own that names who holds the rights.
RIGHTS = r"(^|\n)[ \t*#/;]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©)[^\n]*"
#: Between blocks of a canonical text.
BLANK = r"\n *\n[ \n]*"
#: Known texts that one broadcast may hold, of about 100 bytes each.
MAX_BROADCAST = 100_000
#: Parts over which one digest is spread where the known texts are more than that.
SALTS = 64


def canonical(text: Column) -> Column:
    """Lower case, rights lines empty, other marks as blanks, spellings alike; lines stay."""
    text = F.regexp_replace(F.lower(text), RIGHTS, "\n")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def digest(unit: Column) -> Column:
    """Null for a unit without letters or digits."""
    return F.sha2(F.nullif(F.trim(F.regexp_replace(unit, "[ \n]+", " ")), F.lit("")), 256)


def _heads() -> str:
    """Lines at the top of a block that name a licence or who holds the rights."""
    names = sorted({" ".join(re.findall(r"\w+", t.lower())) for t in titles()}, key=lambda t: (-len(t), t))
    return rf"(^|\n *\n[ \n]*)(?: *(?:copyright(?: [^\n]*)?|all rights reserved|{'|'.join(names)}) *(?:\n[ \n]*|$))+"


def _blocks(text: Column) -> Column:
    """The blocks of a canonical text that have words, without the lines that head them."""
    return F.filter(F.split(F.regexp_replace(text, _heads(), "$1"), BLANK), lambda b: b.rlike("[^ \n]"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license, whole: each licence of ``known`` (license, text) that a text, some
    of its consecutive blocks or one of its lines equals; whole if the text itself does,
    or does but for titles and rights lines.

    Null and empty texts and known texts equal none.  Rows of one doc_id, null included,
    count as one document.  Other columns are not read.
    """
    lines = docs.select("doc_id", canonical(text_or_empty()).alias("c")).select("doc_id", "c", _blocks(F.col("c")).alias("blocks"))
    units = F.array_distinct(F.concat(F.array("c"), F.split("c", BLANK), F.split("c", "\n")))
    unit = lambda run, size: lambda u, i: F.struct(F.lit(run).alias("run"), i.alias("place"), size.alias("size"), u.alias("unit"))
    both = F.concat(F.transform(units, unit(False, F.lit(1))), F.transform("blocks", unit(True, F.size("blocks"))))
    parts = lines.select("doc_id", F.xxhash64("c").alias("text"), F.explode(both).alias("u"))
    parts = parts.select("doc_id", "text", "u.run", "u.place", "u.size", digest(F.col("u.unit")).alias("digest")).where("digest is not null")

    # A known text is one unit, and a run of blocks: a row for each, with its place.
    texts = known.select("license", canonical(text_or_empty()).alias("c")).select("license", "c", _blocks(F.col("c")).alias("blocks"))
    whole = texts.select("license", F.lit(False).alias("run"), F.lit("").alias("of"), F.lit(1).alias("n"), F.lit(0).alias("at"), digest(F.col("c")).alias("digest"))
    runs = texts.select("license", F.size("blocks").alias("n"), F.transform("blocks", digest).alias("d")).select(
        "license", F.lit(True).alias("run"), F.sha2(F.array_join("d", " "), 256).alias("of"), "n", F.posexplode("d").alias("at", "digest")
    )
    names = whole.unionByName(runs).where("digest is not null").distinct()
    if names.count() <= MAX_BROADCAST:
        found = parts.join(F.broadcast(names), ["run", "digest"])
    else:
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = parts.join(names.withColumn("salt", salts).hint("merge"), ["run", "digest", "salt"])
    # A unit has one place; a run is there if all its blocks are, one after another.
    start = (F.col("place") - F.col("at")).alias("start")
    held = found.groupBy("doc_id", "text", "license", "run", "of", "n", "size", start).agg(F.size(F.collect_set("at")).alias("held"))
    is_whole = F.when(F.col("run"), F.col("n") == F.col("size")).otherwise(F.col("start") == 0)
    return held.where("held = n").groupBy("doc_id", "license").agg(F.max(is_whole).alias("whole"))


def known_texts(spark: SparkSession) -> DataFrame:
    """license, text: the build side of the query."""
    return spark.createDataFrame([*KNOWN, *standard_texts()], "license string, text string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_texts(spark))


def _canonical_sql(text: str) -> str:
    rights = RIGHTS.replace("\\n", "\n").replace("\\t", "\t")
    out = f"regexp_replace(regexp_replace(lower({text}), '{rights}', chr(10), 'g'), '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


_rows = ", ".join(f"('{name}', '{text}')" for name, text in KNOWN)
OP3_SQL = f"""
with known as (
  select distinct license, trim(regexp_replace({_canonical_sql("text")}, '[ \n]+', ' ', 'g')) as unit
  from (values {_rows}) as k(license, text)
), canon as (
  select doc_id, {_canonical_sql("text")} as c from documents where text is not null
), parts as (
  select doc_id, true as whole, c as unit from canon
  union all select doc_id, false, unnest(regexp_split_to_array(c, '\n *\n[ \n]*')) from canon
  union all select doc_id, false, unnest(string_split(c, '\n')) from canon
)
select doc_id, license, bool_or(whole) as whole
from (select doc_id, whole, trim(regexp_replace(unit, '[ \n]+', ' ', 'g')) as unit from parts) p
join known using (unit) where unit <> '' group by doc_id, license
"""
