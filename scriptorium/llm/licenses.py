"""Licence scan by canonical digests, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if
from scriptorium.llm.license_digests import DIGESTS

# Short licences and usual notices, as their publishers word them.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)
# What stands before the texts of KNOWN where they are files of their own.
_TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD")}
# Only notices: the word with a sign, a year or a place for one. "copyright notice and ..." starts many a wrapped line.
_COPYRIGHT = r"(?m)^[ \t]*(copyright[ \t:]*(\(c\)|©|\d{4}|[\[<{](y|d))|\(c\)[ \t]*\d{4}|©)[^\n]*$"
# Spellings that count as the same, the second one standing for both.
_SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("as-is", "as is"), ("&", " and "), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("maximis", "maximiz"),
    ("offence", "offense"), ("optimis", "optimiz"), ("organis", "organiz"), ("per cent", "percent"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"),
)
#: A table of known digests of more rows than this is joined by a shuffle, not by a broadcast.
MOST_BROADCAST = 400_000
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: F.Column) -> F.Column:
    """Lower case, without copyright lines, equivalent spellings as one, words with one space between them."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    for a, b in _SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, _OTHER, " "))


def digest(text: F.Column) -> F.Column:
    """SHA-256 of the canonical text; null where nothing is left of it."""
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def _texts() -> list[tuple[str, str]]:
    """(license, text) of the known texts, short licences with and without what stands before them in files."""
    return [*KNOWN, *((name, f"{title}\n{rights}\n{text}") for name, text in KNOWN[:3] for title in ("", *_TITLES[name]) for rights in ("", "All rights reserved."))]


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the known texts."""
    texts = spark.createDataFrame(_texts(), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    return texts.unionByName(spark.createDataFrame(DIGESTS, "license string, digest string")).dropDuplicates(["digest"])


def folder_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, license) of a folder's text files, each named by its licence: Name.txt, or Name--any.txt for other wordings of it."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:--[^/]*)?(?:\.txt)?$", 1).alias("license"), digest(F.col("value")).alias("digest"))
    return files.where("digest IS NOT NULL").select("digest", F.url_decode("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, text_license, n_notices, licenses, licensed), one for each row of docs.

    The digest of the entire text, and of each of its lines as a text of its own, is looked up among the
    known ones. text_license names the licence that the whole text is; n_notices counts lines that are a known
    text; licenses joins all names found, sorted. Null and empty texts have none. `known` (digest, license) may
    be a table of one's own, such as known_digests joined with folder_digests; of several names of a digest
    the first in order counts. The documents are shuffled by digest only where it is too large for a broadcast.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    known = broadcast_if(known.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license")), MOST_BROADCAST)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    each = numbered.select("row", "doc_id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line", "unit"))
    # the entire text is line 0 and stays in any case, other lines only where they are known
    found = each.select("row", "doc_id", "line", digest(F.col("unit")).alias("digest")).join(known, "digest", "left").where("line = 0 OR license IS NOT NULL")
    names = found.groupBy("row", "doc_id").agg(F.max(F.when(F.col("line") == 0, F.col("license"))).alias("text_license"), F.count_if((F.col("line") > 0) & F.col("license").isNotNull()).alias("n_notices"), F.array_sort(F.collect_set("license")).alias("names"))
    return names.select("doc_id", "text_license", "n_notices", F.array_join("names", ",").alias("licenses"), (F.size("names") > 0).alias("licensed"))


def _sql() -> str:
    """DuckDB SQL of license_scan with the same patterns, spellings and digests."""
    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{_COPYRIGHT}', '', 'g')"
        for a, b in _SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim(regexp_replace({out}, '{_OTHER}', ' ', 'g'))"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in _texts())
    published = ", ".join(f"('{name}', '{d}')" for name, d in DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (
  SELECT license, sha256({canon("text")}) AS digest FROM (VALUES {values}) AS t(license, text) UNION ALL SELECT * FROM (VALUES {published}) AS p(license, digest)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS rk, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT rk, 0 AS line, {canon("text")} AS c FROM d
  UNION ALL SELECT rk, 1, {canon("x")} FROM (SELECT rk, unnest(string_split(text, chr(10))) AS x FROM d)),
m AS (SELECT rk, line, license FROM u JOIN known ON sha256(c) = digest WHERE c <> ''),
a AS (
  SELECT rk, max(CASE WHEN line = 0 THEN license END) AS text_license, count(*) FILTER (WHERE line = 1) AS n_notices,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY rk)
SELECT doc_id, text_license, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices, coalesce(licenses, '') AS licenses, licenses IS NOT NULL AS licensed
FROM d LEFT JOIN a USING (rk)
"""


SQL = _sql()
