"""Licence scans by canonical digest, in DataFrame functions only.

A text's canonical form has lower case, copyright lines (up to the licence's first words where lines were joined) and punctuation removed, white space joined and
equivalent spellings made one; its SHA-256 is looked up by a hash join in a table of known licences'
digests. The join holds one row of 64 hex digits per known licence, a table the caller states; texts
that are copies of one another share a digest and need no shuffle when the known table is broadcast,
which Spark decides by its size.

Null, empty and blank texts, and texts of copyright lines only, have the digest of the empty text and
match nothing. Repeated rows are each looked up. An empty table gives an empty result; an empty table
of known licences gives null licences. Other columns are ignored. Where several known ids have one
canonical text, the smallest id in string order is reported.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name owners and years only, and the words that reserve rights at the start of a line.
COPYRIGHT_LINE = r"(?:\A|\n)[^\n\p{L}]*(?:(?:portions[ \t]+)?copyright(?:[ \t]*(?:\(c\)|©|:))*(?:[ \t]+(?:by|[0-9(©\[<]|all rights|holder: )[^\n]*|[ \t]+[^\n]*[0-9]{4}[^\n]*)|©[^\n]*|\(c\)[^\n]*|all rights reserved[.]?)"

#: Where a copyright line and what follows it begin in texts whose lines were joined; a line break goes in front.
BREAK = r"(copyright[ \t]*(?:\(c\)|©)?[ \t]*[0-9]{4}|permission is hereby granted|permission to use, copy|redistribution and use in|everyone is permitted to|this software is provided|licensed under the )"

#: Equivalent spellings lose what they differ in, as harbour and harbor do; that other words lose letters too does no harm, as known texts
#: lose the same. In turn: -our; -ise, -yse, -ice and -ence with their forms; doubled l; -ogue; -dgement; and words with other ends,
#: among them sub-, non- and per- with and without a space, https, and the owner or holder of a copyright.
SPELLING = r"([a-z]o)u(r)|(licen|i|aly|en)[csz](e|ing|ation)|(l|og)(?:l|ue)|(dg)e(m)|( sub| non| per) |(copyright |art|whil|among|program|http|cent)(?:st|me|s|owner|holder|re|er|e|i)"
SPELLING_KEPT = range(1, 10)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, BREAK, "\n$1"), COPYRIGHT_LINE, "\n")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(t, SPELLING, "".join(f"${n}" for n in SPELLING_KEPT)))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(licences: DataFrame, license_id: str = "license_id", text: str = "text") -> DataFrame:
    """Rows (digest, license_id) of known licences; texts that are empty in canonical form are left out."""
    rows = licences.select(F.col(license_id).alias("license_id"), canonical(F.col(text)).alias("c")).where("c <> ''")
    return rows.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, digest, license_id (null if no known licence has this digest)."""
    rows = docs.select(F.col(key).alias("key"), digest(F.col(text)).alias("digest"))
    return rows.join(known.select("digest", "license_id"), "digest", "left").select(F.col("key").alias(key), "digest", "license_id")


# The public licence texts of the folder, and what may stand above them.
TEXTS = Path(__file__).parent / "licence_texts"
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense"],
}
# Short notices that are a document's whole text.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the texts in the folder, named ``id__n.txt``, with and without headings, and of the notices."""
    out = list(NOTICES)
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem.partition("__")[0], path.read_text(encoding="utf-8")
        out += [(name, text)] + [(name, f"{h}\n\n{text}") for h in HEADINGS.get(name, [])]
    return out


def default_known(spark: SparkSession) -> DataFrame:
    """Digests of the licences of the folder; callers with a fuller list pass their own table."""
    return known_digests(spark.createDataFrame(known_texts(), "license_id string, text string"))
