"""Licence scans by canonical digests: normalise, digest, join to the digests of known licences.

The canonical form has lower case, no copyright lines, no punctuation, single spaces and one
spelling of words that licences spell in several ways. An entire text matches when its digest is
known; each line of a text that is not empty in this form is also looked up as an entire text of
its own, which finds notices.

Entire texts are also looked up in a second form, which leaves out the lines that begin with a
copyright notice in any form, and no others: list items "(c)" stay. ``digest`` is that of the first.
Full texts of common licences lie in ``texts``, one file for each, named by licence.

Edge cases: a null or empty text has the digest of nothing and no licence; texts of any length are
digested whole; the known texts are joined by digest, so two names for one canonical text both
count and the smaller name is reported; repeated rows are reported once, with their notices once for
each of them; rows with equal or null ids and different texts are reported each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut

# Spellings that licence texts use for one word (left: found, right: canonical).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

# Fixed values: (name, text) of known licences and of the notices that stand for them.
KNOWN = [
    ("MIT", MIT), ("MIT", "The MIT License\n\n" + MIT), ("MIT", "MIT License\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]

COPYRIGHT_LINE = r"(?m)^[^\n]*(\(c\)|©|copyright [0-9]|all rights reserved)[^\n]*$"
# in the second form: lines that begin with a notice; "copyright" in running text, where a line happens to break, is none
NOTICE_LINE = (
    r"(?m)^[^\na-z0-9(©]*(copyright(?![a-z])(?!\s+(notice|holder|owner|law|licen|statement|interest|treat|and |or |in |is |to ))"
    r"|©|\(c\)\s*(copyright|[0-9])|all rights reserved)[^\n]*$"
)
# white space and punctuation other than line feeds, which stay until lines are looked up
PUNCTUATION = r"[!-/:-@\[-`{-~\x09\x0b-\x0d\x20‐-―‘-‟«»\u00a0]+"


def _spelled() -> str:
    """A pattern of the words to respell, between spaces or line feeds; alternatives share first letters."""
    by: dict[str, list[str]] = {}
    for w in SPELLINGS:
        by.setdefault(w[0], []).append(w[1:])
    return r"[ \n](?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items()) + r")[ \n]"


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is built once, wherever the optimizer moves the column."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _marked(low: Column) -> Column:
    """Whether a text in lower case can have copyright lines."""
    return low.contains("(c)") | low.contains("©") | low.contains("copyright") | low.contains("all rights reserved")


def canonical_lines(text: Column, dropped: str = COPYRIGHT_LINE) -> Column:
    """Array of the canonical forms of a text's lines that are not empty.

    No step looks across a line feed, so the lines joined by spaces are the canonical text.
    """
    known = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    respelled = lambda line: F.array_join(F.transform(F.split(line, " "), lambda w: F.coalesce(F.element_at(known, w), w)), " ")
    bare = lambda low: F.regexp_replace(F.when(_marked(low), F.regexp_replace(low, dropped, "")).otherwise(low), PUNCTUATION, " ")
    # texts without any of the spellings, nearly all, skip the word-wise replacement
    lines = lambda b: F.when(b.rlike(_spelled()), F.transform(F.split(b, "\n"), respelled)).otherwise(F.split(b, "\n"))
    found = _bind(F.lower(text), lambda low: _bind(F.concat(F.lit("\n"), bare(low), F.lit("\n")), lines))
    return F.filter(F.transform(found, lambda line: F.trim(line)), lambda line: line != "")


def canonical(text: Column) -> Column:
    """Lower case, copyright lines out, punctuation and white space to single spaces, one spelling."""
    return F.array_join(canonical_lines(text), " ")


def digest(text: Column) -> Column:
    return F.md5(F.encode(canonical(text), "UTF-8"))


def held_digest(text: Column) -> Column:
    """Digest of the second form."""
    return F.md5(F.encode(F.array_join(canonical_lines(text, NOTICE_LINE), " "), "UTF-8"))


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in ``texts``; what follows the licence in a file's name tells variants apart."""
    found = []
    for file in sorted((Path(__file__).parent / "texts").glob("*.txt")):
        name = file.name.removesuffix(".txt")
        for variant in (".regents", ".titled"):
            name = name.removesuffix(variant)
        found.append((name, file.read_text(encoding="utf-8")))
    return found


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN, full: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence): one row per canonical text; ``full`` texts, by default those of the files, in the second form only."""
    # by way of pandas the rows become a local relation, whose size Spark knows when it plans the join
    table_of = lambda rows: spark.createDataFrame(pd.DataFrame(rows, columns=["licence", "text"]), "licence string, text string")
    forms = F.array_distinct(F.array(digest(F.col("text")), held_digest(F.col("text"))))
    short = table_of(texts).select("licence", F.explode(forms).alias("digest"))
    long = table_of(full_texts() if full is None else full).select("licence", held_digest(F.col("text")).alias("digest"))
    return short.unionByName(long).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, licence, notices, n_notices) per document.

    ``licence`` names the licence that the whole text is; ``notices`` the distinct ones that single
    lines are, joined by commas. Texts are read once: digests of whole texts and lines meet the known
    ones together, and whole texts and matching lines are stored. The known side is broadcast when it
    is below Spark's threshold, else both sides are shuffled by digest.
    """
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = F.when(_marked(F.lower(full)), held_digest(full))  # else both forms are one
    ref = F.xxhash64(F.col(f"`{doc_id}`"), full)  # notices belong to a row; its id may be null or shared
    lines = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), ref.alias("ref"), canonical_lines(full).alias("lines"), held.alias("held"))
    md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
    none = F.lit(None).cast("string")
    entry = lambda of, look: F.struct(of.alias("of"), look.alias("digest"))
    entries = lines.select("doc_id", "ref", "held", md5(F.array_join("lines", " ")).alias("whole"), F.transform("lines", lambda line: md5(line)).alias("lines")).select(
        "doc_id", "ref", F.explode(F.concat(
            F.array(entry(F.col("whole"), F.col("whole"))),
            F.when(F.col("held") != F.col("whole"), F.array(entry(F.col("whole"), F.col("held")))).otherwise(F.array().cast("array<struct<of:string,digest:string>>")),
            F.transform("lines", lambda d: entry(none, d)),
        )).alias("e"),
    ).select("doc_id", "ref", "e.*")
    met = cut(entries.join(known, "digest", "left").where(F.col("of").isNotNull() | F.col("licence").isNotNull()), "licences")
    whole = met.where("of IS NOT NULL").groupBy("doc_id", "ref", F.col("of").alias("digest")).agg(F.min("licence").alias("licence"))
    found = met.where("of IS NULL").groupBy("ref").agg(
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"), F.count("*").alias("n_notices"),
    )
    return whole.join(found, "ref", "left").select(
        "doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
    )
