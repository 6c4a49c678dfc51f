"""Licence texts found by canonical digest; DataFrame operations only."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm.tables import id_and_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that count as one word: fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("noncommercial", "non commercial"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("organisation", "organization"),
]
#: Notices that stand for a licence, beside the whole texts: fixed values.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
]

#: ``NAME.txt`` is the body of a short licence, without title and copyright lines; ``digests.tsv`` has the canonical digests of long ones.
FOLDER = Path(__file__).parent / "license_texts"
#: Titles that the bodies appear under, besides none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License"],
    "BSD-3-Clause": [
        "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License",
    ],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
}
RESERVED = "All rights reserved."

_MARKS = r"\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F"


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def with_digest(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``digest`` and ``has_words`` of the canonical form in place of the text.

    The canonical form has lower case A-Z, no copyright lines, one spelling, and
    words and digits joined by one space. Few texts hold a copyright line or
    another spelling, so plain searches decide whether the patterns run at all.
    """
    t = F.col("_t")
    out = df.withColumn("_t", F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER))
    notice = F.regexp_replace(t, r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)|©)[^\n]*", "")
    out = out.withColumn("_t", F.when(_any_of(t, ["copyright", "(c)", "©"]), notice).otherwise(t))
    # A run that is one space already stays as it is.
    out = out.withColumn("_t", F.regexp_replace(t, rf"[{_MARKS}][{_MARKS} ]*| [{_MARKS} ]+", " "))
    spelt = reduce(lambda s, pair: F.regexp_replace(s, rf"\b{pair[0]}\b", pair[1]), SPELLINGS, t)
    out = out.withColumn("_t", F.when(_any_of(t, [other for other, _ in SPELLINGS]), spelt).otherwise(t))
    # Never null, and never compared with a literal by its user: a filter on it that Spark moves below would repeat the work.
    out = out.withColumn("has_words", F.trim(t) != "").withColumn("digest", F.coalesce(F.sha2(F.trim(t), 256), F.lit("")))
    return out.drop("_t", text_col)


def known_digests(known: DataFrame) -> DataFrame:
    """``license, digest`` of ``known(license, text)``, texts without words left out; a digest of two names goes to the first in order."""
    return with_digest(known.select("license", "text"), "text").where("has_words").groupBy("digest").agg(F.min("license").alias("license"))


def whole_texts() -> list[tuple[str, str]]:
    """``license, text`` of the short licences: each title or none, rights reserved or not, conditions numbered or not."""
    out = []
    for path in sorted(FOLDER.glob("*.txt")):
        body = path.read_text(encoding="utf-8")
        for text in dict.fromkeys([body, re.sub(r"(?m)^[ \t]*[0-9][.)][ \t]", "", body)]):
            for title in ["", *TITLES.get(path.stem, [])]:
                out += [(path.stem, f"{title}\n{rights}\n{text}") for rights in ("", RESERVED)]
    return out


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *whole_texts()], "license string, text string")


def known_table(spark: SparkSession) -> DataFrame:
    """``license, digest`` of the notices, the short licences and the long ones."""
    rows = [tuple(line.split("\t")) for line in (FOLDER / "digests.tsv").read_text(encoding="utf-8").splitlines()]
    long = spark.createDataFrame(rows, "license string, digest string")
    both = known_digests(known_texts(spark)).unionByName(long)
    # A local table, so that neither of its two uses digests the texts again.
    return spark.createDataFrame(both.groupBy("digest").agg(F.min("license").alias("license")).collect(), "digest string, license string")


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, license, n_lines, line_licenses`` of every document.

    ``digest`` is that of the whole canonical text and ``license`` the known
    licence with it, else null. Every line is looked up as a text of its own too:
    ``n_lines`` counts the lines that are a known licence text, ``line_licenses``
    lists their distinct licences in order, joined by commas. Null and empty
    texts have the digest of the empty string and no licence; so do known texts
    without words, which are ignored. One row for each row: rows that repeat an id,
    or have none, are told apart by their text, and each shows its own lines.

    The known digests come from the caller's ``known(license, text)``, else from
    ``known_table``; below Spark's own size
    threshold it is broadcast, else both sides are shuffled. Lines that are no
    licence leave before anything is grouped.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    table = known_digests(known) if known is not None else known_table(docs.sparkSession)
    whole = with_digest(docs, "text").join(table, "digest", "left")
    lines = docs.select(F.col("doc_id").alias("id"), F.col("t").alias("of"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    held = with_digest(lines, "line").join(table, "digest")
    # Rows that repeat id and text repeat their lines too: each line counts once.
    held = held.groupBy("id", "of").agg(
        F.countDistinct("at").alias("n_lines"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses")
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("of"))
    return whole.join(held, same, "left").select(
        "doc_id", "digest", "license", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses")
    )
