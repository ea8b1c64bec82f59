"""Canonical digest lookup of whole licence texts, in DataFrame operations only.

A text and the known licences go through one canonical form (case, equivalent
spellings, copyright lines, punctuation and white space); equal SHA-256 digests
of that form name the licence. The known side is a fixed table whose size does
not depend on the corpus, which is what bounds its broadcast.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One-line notices by licence id; one id may have several texts.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Shorter texts are also known without their title, and with bullets for numbers.
SHORT = 4000


def _variants(text: str) -> set[str]:
    """A whole text as it is; a short one also in the forms in which it circulates."""
    if len(text) > SHORT:
        return {text}
    title, _, body = text.partition("\n\n")
    out = {text} if "\n" in title or len(title) > 60 or not body else {text, body}
    return out | {re.sub(r"(?m)^[ \t]*\d+\. ", "* ", x) for x in out}


@cache
def texts_known() -> tuple[tuple[str, str], ...]:
    """The notices above and the variants of the whole texts in license_texts,
    a file a licence, named by its id."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return (*NOTICES, *((f.name[:-4], x) for f in files for x in sorted(_variants(f.read_text("utf-8")))))


#: Equivalent spellings, applied in this order to lower-cased text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("noninfringement", "non infringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("programme", "program"),
    ("per cent", "percent"),
    ("https://", "http://"),
)
#: A line that states a copyright, or reserves all rights. A sentence that goes
#: on with "copyright" on a new line, or an item (c) of a list, is none.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t:]*(\(c\)|©|[0-9<{\[]|by |the )|\(c\)[ \t]*(copyright|[0-9<{\[])|©|all rights reserved)[^\n]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for _ in range(2):  # neighbouring lines share a line break
        out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{00A0}\x{2013}\x{2014}\x{2018}-\x{201D}]+", " "))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(license, digest), one row per digest; of ids with one form, the least."""
    table = spark.createDataFrame([*(texts or texts_known())], "license string, text string")
    return table.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """One row per document: doc_id, canonical_sha256, license (null: unknown).

    Null or empty text, or text of punctuation alone, has the digest of the
    empty form and no licence. Repeated rows give repeated rows; other columns
    are ignored.
    """
    texts = texts or texts_known()
    if len(texts) > 10_000:
        raise ValueError("more known texts than the broadcast is meant for")
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    look = known(docs.sparkSession, texts).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return rows.join(F.broadcast(look), rows["canonical_sha256"] == look["digest"], "left").select("doc_id", "canonical_sha256", "license")


def oracle() -> str:
    """The same as DuckDB SQL over the view documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    form = "translate(coalesce(text, ''), " + f"'{UPPER}', '{LOWER}')"
    for _ in range(2):
        form = f"regexp_replace({form}, {q(COPYRIGHT_LINE)}, chr(10), 'g')"
    for old, new in SPELLINGS:
        form = f"replace({form}, {q(old)}, {q(new)})"
    marks = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{00A0}\x{2013}\x{2014}\x{2018}-\x{201D}]+"
    form = f"trim(regexp_replace({form}, '{marks}', ' ', 'g'))"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in texts_known())
    return f"""WITH texts(license, text) AS (VALUES {values}),
known AS (SELECT sha256({form}) AS digest, min(license) AS license FROM texts WHERE {form} <> '' GROUP BY 1)
SELECT d.doc_id, d.digest AS canonical_sha256, k.license
FROM (SELECT doc_id, sha256({form}) AS digest FROM documents) d LEFT JOIN known k ON d.digest = k.digest"""
