"""Chunks of a legal text: article headers with their places, and the text
between one cut and the next.

Places of matches need an imperative scan, so headers come from an Arrow UDF over
whole texts; all that follows (bodies, ids, status, tails) are Columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import article_id, even_spaces, strip
from tessera.functions.status import article_status
from tessera.operators.layout import DASH, NUMBER, SPECIAL, tail_kind, tail_start, text_kind

# The least lengths of a preamble, a tail and a paragraph.
LEAST_PART, LEAST_PARAGRAPH = 30, 20
WORD = r"(?:MADDE|Madde|madde)"
ONE = re.compile(rf"(?P<kind>{SPECIAL})?{WORD}\s+(?P<no>{NUMBER})\s*(?:{DASH}|[.)(:])")
SPAN = re.compile(rf"(?P<kind>{SPECIAL})?{WORD}\s+(?P<no>{NUMBER})\s*(?:il[aâ]|İL[AÂ]|[-–—])\s*(?P<to>{NUMBER})\s*(?:{DASH}|\.)")
CUTS = "array<struct<start:int,stop:int,kind:string,no:string,upto:string>>"
PARTS = "array<struct<tur:string,madde_id:string,govde:string>>"


def stands_alone(text: str, at: int) -> bool:
    """A header opens its line, or follows a gap of two blanks; never a bracket."""
    lead = text[text.rfind("\n", 0, at) + 1 : at]
    if not lead:
        return True
    return not lead.rstrip().endswith("(") and len(lead) - len(lead.rstrip(" \t")) >= 2


def rises(no: str, to: str) -> bool:
    return int(re.match(r"\d+", to).group()) > int(re.match(r"\d+", no).group())


def headers(text: str | None, upto: int) -> list[dict]:
    """The headers before `upto`: of those that start at one place the longest; a
    range counts only if its end is above its start."""
    longest: dict[int, tuple] = {}
    text = text or ""
    for pattern in (ONE, SPAN):
        for m in pattern.finditer(text):
            to = m.groupdict().get("to")
            if (to is None or rises(m["no"], to)) and m.end() > longest.get(m.start(), (0,))[0]:
                longest[m.start()] = (m.end(), m["kind"], m["no"], to)
    return [{"start": s, "stop": e, "kind": k, "no": n, "upto": t} for s, (e, k, n, t) in sorted(longest.items()) if s < upto and stands_alone(text, s)]


def header_cuts(text: Column, upto: Column) -> Column:
    def run(texts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([headers(t, int(u)) for t, u in zip(texts, ends, strict=True)])

    return F.pandas_udf(run, CUTS)(text, upto)


def paragraphs(x: Column) -> Column:
    """What blank lines set apart, of LEAST_PARAGRAPH characters or more."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"(?U)\n\s*\n"), strip), lambda p: F.length(p) >= LEAST_PARAGRAPH)


def chunks(documents: DataFrame) -> DataFrame:
    """(belge, text) to one row a chunk: chunk_id, belge, tur, madde_id, govde,
    mulga, durum, sira.

    A text with articles is its preamble (kunye), its articles (madde, each up to
    the next header or the tail) and its tail: paragraphs of provisions that were
    not worked in (ek_hukum), or one schedule (cizelge). Any other text is its
    paragraphs (paragraf). Defective texts have no chunks, nor does a tail of any
    other kind. chunk_id numbers a document's chunks from 1; belge is the texts' key,
    so a repeated one repeats its ids.
    """
    rows = documents.select("belge", even_spaces(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("kova", text_kind("text")).where("kova <> 'K5'")
    rows = rows.withColumn("upto", tail_start(F.col("text")))
    articles = F.col("kova").isin("K1", "K3")
    rows = rows.withColumn("cuts", F.coalesce(F.when(articles, header_cuts(F.when(articles, F.col("text")), F.col("upto"))), F.array().cast(CUTS)))
    text, has = F.col("text"), F.size("cuts") > 0
    rows = rows.withColumn("tail", F.when(has, strip(text.substr(F.col("upto") + 1, F.length("text") - F.col("upto") + 1))))
    rows = rows.withColumn("kind", F.when(F.length("tail") >= LEAST_PART, tail_kind(F.col("tail"))))

    def part(kind: str, body: Column, no: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("tur"), (F.lit("") if no is None else no).alias("madde_id"), body.alias("govde"))

    def article(c: Column, i: Column) -> Column:
        end = F.coalesce(F.get("cuts", i + 1)["start"], F.col("upto"))
        return part("madde", strip(text.substr(c["start"] + 1, end - c["start"])), article_id(c["kind"], c["no"], c["upto"]))

    # All of a document's parts in order, as one array: its text is passed once,
    # and no shuffle numbers them.
    some = lambda when, parts: F.when(when, parts).otherwise(F.array().cast(PARTS))
    opening = F.filter(F.array(part("kunye", strip(text.substr(F.lit(1), F.get("cuts", F.lit(0))["start"])))), lambda x: F.length(x["govde"]) >= LEAST_PART)
    added = F.transform(paragraphs(F.col("tail")), lambda p: part("ek_hukum", p))
    prose = F.transform(paragraphs(text), lambda p: part("paragraf", p))
    parts = F.concat(
        some(has, opening.cast(PARTS)),
        F.transform("cuts", article).cast(PARTS),
        some(F.col("kind") == "ek_hukum", added.cast(PARTS)),
        some(F.col("kind") == "cizelge", F.array(part("cizelge", F.col("tail"))).cast(PARTS)),
        some(~has, prose.cast(PARTS)),
    )
    out = rows.select("belge", F.posexplode(parts).alias("p", "part")).select("belge", (F.col("p") + 1).alias("sira"), "part.*")
    out = out.withColumn("durum", F.when(F.col("tur").isin("madde", "paragraf"), article_status(F.col("govde"))))
    out = out.withColumn("mulga", F.when(F.col("durum").isNotNull(), F.col("durum") == "geçersiz"))
    return out.select(F.concat_ws("#", "belge", F.col("sira").cast("string")).alias("chunk_id"), "belge", "tur", "madde_id", "govde", "mulga", "durum", "sira")


def chunk_counts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(tur, durum, n) of chunks, and under `bos_belge` the documents without any."""
    by = rows.groupBy("tur", "durum").agg(F.count(F.lit(1)).alias("n"))
    none = documents.select("belge").join(rows.select("belge").distinct(), "belge", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(none.select(F.lit("bos_belge").alias("tur"), F.lit(None).cast("string").alias("durum"), "n"))
