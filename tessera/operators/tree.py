"""The tree of a document: title, masthead, sections and articles, read off its
lines by running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import strip
from tessera.functions.present import category
from tessera.functions.status import lower_tr
from tessera.operators.layout import NUMBERED, SECTION

# An article's line, a repealed one, a masthead line, and what a
# heading is.
ARTICLE = r"^((?:EK|GEÇİCİ|MÜKERRER|Ek|Geçici|Mükerrer)\s+)?(MADDE|Madde)\s+(\d+)\s*[-–—.:]*\s*(.*)$"
REPEALED = r"(?iuU)^\(\s*mülga"
MASTHEAD = r"^[^:]{2,60}:"
MASTHEAD_WORDS = ("numarası", "tarihi", "yayımlandığı", "kabul", "dayandığı", "yetki", "düstur", "no", "kararının")
CAPITAL = r"^[ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ]"
ITEM = r"^\s*(?:\d+|[a-zA-ZçğıöşüÇĞİÖŞÜ])\s*[)\-–—]"
LONGEST, MOST_WORDS, TITLE = 70, 10, 200


def is_masthead(s: Column) -> Column:
    low, said = lower_tr(s), F.lit(False)
    for w in MASTHEAD_WORDS:
        said = said | low.contains(w)
    return s.rlike(MASTHEAD) & said


def is_heading(s: Column) -> Column:
    words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return (s != "") & (F.length(s) <= LONGEST) & (words <= MOST_WORDS) & s.rlike(CAPITAL) & ~s.endswith(".") & ~s.rlike(ITEM) & ~is_masthead(s)


def parse(documents: DataFrame) -> DataFrame:
    """(no, text) to one row a document: no, ad, kunye_satirlari, duz_metin,
    tam_metin, bolumler (array of struct(baslik, maddeler)), madde_sayisi, sayim.

    An article's heading is the line right above it, if that reads like one; it
    then leaves the text of the article before. Articles before any section stand
    in one without a heading; sections without articles go. A document without
    articles keeps its whole text.
    """
    lines = documents.select("no", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("at", "raw")).withColumn("s", strip(F.col("raw")))
    doc = Window.partitionBy("no").orderBy("at")
    so_far = doc.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("s")
    section = s.rlike(NUMBERED) | (s.rlike(SECTION) & (F.length(s) <= LONGEST))
    rows = lines.withColumn("article", s.rlike(ARTICLE)).withColumn("section", section & ~s.rlike(ARTICLE))
    rows = rows.withColumn("sec", F.sum(F.col("section").cast("int")).over(so_far)).withColumn("art", F.sum(F.col("article").cast("int")).over(so_far))
    rows = rows.withColumn("begun", (F.col("sec") > 0) | (F.col("art") > 0))
    before, after = F.lag("s").over(doc), F.lead("article").over(doc)
    free = ~F.col("article") & ~F.col("section")
    plain_before = F.coalesce(F.lag(free).over(doc), F.lit(False))
    rows = rows.withColumn("head", F.when(F.col("article") & plain_before & is_heading(before), F.regexp_replace(before, r"^[ :]+|[ :]+$", "")))
    rows = rows.withColumn("gone", free & is_heading(s) & F.coalesce(after, F.lit(False)))
    # A section closes the article that it follows.
    rows = rows.withColumn("art_sec", F.last(F.when(F.col("article"), F.col("sec")), ignorenulls=True).over(so_far))
    inside = (F.col("art") > 0) & (F.col("art_sec") == F.col("sec"))

    line = F.when(F.col("article"), strip(F.regexp_extract("s", ARTICLE, 4))).when(F.col("gone") | (s == "") | F.col("section"), None).otherwise(s)
    texts = rows.where(inside).groupBy("no", "sec", "art").agg(
        F.min(F.when(F.col("article"), F.struct("at", "s", "head"))).alias("h"),
        F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("at", line.alias("t"))))), lambda x: x["t"]).alias("ts"),
    )
    kind = F.upper(strip(F.regexp_extract("h.s", ARTICLE, 1)))
    body = F.array_join(F.filter("ts", lambda t: t != ""), "\n")
    repealed = F.regexp_extract("h.s", ARTICLE, 4).rlike(REPEALED)
    baslik = F.coalesce("h.head", F.lit(""))
    made = texts.select("no", "sec", "art", F.struct(F.regexp_extract("h.s", ARTICLE, 3).cast("int").alias("no"), F.when(kind == "", "MADDE").otherwise(kind).alias("tip"), baslik.alias("baslik"), body.alias("metin"), repealed.alias("mulga"), category(baslik, body, repealed).alias("kategori")).alias("m"))
    names = rows.where("section").select("no", "sec", F.col("s").alias("baslik"))
    by_section = made.groupBy("no", "sec").agg(F.transform(F.array_sort(F.collect_list(F.struct("art", "m"))), lambda x: x["m"]).alias("maddeler"))
    by_section = by_section.join(names, ["no", "sec"], "left").select("no", F.struct("sec", F.coalesce("baslik", F.lit("")).alias("baslik"), "maddeler").alias("b"))
    trees = by_section.groupBy("no").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: F.struct(b["baslik"].alias("baslik"), b["maddeler"].alias("maddeler"))).alias("bolumler"))

    # Before any structure: the title, until a masthead line; then the masthead.
    opening = rows.where("NOT begun AND s <> ''").withColumn("mast", F.max(is_masthead(s)).over(so_far))
    told = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "s")))), lambda x: x["s"])
    heads = opening.groupBy("no").agg(F.substring(F.array_join(told(~F.col("mast")), " "), 1, TITLE).alias("ad"), told(F.col("mast")).alias("kunye_satirlari"))
    out = documents.join(trees, "no", "left").join(heads, "no", "left")
    every = F.flatten(F.transform("bolumler", lambda b: b["maddeler"]))
    count = lambda k: F.coalesce(F.size(F.filter(every, lambda m: m["kategori"] == k)), F.lit(0))
    flat = F.col("bolumler").isNull()
    return out.select(
        "no", F.coalesce("ad", F.lit("")).alias("ad"), F.coalesce("kunye_satirlari", F.array().cast("array<string>")).alias("kunye_satirlari"), flat.alias("duz_metin"),
        F.when(flat, F.coalesce("text", F.lit(""))).otherwise("").alias("tam_metin"), "bolumler", F.when(flat, 0).otherwise(F.size(every)).alias("madde_sayisi"),
        F.create_map(*(x for k in ("icerik", "kalip", "mulga") for x in (F.lit(k), F.when(flat, 0).otherwise(count(k))))).alias("sayim"),
    )
