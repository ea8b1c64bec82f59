"""Citations of documents by documents: windows, numbers, names, and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import name_key, names_overlap, type_hint, unbound
from tessera.operators.notes import all_of

# The verbs of a basis, a cited number and name, and the types of
# documents that cite and that are cited.
VERB = (
    r"(?iu)(?:dayan[ıi]larak\s+haz[ıi]rlan|dayan[ıi]larak\s+d[üu]zenlen|dayan[ıi]larak\s+y[üu]r[üu]rl[üu][ğg]e|"
    r"gere[ğg]ince\s+karar\s+veril|uyar[ıi]nca\s+karar\s+veril|h[üu]k[üu]mleri\s+gere[ğg]ince|g[öo]re\s+karar\s+veril)"
)
NUMBER = r"(?isu)(\d{1,5})\s*say[ıi]l[ıi]\s*(.{0,90})"
NAME = r"((?:[A-ZÇĞİÖŞÜ][\p{L}\p{N}_]+\s+){1,6}(?:Kanun|Kararname)[\p{L}\p{N}_]{0,8})(?![\p{L}\p{N}_])"
SOURCES, TARGETS = (3, 5, 6, 7, 8, 9, 20, 21, 22), (0, 1, 2, 4, 17, 19, 20)
BEFORE, QUOTE = 900, 180
RELIABLE = ("numara", "numara+tur", "numara+ad", "ad")


def windows(x: Column) -> Column:
    """What leads up to each verb, and the verb; windows may overlap."""
    text = unbound(F.coalesce(x, F.lit("")))
    verbs = all_of(text, VERB)
    gaps = F.slice(F.split(text, VERB), F.lit(1), F.size(verbs))
    spans = F.zip_with(gaps, verbs, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        verb, end = s["at"] + x["g"], s["at"] + x["g"] + x["v"]
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(F.greatest(verb - BEFORE, F.lit(0)).alias("s"), end.alias("e"))).alias("out"))

    return F.transform(F.aggregate(spans, start, step, lambda s: s["out"]), lambda w: text.substr(w["s"] + 1, w["e"] - w["s"]))


def numbers(x: Column) -> Column:
    """array of struct(no, said): a number and what follows it. A number within
    what follows another one is part of that."""
    return F.zip_with(all_of(x, NUMBER, 1), all_of(x, NUMBER, 2), lambda a, b: F.struct(a.alias("no"), b.alias("said")))


def edges(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Edges kaynak -> hedef of documents (anahtar, text) that cite catalogue rows
    (anahtar, mevzuatNo, mevzuatTur, mevzuatTertip, mevAdi, sira).

    A number's candidates are narrowed by the type that the wording names, where
    that leaves any; of several, the only one whose name is said is taken, else
    the one of the largest series. A name without a number cites the first
    document of that name. The first finding of a target gives the method.
    """
    cited = catalogue.where(F.col("mevzuatTur").isin(*TARGETS))
    citing = catalogue.where(F.col("mevzuatTur").isin(*SOURCES)).select("anahtar")
    spans = documents.join(citing, "anahtar", "left_semi").select(F.col("anahtar").alias("kaynak"), F.posexplode(windows(F.col("text"))).alias("w", "span"))
    quote = F.trim(F.substring("span", -QUOTE, QUOTE)).alias("alinti")

    asked = spans.select("kaynak", "w", quote, F.posexplode(numbers(F.col("span"))).alias("c", "x")).select("kaynak", "w", "alinti", "c", "x.no", "x.said")
    asked = asked.withColumn("hint", type_hint(F.col("said")))
    rows = asked.join(cited.withColumnRenamed("mevzuatNo", "no"), "no")
    one = Window.partitionBy("kaynak", "w", "c")
    rows = rows.withColumn("typed", F.coalesce(F.array_contains("hint", F.col("mevzuatTur")), F.lit(False)))
    rows = rows.withColumn("any", F.max("typed").over(one)).where("typed OR NOT any")
    rows = rows.withColumn("named", names_overlap(F.col("said"), F.col("mevAdi")))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(one)).withColumn("nn", F.count_if("named").over(one))
    series = F.coalesce(F.col("mevzuatTertip").try_cast("int"), F.lit(0))
    best = Window.partitionBy("kaynak", "w", "c").orderBy(F.desc(F.col("named") & (F.col("nn") == 1)), F.desc(series), "sira")
    method = F.when((F.col("n") == 1) & F.col("hint").isNotNull(), "numara+tur").when(F.col("n") == 1, "numara").when(F.col("nn") == 1, "numara+ad").otherwise("numara+tertip")
    by_number = rows.withColumn("rk", F.row_number().over(best)).where("rk = 1").select("kaynak", F.col("anahtar").alias("hedef"), method.alias("yontem"), "alinti", "w", F.lit(1).alias("path"), "c")

    names = cited.withColumn("ad", name_key(F.col("mevAdi"))).where("length(ad) > 10").groupBy("ad").agg(F.min_by("anahtar", "sira").alias("hedef"))
    said = spans.select("kaynak", "w", quote, F.posexplode(all_of(F.col("span"), NAME, 1)).alias("c", "said")).withColumn("ad", name_key(F.col("said")))
    by_name = said.join(names, "ad").select("kaynak", "hedef", F.lit("ad").alias("yontem"), "alinti", "w", F.lit(2).alias("path"), "c")

    first = Window.partitionBy("kaynak", "hedef").orderBy("w", "path", "c")
    found = by_number.unionByName(by_name).where("kaynak <> hedef").withColumn("rk", F.row_number().over(first)).where("rk = 1")
    return found.select("kaynak", "hedef", F.lit("dayanak").alias("iliski"), "yontem", F.col("yontem").isin(*RELIABLE).alias("guvenilir"), "alinti")
