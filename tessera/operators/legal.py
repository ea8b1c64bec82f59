"""Keys, notes, citations, headings and chunks as queries over whole tables,
which the hand-written rows below join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import keys, present
from tessera.operators import chunks, citations, layout, notes, tree
from tessera.sources import readers

#: Bodies with amendment marks: single, several, long and unclosed, by the court,
#: not a mark, and repeated.
BODIES = (
    ("b", "1", "Madde 1 – (Değişik: 12/3/2010-5950/4 md.) Gövde."),
    ("b", "2", "(Ek: 1/1/2001-4000/1 md.; Mülga: 2/2/2005-5300/3 md.) Gövde."),
    ("b", "3", "(İkinci fıkra mülga: 3/3/2003-4800/2 md. ve devamı kapanmadan sürer"),
    ("b", "4", "(İptal: Anayasa Mahkemesinin 6/5/2013 tarihli ve E.:2012/7, K.:2013/46 sayılı kararı)"),
    ("b", "5", "(Ekim ayında başlar) ve (ek süre verilir)"),
    ("b", "6", "(Ek: 1/1/2001-4000/1 md.) Bir. (Ek: 1/1/2001-4000/1 md.) İki."),
)
#: Catalogue rows: anahtar, number, type, series, name, order.
CATALOGUE = (
    ("k100", "100", 1, "5", "Gümrük Kanunu", 1),
    ("k4a", "4", 19, "5", "Teşkilat Kararnamesi", 2),
    ("k4b", "4", 1, "5", "Orman Kanunu", 3),
    ("k7a", "7", 1, "3", "Vergi Usul Kanunu", 4),
    ("k7b", "7", 1, "5", "Kabotaj Hakkında Kanun", 5),
    *((f"s{i}", f"9{i}", 7, "5", f"Yönetmelik {i}", 10 + i) for i in range(1, 7)),
)
#: Basis sentences: one candidate, type, name, series, a bare name, and a number
#: that the one before it swallows.
BASES = (
    ("s1", "Bu Yönetmelik 100 sayılı metne dayanılarak hazırlanmıştır."),
    ("s2", "Bu Yönetmelik 4 sayılı Cumhurbaşkanlığı Kararnamesine dayanılarak hazırlanmıştır."),
    ("s3", "Bu Yönetmelik 7 sayılı Vergi Usul Kanununa dayanılarak hazırlanmıştır."),
    ("s4", "Bu Yönetmelik 7 sayılı Kanuna dayanılarak hazırlanmıştır."),
    ("s5", "Bu metin, eski Gümrük Kanununa dayanılarak hazırlanmıştır."),
    ("s6", "Bu Yönetmelik 100 sayılı ve 4 sayılı metinlere dayanılarak hazırlanmıştır."),
)
LINES = (
    "BİRİNCİ BÖLÜM", "Genel Hükümler", "A. Amaç", "MADDE 1 - Bu düzenleme amaçları gösterir.",
    "I. Kapsam", "MADDE 2 - Herkesi kapsar.", "MADDE 3 - Ayrıca yürürlüğe girer.", "Bir cümle.", "B. Süre", "MADDE 4 - Otuz gündür.",
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("belge"), "text")


def mark_rows(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The amendment marks of every document's text and of the bodies above."""
    rows = spark.createDataFrame([*BODIES], "belge string, madde_id string, govde string")
    if sf_dir:
        rows = rows.unionByName(_documents(spark, sf_dir).select("belge", F.lit("").alias("madde_id"), F.col("text").alias("govde")))
    return notes.amendment_marks(rows)


def citation_edges(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The edges that every document's text and the sentences above make; a
    document is cited by its id, and its type is the id's remainder by 23."""
    rows = spark.createDataFrame([*CATALOGUE], "anahtar string, mevzuatNo string, mevzuatTur int, mevzuatTertip string, mevAdi string, sira int")
    texts = spark.createDataFrame([*BASES], "anahtar string, text string")
    if sf_dir:
        docs = _documents(spark, sf_dir).withColumnRenamed("belge", "anahtar")
        texts = texts.unionByName(docs)
        number = F.col("anahtar").cast("long")
        rows = rows.unionByName(docs.select("anahtar", F.col("anahtar").alias("mevzuatNo"), (number % 23).cast("int").alias("mevzuatTur"), F.lit("5").alias("mevzuatTertip"), F.substring_index("text", ".", 1).alias("mevAdi"), (number + 1000).cast("int").alias("sira")))
    return citations.edges(texts, rows)


def heading_paths(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The headings of every document's lines and of the lines above."""
    rows = spark.createDataFrame([("b", i, x) for i, x in enumerate(LINES)], "belge string, sira int, satir string")
    if sf_dir:
        rows = rows.unionByName(_documents(spark, sf_dir).select("belge", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("sira", "satir")))
    return layout.heading_paths(rows)


def text_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every document's whole text: its size and whether it is flat."""
    rows = tree.parse(_documents(spark, sf_dir).withColumnRenamed("belge", "no"))
    return rows.select("no", "duz_metin", "madde_sayisi", F.size("kunye_satirlari").alias("kunye"), F.length("ad").alias("ad_n"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every document's whole text, bodies by length and digest."""
    rows = chunks.chunks(_documents(spark, sf_dir))
    return rows.select("chunk_id", "belge", "tur", "madde_id", F.length("govde").alias("n"), F.md5("govde").alias("ozet"), "durum", "sira")


def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document a summary and an excerpt about two words."""
    docs = readers.spread(spark, f"{sf_dir}/documents.parquet")
    asked = F.array(F.lit("ation"), F.lit("the"))
    return docs.select("doc_id", present.summary(present.without_heading(F.col("text"), F.lit(""))).alias("ozet"), present.snippet(F.col("text"), asked).alias("alinti"))


def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as plain names: marks off, letters and digits in capitals."""
    docs = readers.spread(spark, f"{sf_dir}/documents.parquet")
    plain = keys.plain_name(F.col("text"))
    return docs.select("doc_id", F.length(plain).alias("n"), F.md5(plain).alias("ad"))


def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", keys.slug(F.col("p_name")).alias("slug"))


def text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind and the tail's start of every document's whole text."""
    docs = readers.spread(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", layout.text_kind("text").alias("kova"), layout.tail_start(F.col("text")).alias("kuyruk"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"amendment_marks": mark_rows, "citation_edges": citation_edges, "heading_paths": heading_paths, "plain_names": plain_names, "part_slugs": part_slugs, "text_kinds": text_kinds, "text_trees": text_trees, "text_chunks": text_chunks, "text_snippets": text_snippets}


def oracle_sql() -> dict[str, str]:
    plain = "upper(regexp_replace(strip_accents(coalesce(text, '')), '[^A-Za-z0-9]', '', 'g'))"
    words = r"regexp_replace(trim(regexp_replace(coalesce(p_name, ''), '[^\p{L}\p{N}_\s-]', '', 'g')), '\s+', '_', 'g')"
    return {
        "plain_names": f"SELECT doc_id, cast(length({plain}) AS int) AS n, md5({plain}) AS ad FROM documents",
        "part_slugs": f"SELECT p_partkey, coalesce(nullif(substr({words}, 1, 90), ''), 'belge') AS slug FROM part",
    }
