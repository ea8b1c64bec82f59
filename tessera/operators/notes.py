"""Amendment marks, footnotes and temporary notes in article bodies.

The scans are regular expressions whose look-ahead captures what may overlap;
the rows are exploded and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import collapse, full_reference
from tessera.functions.status import DASHES, instrument, lower_tr

# The words that open a mark, what may follow them, and the spans.
KINDS = "Değişik|Ek|Mülga|İptal|Hükümsüz|Yeniden [Dd]üzenleme|mülga|değişik|iptal|hükümsüz"
OPENS = rf"(?:{KINDS})(?=[\s:.,;)\d{DASHES}/]|$)"
CLOSED, HEAD, OPEN = 240, 40, 400
FOOTNOTE = (
    r"(?s)(?:Bu\s+(?:madde|f[ıi]kra|bent|Kanun|K[.\s])[\p{L}\p{N}_]*|Anayasa\s+Mahkeme[\p{L}\p{N}_]*|\d{1,2}[./]\d{1,2}[./]\d{4}\s+[Tt]arihli\s+ve)"
    r".{0,2000}?[\p{L}\p{N}_](?:mış|miş|muş|müş)t[ıiuü]r\."
)
TEMPORARY = r"(?s)(\d{1,3})?\s*(Bu\s+(?:madde|Kanun|f[ıi]kra|bent|h[üu]k[üu]m)[\p{L}\p{N}_]*[^.]{0,90}?\d{1,2}/\d{1,2}/\d{4}\s+tarihinden\s+itibaren.{0,700}?uygulan[ıi]r\.)"
SUSPENDS = ("uygulanmaz", "uygulanmayacak", "ertelenmiş", "ertelenir", "ertelenmez")


def all_of(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(group))


def is_mark(x: Column) -> Column:
    """A mark names a date, the gazette or the constitutional court."""
    return x.rlike(r"\d{1,2}[./]\d{1,2}[./]\d{4}") | x.rlike(r"R\.?\s*G") | lower_tr(x).contains("anayasa mahkeme")


def mark_kind(word: Column) -> Column:
    low = lower_tr(word)
    return F.when(low.startswith("iptal"), "iptal").when(low.rlike("^(m[üu]lga|h[üu]k[üu]ms[üu]z)"), "mulga").when(low == "ek", "ek").otherwise("degisik")


def note_kind(x: Column) -> Column:
    """The kind of change that a footnote's last verb tells of."""
    low = F.lower(x)
    return (
        F.when(low.contains("iptal") | low.contains("hükümsüz"), "iptal")
        .when(low.contains("yürürlükten kaldırıl"), "mulga")
        .when(low.contains("eklenmiştir") & ~low.contains("değiş"), "ek")
        .otherwise("degisik")
    )


def amendment_marks(articles: DataFrame) -> DataFrame:
    """(belge, madde_id, govde) to one row a mark: sira, tur, tarih, arac, ref.

    Short closed parentheses come first; then openings that do not close within
    CLOSED characters, read up to their end or OPEN characters. A parenthesis of
    several keywords is several marks; a part without a date of its own takes the
    parenthesis's. Of equal marks in an article the first stays.
    """
    closed = all_of(F.col("govde"), rf"\(([^)]{{0,{CLOSED}}})\)", 1)
    # Captured in a look-ahead: a later opening inside the span is found too.
    still_open = all_of(F.col("govde"), rf"\((?![^)]{{0,{CLOSED - 1}}}\))(?=[^)]{{0,{HEAD}}}?(?:{KINDS}))(?=([^)]{{0,{OPEN - 1}}}))", 1)
    spans = articles.select("belge", "madde_id", F.posexplode(F.concat(closed, still_open)).alias("__i", "__span")).where(is_mark(F.col("__span")))
    parts = spans.select("*", F.posexplode(all_of(F.col("__span"), rf"(?s){OPENS}.*?(?={OPENS}|\z)")).alias("__j", "__part"))
    said = F.when(is_mark(F.col("__part")), F.col("__part")).otherwise(F.col("__span"))
    marks = parts.select("*", mark_kind(F.regexp_extract("__part", f"^({KINDS})", 1)).alias("tur"), instrument(said).alias("__x"), full_reference(said).alias("ref"))
    marks = marks.select("belge", "madde_id", "__i", "__j", "tur", "__x.tarih", "__x.arac", F.lit("metin").alias("kaynak"), "ref")
    first = Window.partitionBy("belge", "madde_id", "tur", "tarih", "arac").orderBy("__i", "__j")
    kept = marks.withColumn("__rk", F.row_number().over(first)).where("__rk = 1")
    order = Window.partitionBy("belge", "madde_id").orderBy("__i", "__j")
    return kept.withColumn("sira", F.row_number().over(order)).drop("__i", "__j", "__rk")


def footnotes(x: Column) -> Column:
    return F.transform(all_of(x, FOOTNOTE), collapse)


def temporary_notes(x: Column) -> Column:
    """array of struct(no, tur, metin): notes that suspend or date a provision,
    with the number just before them."""

    def told(z: Column) -> Column:
        text = collapse(z["b"])
        low = F.lower(text)
        halts = low.contains(SUSPENDS[0])
        for w in SUSPENDS[1:]:
            halts = halts | low.contains(w)
        return F.struct(F.coalesce(z["a"], F.lit("")).alias("no"), F.when(halts, "uygulama").otherwise("yururluk").alias("tur"), text.alias("metin"))

    a, b = all_of(x, TEMPORARY, 1).alias("a"), all_of(x, TEMPORARY, 2).alias("b")
    return F.transform(F.zip_with(a, b, lambda p, q: F.struct(p.alias("a"), q.alias("b"))), told)


def with_details(marks: DataFrame, articles: DataFrame, order: str) -> DataFrame:
    """Marks with `detay`: the first footnote of the own article, or else of the
    next one, whose full reference and kind are the mark's."""
    later = Window.partitionBy("belge").orderBy(order)
    own = articles.select("belge", "madde_id", order, footnotes(F.col("govde")).alias("__own"))
    near = own.select("belge", "madde_id", F.concat("__own", F.coalesce(F.lead("__own").over(later), F.array().cast("array<string>"))).alias("__notes"))
    fits = F.filter("__notes", lambda c: (full_reference(c) == F.col("ref")) & (note_kind(c) == F.col("tur")))
    return marks.join(near, ["belge", "madde_id"], "left").withColumn("detay", F.when(F.col("ref") != "", F.coalesce(F.get(fits, F.lit(0)), F.lit(""))).otherwise("")).drop("__notes")


def shared_notes(articles: DataFrame) -> DataFrame:
    """Temporary notes with every article of their document whose heading ends in
    a run of markers that is the note's number, or, of three digits or more,
    contains its one digit."""
    run = F.regexp_extract(F.coalesce("baslik", F.lit("")), r"(\d+)\)?\s*$", 1)
    notes = articles.select("belge", F.explode(temporary_notes(F.col("govde"))).alias("n")).select("belge", "n.*").where("no <> ''").distinct()
    heads = articles.select("belge", "madde_id", run.alias("run")).where("run <> ''")
    fits = (F.col("run") == F.col("no")) | ((F.length("run") >= 3) & (F.length("no") == 1) & F.col("run").contains(F.col("no")))
    return heads.join(notes, "belge").where(fits).select("belge", "madde_id", "no", "tur", "metin")
