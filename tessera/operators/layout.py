"""The layout of a legal text: its tail, its kind, and its tree of headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import strip
from tessera.functions.status import LETTERS, lower_tr
from tessera.functions.text import defect
from tessera.plans.dialect import SPARK

# Article headers, the marks of a tail, and the forms of headings.
DASH = "[-‐‑‒–—―−]"
SPECIAL = r"(?:EK|Ek|ek|GEÇİCİ|Geçici|geçici|MÜKERRER|Mükerrer|mükerrer)\s+"
NUMBER = rf"\d+(?:\s*/\s*[{LETTERS}])?"
HEADER = rf"(?:{SPECIAL})?(?:MADDE|Madde|madde)\s+{NUMBER}\s*(?:{DASH}|[.)(:])"
RANGE = rf"(?:{SPECIAL})?(?:MADDE|Madde|madde)\s+{NUMBER}\s*(?:(?:il[aâ]|İL[AÂ])|[-–—])\s*{NUMBER}\s*(?:{DASH}|\.)"
ANCHORED = rf"(?m)^[ \t]*(?:[^\n]{{0,80}}?\S[ \t]{{2,}})?{HEADER}"
TAILS = ("yürürlüğe koyan", "farklı tarihte yürürlüğe giren", "yürürlüğe giren maddeler", "işlenemeyen", "ek ve değişiklik getiren")
CAPITAL_TAIL = "yürürlüğe giriş tarihini"
TAIL_TITLE = r"(?<!\d)\d{1,2}[./]\d{1,2}[./]\d{4}\s+TAR[İI]H"
SECTION = r"(?U)\b(?:BÖLÜM|KISIM|KİTAP|FASIL|AYIRIM|AYRIM)\b"
ORDINALS = "BİRİNCİ|İKİNCİ|ÜÇÜNCÜ|DÖRDÜNCÜ|BEŞİNCİ|ALTINCI|YEDİNCİ|SEKİZİNCİ|DOKUZUNCU|ONUNCU|Birinci|İkinci|Üçüncü|Dördüncü|Beşinci|Altıncı|Yedinci|Sekizinci|Dokuzuncu|Onuncu|EK|Ek|GEÇİCİ|Geçici"
NUMBERED = rf"(?U)(?:{ORDINALS})\s+(?:BÖLÜM|KISIM|KİTAP|FASIL|AYIRIM|AYRIM|Bölüm|Kısım|Kitap|Fasıl|Ayırım|Ayrım)\b"
IMPRINT = r"Yayımlandığı|Yayimlandigi|Düstur|Dustur|Resmî\s*Gazete|Resmi\s*Gazete|Tertip\s*:|Cilt\s*:|Sayfa\s*:|Sayı\s*:|Kanun\s*(?:No|Numarası)\s*:|Kabul\s*Tarihi\s*:|R\.G\."
TABLES = ("yayımlandığı resmi gazete", "değişiklik yapan", "yürürlüğe koyan", "ek ve değişiklik getiren")
LEAST_SHARE, PULL, LONGEST, RUN, PATH = 0.6, 300, 70, 8, 220


def _either(word: str) -> str:
    """A pattern for a word in any case, with dotted and dotless i apart."""
    case = {"i": "[iİ]", "ı": "[ıI]", " ": " "}
    return "".join(case.get(c, f"[{c}{c.upper()}]") for c in word)


def tail_start(text: Column) -> Column:
    """How many characters come before the tail; the text's length if none does.

    A tail starts at a mark that first occurs in the last two fifths; the mark
    that is also common prose counts only with a capital. A table's title that
    the mark stands in goes with it.
    """
    text = F.coalesce(text, F.lit(""))
    size, low = F.length(text), lower_tr(text)
    ends = size * LEAST_SHARE
    place = lambda w: F.locate(w, low) - 1
    plain = [F.when((place(w) >= 0) & (place(w) >= ends), place(w)) for w in TAILS]
    skip = F.ceil(ends).cast("int")
    late = text.substr(skip + 1, F.greatest(size - skip, F.lit(0)))
    mark = _either(CAPITAL_TAIL).replace("[yY]", "Y", 1)
    head = F.regexp_extract(late, rf"(?s)^(.*?){mark}", 1)
    capital = F.when(late.rlike(mark), skip + F.length(head))
    best = F.least(size, *plain, capital)
    low_end = F.greatest(best - PULL, F.lit(0))
    before = text.substr(low_end + 1, best - low_end)
    title = F.regexp_extract(before, rf"(?s)^(.*){TAIL_TITLE}", 1)
    rest = before.substr(F.length(title) + 1, F.length(before))
    pulled = low_end + F.length(title)
    fits = (best < size) & before.rlike(TAIL_TITLE) & rest.contains("SAYILI") & (pulled >= 0.5 * size)
    return F.when(fits, pulled).otherwise(best)


def tail_kind(tail: Column) -> Column:
    """ek_hukum, cizelge, yanlis (it holds an article) or cop."""
    low = lower_tr(tail)
    table = reduce(lambda a, w: a | low.contains(w), TABLES[1:], low.contains(TABLES[0]))
    article = tail.rlike(rf"(?m)(?:^|[^\n(]*[ \t]{{2,}}){HEADER}")
    return F.when(F.substring(low, 1, 250).contains("işlenemeyen"), "ek_hukum").when(table, "cizelge").when(article, "yanlis").otherwise("cop")


def text_kind(column: str) -> Column:
    """K5 defective, K1 articles at line starts, K3 articles elsewhere, K2 none."""
    x = F.col(column)
    return F.when(F.expr(f"({defect(SPARK, column)}) IS NOT NULL"), "K5").when(x.rlike(ANCHORED), "K1").when(x.rlike(HEADER), "K3").otherwise("K2")


def is_section(x: Column) -> Column:
    return x.rlike(SECTION) | x.rlike(NUMBERED)


def like_heading(line: Column) -> Column:
    s = strip(line)
    cut = F.regexp_replace(s, r"[\s”\"'’()\[\]{}\d]+$", "")
    digits = F.length(F.regexp_replace(s, r"\D", ""))
    return (s != "") & (F.length(s) <= LONGEST) & ~cut.rlike(r"[.;,]$") & ~s.rlike(f"^{HEADER}") & ~s.rlike(f"^{RANGE}") & ~s.rlike(IMPRINT) & (digits * 3 <= F.length(s))


def heading_level(line: Column) -> Column:
    """0 section, 1 capital letter, 2 Roman, 3 number, 4 small letter, 5 none."""
    s = strip(line)
    return (
        F.when(is_section(s), 0)
        .when(s.rlike(r"^(?:[IVXLCDM]{2,}|[IVX])[.)]\s"), 2)
        .when(s.rlike(r"^[A-ZÇĞİÖŞÜ][.)]\s"), 1)
        .when(s.rlike(r"^\d+[.)]\s"), 3)
        .when(s.rlike(r"^[a-zçğıöşü][.)]\s"), 4)
        .otherwise(5)
    )


def heading_paths(lines: DataFrame) -> DataFrame:
    """(belge, sira, satir) to one row an article: belge, sira, baslik, baslik_yol.

    Headings are the up to RUN lines right above an article. A heading holds
    until one of its level or above; a first line without a number joins the
    section just above it, unless it is the article's own heading. The stack is
    read off running windows: of each level the last heading, if it came after
    the last of every level above.
    """
    doc = Window.partitionBy("belge").orderBy("sira")
    after = doc.rowsBetween(1, Window.unboundedFollowing)
    so_far, before = doc.rowsBetween(Window.unboundedPreceding, 0), doc.rowsBetween(Window.unboundedPreceding, -1)
    s = strip(F.col("satir"))
    rows = lines.select("belge", "sira", s.alias("satir"), (s.rlike(f"^{HEADER}") | s.rlike(f"^{RANGE}")).alias("article"), like_heading(F.col("satir")).alias("head"))
    rows = rows.withColumn("at", F.row_number().over(doc))
    rows = rows.withColumn("stop", F.first(F.when(~F.col("head"), F.struct("at", "article")), ignorenulls=True).over(after))
    gap = F.col("stop.at") - F.col("at")
    rows = rows.withColumn("head", F.col("head") & F.coalesce(F.col("stop.article") & (gap <= RUN), F.lit(False))).withColumn("own", F.col("head") & (gap == 1))
    rows = rows.where("head OR article").withColumn("level", F.when(F.col("head"), heading_level(F.col("satir"))))
    above = F.last(F.col("level"), ignorenulls=True).over(before)
    rows = rows.withColumn("joins", F.col("head") & (F.col("level") == 5) & ~F.col("own") & F.coalesce(above == 0, F.lit(False)))
    rows = rows.withColumn("baslik", F.when(F.lag("own").over(doc) & (F.lag("level").over(doc) != 0), F.lag("satir").over(doc)))
    held = F.col("head") & ~F.col("joins")
    for k in range(6):
        rows = rows.withColumn(f"h{k}", F.last(F.when(held & (F.col("level") == k), F.struct("at", "satir")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("more", F.last(F.when(F.col("joins"), F.struct("at", "satir")), ignorenulls=True).over(so_far))

    def entry(k: int) -> Column:
        h, ok = F.col(f"h{k}"), F.col(f"h{k}").isNotNull()
        for j in range(k):
            ok = ok & (F.col(f"h{j}").isNull() | (h["at"] > F.col(f"h{j}")["at"]))
        text = h["satir"]
        if k == 0:
            text = F.when(F.col("more.at") > h["at"], F.concat_ws(" ", text, F.col("more.satir"))).otherwise(text)
        return F.when(ok, text)

    path = F.array_compact(F.array(*map(entry, range(6))))
    last = (F.size(path) > 0) & (F.element_at(path, -1) == F.col("baslik"))
    path = F.when(last, F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path)
    return rows.where("article").select("belge", "sira", F.coalesce("baslik", F.lit("")).alias("baslik"), F.substring(F.array_join(path, " > "), 1, PATH).alias("baslik_yol"))
