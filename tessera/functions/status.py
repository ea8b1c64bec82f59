"""Article status and amending instruments, as Column expressions.

Both are ordered decision lists over regular expressions with look-around, which
Spark's engine (java.util.regex) has; (?U) and (?iu) give Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and thresholds that decide an article's status.
UNITS = "ibare|f[ıi]kra|cümle|bent|paragraf|başlık|satır|tablo|tanım|bölüm|kısım|birinci|ikinci|üçüncü|dördüncü|beşinci|altıncı|yedinci|sekizinci|dokuzuncu|onuncu|son|alt|ek|dipnot|ifade|iki|üç|dört|ilk"
ROOT = "mülga|iptal|hükümsüz|ilga|kaldır"
REPEALED = rf"(?U)\(\s*(?:mülga|iptal)(?!\s*(?:{UNITS})\b)(?:\s*madde)?\s*[:\-–]"
ANEW = r"(?U)yeniden\s+düzenle"
HEADER = r"(?U)(?:MADDE|Madde|madde)\s+\d+(?:\s*/\s*[A-Za-zÇĞİÖŞÜçğıöşü])?\s*[-–—.)]"
DEAD_RANGE = r"(?U)madde\s+\d+\s*(?:il[aâ]|[-–—])\s*\d+\s*[-–—.]\s*\(?\s*(?:mülga|iptal|hükümsüz)\b[^)(]{0,12}:"
STARTS_DEAD = rf"(?U)^\s*\(\s*(?:mülga|iptal|hükümsüz)(?!\s*(?:{UNITS})\b)"
REPEALING = r"(?U)kaldırıl(?:an|acak)\s+(?:kanun\s+)?hüküm|değiştirilen\s+ve\s+(?:yürürlükten\s+)?kaldırıl|yürürlükten\s+kaldırılan\s+hüküm|yürürlükten\s+kaldırma\b|yerine\s+işlenmiş|kaldırılan\s+kanun"
DATE = r"(\d{1,2})[./](\d{1,2})[./](\d{2,4})"
STRUCTURE = ("madde", "ek", "geçici", "mükerrer", "bölüm", "kısım", "fıkra")
DEAD, LIVE, BUNDLE = 20, 60, 200
LETTERS = "A-Za-zÇĞİÖŞÜçğıöşü"


def lower_tr(x: Column) -> Column:
    """The parser's lower case: dotted and dotless i, no folding of hats."""
    return F.lower(F.translate(x, "İI", "iı"))


def after_header(x: Column) -> Column:
    """What follows the first article header; all if there is none."""
    return F.when(x.rlike(HEADER), F.regexp_replace(x, rf"(?s)^.*?{HEADER}", "")).otherwise(x)


def live_letters(x: Column) -> Column:
    """Letters of the provision that are left without header, parentheses,
    capitals and structural words."""
    body = after_header(x)
    for _ in range(6):
        body = F.regexp_replace(body, r"\([^()]*\)", " ")
    words = F.transform(F.split(body, r"(?U)\s+"), lambda w: F.regexp_replace(w, f"[^{LETTERS}]", ""))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & (w != F.upper(w)) & ~lower_tr(w).isin(*STRUCTURE))
    return F.length(F.array_join(kept, ""))


def first_date(x: Column) -> Column:
    """The first date as struct(year, month, day); two-digit years turn at 30."""
    part = lambda i: F.regexp_extract(x, DATE, i).try_cast("int")
    year = F.when(part(3) >= 100, part(3)).when(part(3) > 30, part(3) + 1900).otherwise(part(3) + 2000)
    return F.when(part(1).isNotNull(), F.struct(year.alias("y"), part(2).alias("m"), part(1).alias("d")))


def article_status(body: Column) -> Column:
    """geçerli, geçersiz or belirsiz, by the first rule that applies."""
    body = F.coalesce(body, F.lit(""))
    low, live = lower_tr(body), live_letters(body)
    dead = F.when(live > BUNDLE, "belirsiz").otherwise("geçersiz")
    tail = F.regexp_extract(low, rf"(?s)({REPEALED}.*)$", 1)
    anew = F.regexp_extract(tail, rf"(?s)^.+?({ANEW}.*)$", 1)
    t1, t2 = first_date(F.substring(tail, 1, 70)), first_date(F.substring(anew, 1, 90))
    alive = (anew != "") & (t2.isNull() | t1.isNull() | (t2 >= t1))
    return (
        F.when(low.rlike(DEAD_RANGE), dead)
        .when(~low.rlike(ROOT), "geçerli")
        .when((tail != "") & alive, "geçerli")
        .when(after_header(low).rlike(STARTS_DEAD), dead)
        .when((live <= DEAD) & low.rlike(REPEALING), "belirsiz")
        .when(live <= DEAD, "geçersiz")
        .when(live >= LIVE, "geçerli")
        .otherwise("belirsiz")
    )


# The instrument patterns, in the order they are tried.
DASHES = r"\-‐‑‒–—―−"
LONG_DATE = r"\d{1,2}[./]\d{1,2}[./]\d{4}"


def instrument(raw: Column) -> Column:
    """struct(tarih, arac): the date and the amending instrument of a note."""
    get = lambda p, i=1: F.regexp_extract(raw, p, i)
    date = F.regexp_replace(get(f"({LONG_DATE})"), r"\.", "/")
    year, low = F.substring_index(date, "/", -1), lower_tr(raw)
    rulings = F.regexp_extract_all(raw, F.lit(r"K[.:;\s]{0,4}(\d{4}/\d+)"), F.lit(1))
    same = F.filter(rulings, lambda k: (year != "") & (F.substring_index(k, "/", 1) == year))
    ruling = F.when(F.size(same) > 0, F.element_at(same, 1)).when(F.size(rulings) > 0, F.element_at(rulings, -1)).otherwise("")
    court = lambda name: F.concat(F.lit(name), F.when(ruling != "", F.concat(F.lit(" (K:"), ruling, F.lit(")"))).otherwise(""))
    said = lambda no, kind: F.concat(no, F.lit(f" sayılı {kind}"))
    sep = rf"(?U)[\s.{DASHES}/]*"
    decree = get(rf"C\.?\s*K{sep}((?:19|20)\d{{2}}/\d+|\d+)")
    number = {
        "khk": get(rf"KHK{sep}(\d+)"),
        "order": get(r"(\d+)\s*S\.?\s*Karar"),
        "long": get(r"(\d{6,9})\s*K\."),
        "ruling": F.regexp_replace(get(rf"(?U)(\d{{1,4}}/\s*\d{{2,5}})\s*(?:[{DASHES}]\s*)?(?:sayılı\s*)?(?:K\.|BKK|Karar)"), "[^0-9/]", ""),
        "cabinet": F.regexp_extract(low, r"(?U)(\d{1,2}/\d{3,5})\s+sayılı\s+bakanlar", 1),
        "council": get(r"(\d{1,4})\s*(?:No\.?\s*lu\s*)?M\.?\s*G\.?\s*K\b"),
        "law": get(rf"{LONG_DATE}\s*[{DASHES}/]*\s*(\d{{2,5}})/"),
        "bylaw": get(rf"[{DASHES}]\s*(\d{{1,2}}/\d{{3,5}})(?![\d/])"),
        "prose": get(r"(?U)(\d{2,5})\s+sayılı"),
    }
    own = F.regexp_extract_all(raw, F.lit(r"(?<!\d)(\d{4}/\d+)"), F.lit(1))
    repeated = F.filter(own, lambda k: (year != "") & (F.substring_index(k, "/", 1) == year))
    gazette = raw.rlike(r"R\.?\s*G") | raw.rlike(rf"{LONG_DATE}\s*[{DASHES}]?\s*(\d{{4,6}})(?![/\d])")
    has = lambda k: number[k] != ""
    name = (
        F.when(low.contains("danıştay") | low.contains("danistay"), court("Danıştay kararı"))
        .when(low.contains("anayasa mahkeme") | low.contains("ana. mah") | low.contains("ana.mah"), court("Anayasa Mahkemesi kararı"))
        .when(has("khk"), said(number["khk"], "KHK"))
        .when(decree.contains("/"), said(decree, "Cumhurbaşkanı Kararı"))
        .when(decree != "", said(decree, "Cumhurbaşkanlığı Kararnamesi"))
        .when(has("order"), said(number["order"], "Karar"))
        .when(has("long"), said(number["long"], "Karar"))
        .when(has("ruling"), said(number["ruling"], "Karar"))
        .when(has("cabinet"), said(number["cabinet"], "Karar"))
        .when(F.size(repeated) > 0, said(F.get(repeated, F.lit(0)), "Karar"))
        .when((year != "") & raw.rlike(r"(?<!\d)(?:19|20)\d{2}/\s*K\.?\b"), said(year, "Karar"))
        .when(has("council"), said(number["council"], "MGK Kararı"))
        .when(gazette, F.when(date != "", F.concat(F.lit("R.G. "), date)).otherwise("R.G."))
        .when(has("law"), said(number["law"], "Kanun"))
        .when(has("bylaw"), said(number["bylaw"], "Karar"))
        .when(has("prose"), said(number["prose"], "Kanun"))
        .otherwise("")
    )
    return F.struct(date.alias("tarih"), name.alias("arac"))
