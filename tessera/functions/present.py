"""What a reader sees of a result: snippets, summaries, cleaned and marked bodies,
domains and grounded lines, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.keys import collapse, strip
from tessera.functions.status import LETTERS, lower_tr
from tessera.functions.text import ALPHABET, HATS, PLAIN

# Widths of excerpts, footnotes that a body is shown without, the
# marks that are shown bold, old menu marks, stock headings, domains.
SNIPPET, SUMMARY, SHORT = 160, 280, 200
FOOTNOTE = (
    r"(?s)(?U)\s*(?:\d{1,3}\s+)?(?:Bu\s+(?:madde|f[ıi]kra|bent|Kanun|K[.\s])\w*|Anayasa\s+Mahkeme\w*|\d{1,2}/\d{1,2}/\d{4}\s+[Tt]arihli\s+ve)"
    r".{0,2000}?(?:\w(?:mış|miş|muş|müş)t[ıiuü]r|bakınız)\."
)
FOR_A_TIME = r"(?s)(?U)\s*(?:\d{1,3}\s+)?Bu\s+madde\s+\d{1,2}/\d{1,2}/\d{4}\s+tarihinden\s+itibaren.{0,500}?uygulan[ıi]r\."
BOLD_MARK = r"(?U)(\((?:Değişik|Ek|Mülga|İptal|Yeniden düzenleme)\b[^)]*?\d[^)]*?\))"
BOLD_HEAD = r"((?:(?:EK|GEÇİCİ|MÜKERRER|Ek|Geçici|Mükerrer)\s+)?(?:MADDE|Madde)\s+\d+(?:/[A-Za-zÇĞİÖŞÜ])?\s*[–\-])"
OLD_MENU = ("MEVZUAT BİLGİ SİSTEMİ", "Kanunlar Fihristi", "Cumhurbaşkanlığı Kararnameleri Fihristi")
OLD_CONTENT, OLD_LEAST = ("MADDE", "Madde", "BÖLÜM", "Amaç"), 900
STOCK = ("yürürlük", "yürütme", "yürürlük ve yürütme")
STOCK_TEXT = r"(?iuU)(yürürlüğe\s+girer|hükümlerini.{0,80}yürütür)"
DOMAINS = (
    "Aile", "Miras", "Kira", "Gayrimenkul", "Borçlar/Sözleşme", "Ticaret/Şirket", "İcra-İflas", "İş Hukuku", "SGK/Sosyal Güvenlik",
    "Ceza", "Ceza Muhakemesi", "İnfaz", "Tüketici", "Vergi", "Bankacılık", "Fikri Mülkiyet", "İdare", "İmar", "Kişiler/Vatandaşlık",
    "Kat Mülkiyeti", "Bilişim", "Askerlik", "İş Sağlığı-Güvenliği", "Diğer",
)
OTHER = "Diğer"
#: Order in which the changes of an article are told.
CHANGES = ("iptal", "uygulama", "mulga", "ek", "degisik")


def normal_words(x: Column) -> Column:
    """The index's tokens, one space between."""
    low = F.lower(F.translate(F.coalesce(x, F.lit("")), HATS, PLAIN))
    return F.array_join(F.regexp_extract_all(low, F.lit(ALPHABET), F.lit(0)), " ")


def snippet(body: Column, tokens: Column, width: int = SNIPPET) -> Column:
    """An excerpt about the earliest of the tokens (an array), found by their
    first five letters in the normal text and carried over in proportion."""
    body, low = F.coalesce(body, F.lit("")), normal_words(body)
    at = F.array_min(F.filter(F.transform(tokens, lambda t: F.locate_in(low, t)), lambda p: p > 0)) if hasattr(F, "locate_in") else F.array_min(F.filter(F.transform(tokens, lambda t: F.call_function("locate", F.substring(t, 1, 5), low)), lambda p: p > 0))
    middle = F.floor((at - 1) / F.greatest(F.length(low), F.lit(1)) * F.length(body)).cast("int")
    start = F.greatest(middle - width // 2, F.lit(0))
    return collapse(F.when(at.isNull(), F.substring(body, 1, width)).otherwise(body.substr(start + 1, F.lit(width))))


def _first_line(x: Column) -> Column:
    return F.substring_index(x, "\n", 1)


def repeats_heading(body: Column, heading: Column) -> Column:
    said = strip(F.coalesce(heading, F.lit("")))
    return (F.coalesce(heading, F.lit("")) != "") & (strip(_first_line(F.coalesce(body, F.lit("")))) == said)


def _rest(body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    return body.substr(F.length(_first_line(body)) + 2, F.greatest(F.length(body), F.lit(1)))


def without_heading(body: Column, heading: Column) -> Column:
    """One line of a body, without a first line that repeats its heading."""
    return collapse(F.when(repeats_heading(body, heading), _rest(body)).otherwise(F.coalesce(body, F.lit(""))))


def trimmed_heading(body: Column, heading: Column) -> Column:
    """The same with its lines kept."""
    return F.when(repeats_heading(body, heading), F.regexp_replace(_rest(body), r"^\n+", "")).otherwise(F.coalesce(body, F.lit("")))


def summary(x: Column, most: int = SUMMARY) -> Column:
    cut = F.regexp_replace(F.substring(x, 1, most), r"(?U)\s+$", "")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut, F.lit("…")))


def without_notes(body: Column) -> Column:
    """A body without footnotes and without numbers stuck to its words."""
    out = F.regexp_replace(F.coalesce(body, F.lit("")), FOOTNOTE, " ")
    out = F.regexp_replace(out, FOR_A_TIME, " ")
    out = F.regexp_replace(out, rf"(?<=[{LETTERS}])\d{{1,3}}(?=[\s.,;:)\]]|$)", "")
    return F.regexp_replace(out, r"[ \t]{2,}", " ")


def marked(html: Column) -> Column:
    """Amendment marks and article numbers in bold."""
    out = F.regexp_replace(html, BOLD_MARK, '<strong class="isaret">$1</strong>')
    return F.regexp_replace(out, BOLD_HEAD, '<strong class="madde-no">$1</strong>')


def is_menu(x: Column) -> Column:
    """The older test: too short, or menu marks and no content."""
    seen = sum((x.contains(w).cast("int") for w in OLD_MENU), F.lit(0))
    content = F.lit(False)
    for w in OLD_CONTENT:
        content = content | x.contains(w)
    return F.coalesce((F.length(x) < OLD_LEAST) | ((seen >= 2) & ~content), F.lit(True))


def category(heading: Column, body: Column, repealed: Column) -> Column:
    """mulga, kalip (a stock provision) or icerik."""
    head = F.regexp_replace(lower_tr(strip(F.coalesce(heading, F.lit("")))), ":+$", "")
    stock = head.isin(*STOCK) | ((F.length(body) < SHORT) & body.rlike(STOCK_TEXT))
    return F.when(repealed, "mulga").when(stock, "kalip").otherwise("icerik")


def domain(said: Column) -> Column:
    """The domain that an answer names: exactly, or one within the other, in the
    list's order; else OTHER."""
    low = F.lower(F.regexp_replace(strip(F.coalesce(said, F.lit(""))), r"^\.+|\.+$", ""))
    out = F.lit(OTHER)
    for d in reversed(DOMAINS):
        name = F.lower(F.lit(d))
        out = F.when(low.contains(name) | name.contains(low), d).otherwise(out)
    for d in DOMAINS:
        out = F.when(low == F.lower(F.lit(d)), d).otherwise(out)
    return F.when(low == "", OTHER).otherwise(out)


def line_kinds(answer: Column) -> Column:
    """array of struct(satir, tur): heading, grounded (it cites), ungrounded
    (longer than 18 characters without a citation), short or empty lines."""

    def kind(line: Column) -> Column:
        said = strip(line)
        return (
            F.when(said == "", "bos")
            .when(line.rlike(r"(?iu)^\s*(İLGİLİ MADDELER|CEVAP|Eksik kalan nokta)\s*:?"), "baslik")
            .when(line.rlike(r"\[\d{1,3}\]"), "dayanakli")
            .when(F.length(said) > 18, "dayanaksiz")
            .otherwise("kisa")
        )

    return F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.struct(x.alias("satir"), kind(x).alias("tur")))


def change_order(kind: Column) -> Column:
    """The place of a kind of change; kinds that are not known come last."""
    out = F.lit(9)
    for i, k in enumerate(CHANGES):
        out = F.when(kind == k, i).otherwise(out)
    return out


def base_id(chunk: Column) -> Column:
    """The id of the whole chunk that a part belongs to."""
    part = F.element_at(F.split(chunk, "#"), -1)
    return F.when(part.contains("/"), F.substring_index(chunk, "/", 1)).otherwise(chunk)


def model_json(said: Column, schema: str) -> Column:
    """The object between the first { and the last } of a model's words; null if
    it is none."""
    return F.from_json(F.regexp_extract(F.coalesce(said, F.lit("")), r"(?s)\{.*\}", 0), schema)
