"""Names, keys, article numbers and references, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.status import LETTERS, lower_tr


def _bases() -> dict[str, str]:
    """Latin letters with marks and their base, by compatibility decomposition."""
    out = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(c):
            out[chr(c)] = base
    return out


BASES = _bases()
#: Ligatures and what they are made of, by the same rule.
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
# Spaces that become one space, and marks that vanish.
SPACES = "\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u180e"
GONE = "\xad\u200b\u200c\u200d\ufeff"
BREAKS = "\u2028\u2029"
# Types of documents that a wording hints at, in the order tried.
HINTS = (
    (r"Kanun\s+H[üu]km[üu]nde\s+Kararname", (4,)),
    (r"Cumhurba[şs]kanl[ıi][ğg][ıi]\s+Kararname|Kararname", (19, 4)),
    (r"Cumhurba[şs]kan[ıi]\s+Karar[ıi]", (20,)),
    (r"T[üu]z[üu][ğgk]", (2, 6, 17)),
    (r"Kanun", (1, 0)),
)
ORDINAL = "(?:inci|ıncı|uncu|üncü|nci|ncı)"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def even_spaces(x: Column) -> Column:
    """Every kind of space, break and invisible mark as the plain one or none."""
    return F.translate(F.translate(F.translate(x, SPACES, " " * len(SPACES)), BREAKS, "\n" * len(BREAKS)), GONE, "")


def unbound(x: Column) -> Column:
    """Ligatures opened, unbreakable spaces plain."""
    for k, v in LIGATURES.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return F.translate(x, "\u00a0", " ")


def without_marks(x: Column) -> Column:
    base = F.translate(unbound(x), "".join(BASES), "".join(BASES.values()))
    return F.regexp_replace(base, r"\p{M}+", "")


def plain_name(x: Column) -> Column:
    """Capital ASCII letters and digits; marks, dotless i and the rest go."""
    return F.upper(F.regexp_replace(without_marks(F.coalesce(x, F.lit(""))), "[^A-Za-z0-9]", ""))


def name_key(x: Column) -> Column:
    """The plain name without the case ending of its last noun."""
    return F.regexp_replace(plain_name(x), r"(KANUN|KARARNAME|KARAR)\w{0,8}$", "$1")


def slug(x: Column, most: int = 90) -> Column:
    words = F.regexp_replace(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[^\w\s-]", "")), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.substring(words, 1, most), F.lit("")), F.lit("belge"))


def belongs(title: Column, text: Column) -> Column:
    """Whether a text's head has the start of its title; short titles say nothing."""
    mark = F.substring(plain_name(title), 1, 20)
    return (F.length(mark) < 12) | plain_name(F.substring(text, 1, 2500)).contains(mark)


def names_overlap(said: Column, title: Column) -> Column:
    a, b = name_key(said), name_key(title)
    return (a != "") & (F.length(b) >= 8) & (a.contains(F.substring(b, 1, 16)) | b.contains(F.substring(a, 1, 16)))


def type_hint(x: Column) -> Column:
    """The types that the first fitting wording names; null if none does."""
    out = F.lit(None)
    for pattern, kinds in reversed(HINTS):
        out = F.when(x.rlike(f"(?iu){pattern}"), F.array(*map(F.lit, kinds))).otherwise(out)
    return out


def article_id(special: Column, number: Column, to: Column) -> Column:
    """'Geçici 3', '8/A' or, of a range, '20-25'."""
    kind = lower_tr(strip(F.coalesce(special, F.lit(""))))
    head = F.when(kind == "ek", "Ek ").when(kind == "geçici", "Geçici ").when(kind == "mükerrer", "Mükerrer ").otherwise("")
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return F.concat(head, bare(number), F.when(to.isNotNull(), F.concat(F.lit("-"), bare(to))).otherwise(""))


def true_range(number: Column, to: Column) -> Column:
    """A range ends above its start; otherwise its end is a paragraph's number."""
    n = lambda x: F.regexp_extract(strip(x), r"^(\d+)", 1).try_cast("long")
    return F.coalesce(n(to) > n(number), F.lit(False))


def cell_articles(cell: Column) -> Column:
    """The article ids of a schedule's cell. 'Geçici Madde', 'Ek Madde' and
    'Mükerrer Madde' hold for all that follows them in the cell."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), ","), strip)

    def step(state: Column, p: Column) -> Column:
        low = F.lower(p)
        said = F.when(low.contains("geçici madde"), "Geçici ").when(low.contains("ek madde"), "Ek ").when(low.contains("mükerrer madde"), "Mükerrer ")
        rest = F.when(said.isNotNull(), strip(F.regexp_replace(p, r"^.*?[Mm]adde", ""))).otherwise(p)
        number = F.regexp_replace(F.regexp_extract(rest, rf"(?U)^(\d+(?:\s*/\s*[{LETTERS}])?)", 1), r"(?U)\s+", "")
        head = F.coalesce(said, state["head"])
        return F.struct(head.alias("head"), F.when(number != "", F.array_append(state["out"], F.concat(head, number))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit("").alias("head"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, start, step, lambda s: s["out"])


def effective_date(cell: Column) -> Column:
    """The last date in parentheses, else the first date, else the cell's start."""
    in_parens = F.regexp_extract_all(cell, F.lit(r"\((\d{1,2}/\d{1,2}/\d{4})\)"), F.lit(1))
    first = F.regexp_extract(cell, r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.when(F.size(in_parens) > 0, F.element_at(in_parens, -1)).when(first != "", first).otherwise(F.substring(F.coalesce(cell, F.lit("")), 1, 40))


def _ruling(x: Column) -> Column:
    return F.regexp_extract(x, r"[kK]\.?\s*:?\s*(\d{4}/\d+)", 1)


def instrument_id(name: Column) -> Column:
    """A ruling of the constitutional court by its number, else the first number."""
    name, ruling = F.coalesce(name, F.lit("")), _ruling(F.coalesce(name, F.lit("")))
    court = F.when(ruling != "", F.concat(F.lit("AYM-"), ruling)).otherwise("AYM")
    numbered = F.regexp_extract(name, r"(?U)(\d+)\s*sayılı", 1)
    return F.when(F.lower(name).contains("anayasa mahkeme"), court).when(numbered != "", numbered).otherwise(F.regexp_extract(name, r"(\d{2,})", 1))


def instrument_class(name: Column) -> Column:
    """As instrument_id, with all rulings of the constitutional court as one."""
    found = instrument_id(name)
    return F.when(found.startswith("AYM"), "AYM").otherwise(found)


def full_reference(x: Column) -> Column:
    """Law and amending article with a slash between, or AYM- and the ruling; empty if not whole."""
    ruling = _ruling(x)
    pair = lambda p: F.when(x.rlike(p), F.concat(F.regexp_extract(x, p, 1), F.lit("/"), F.regexp_extract(x, p, 2)))
    return (
        F.when(lower_tr(x).contains("anayasa mahkeme"), F.when(ruling != "", F.concat(F.lit("AYM-"), ruling)).otherwise(""))
        .otherwise(F.coalesce(pair(r"(\d{2,5})/(\d+)\s*md"), pair(rf"(?U)(\d{{2,5}})\s*sayılı[^.]{{0,45}}?(\d+)\s*{ORDINAL}\s*madde"), F.lit("")))
    )


def document_url(base: str, url: Column, kind: Column, series: Column, number: Column) -> Column:
    """The catalogue's own address of a PDF, else the one its key makes."""
    u = F.trim(F.coalesce(url, F.lit("")))
    own = F.when(u.startswith("http"), u).otherwise(F.concat(F.lit(f"{base}/"), F.regexp_replace(u, "^/+", "")))
    made = F.concat(F.lit(f"{base}/MevzuatMetin/"), F.concat_ws(".", kind.cast("string"), series, number), F.lit(".pdf"))
    return F.when(F.lower(u).endswith(".pdf"), own).otherwise(made)
