"""Text functions of legal search, as SQL expressions."""

from __future__ import annotations

from tessera.plans.dialect import Dialect

# The folded vowels, suffixes, stop words and word alphabet of the
# search index, and the markers, patterns and thresholds of the quality gate.
HATS, PLAIN = "ÂâÎîÛûİI", "aaiiuuiı"
ALPHABET = "[0-9a-zçğıöşü]+"
SUFFIXES = (
    "larını", "lerini", "larının", "lerinin", "ları", "leri", "ların", "lerin", "lara", "lere",
    "ndan", "nden", "tan", "ten", "dan", "den", "nın", "nin", "nun", "nün", "ının", "inin",
    "sını", "sini", "sının", "sinin", "yla", "yle", "ile", "lar", "ler", "da", "de", "ta", "te",
    "sı", "si", "su", "sü", "yı", "yi", "yu", "yü", "ın", "in", "un", "ün", "ı", "i", "u", "ü", "a", "e",
)
STOP = ("ve", "veya", "ya", "da", "de", "ki", "mi", "mı", "mu", "mü", "bir", "bu", "şu", "o", "ile", "için", "gibi", "ama", "en", "olabilir", "olur", "olan", "midir", "mıdır")
PLACEHOLDERS = ("güncelleme çalışmaları devam etmektedir", "guncelleme calismalari devam etmektedir", "işlenmemiştir", "islenmemistir", "henüz işlenmemiş")
MENU = ("Kanunlar Fihristi", "Cumhurbaşkanlığı Kararnameleri Fihristi", "Yönetmelikler Fihristi", "MEVZUAT BİLGİ SİSTEMİ", "Tüm Hakları Saklıdır", "Bize Ulaşın", "Hukuk ve Mevzuat Genel Müdürlüğü")
BODY = r"(MADDE\s*\d|BÖLÜM|karar\s+verilmiştir|karar\s+verilmesi|yürürlüğe\s+girer|hükümlerini\s+yürüt|dayanılarak\s+hazırlan|amaç\s+ve\s+kapsam)"
FRAME = (
    r"\d{1,2}\s+\w+\s+\d{4}\s+\w+\s*Resm.?\s*Gazete\s*Say.s.\s*:?\s*\d+",
    r"Resm.?\s*Gazete\s*(Tarihi|Say.s.)\s*:?\s*[\d\.\/]+",
    r"CUMHURBA\w?KANI\s*(KARARI|KARARNAMES.|GENELGES.)?",
    r"Karar\s*Say.s.\s*:?\s*\d+",
    r"Genelge\s*(No|Say.s.)\s*:?\s*[\d\/]+",
    r"Recep\s+Tayyip\s+ERDO\w+AN",
    r"\d{1,2}\s+\w+\s+\d{4}",
    r"Say.\s*:?\s*\d+",
    r"(Yönetmelik|Karar|Tebli.|Mevzuat|Madde|Genelge)(Adı|Metni)\s*[–—-]?\s*\d*",
)
LEAST_TEXT, LEAST_BODY, HEAD = 50, 80, 2500
#: White space at the ends of a text, of any script.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def fold(x: str) -> str:
    """Lower case that keeps dotless i and folds hats (index variant)."""
    return f"lower(translate({x}, '{HATS}', '{PLAIN}'))"


def tokens(d: Dialect, x: str) -> str:
    return d.all(fold(f"coalesce({x}, '')"), ALPHABET)


def stem(d: Dialect, x: str) -> str:
    """The longest suffix goes once, if four letters stay: a reluctant head
    leaves the longest tail."""
    tail = "|".join(SUFFIXES)
    head = d.find(x, f"^(.{{4,}}?)({tail})$", 1)
    return f"CASE WHEN {head} <> '' THEN {head} ELSE {x} END"


def stripped(d: Dialect, x: str) -> str:
    """Without white space of any kind at both ends."""
    return f"trim(BOTH '{WHITE}' FROM {x})" if d.spark else f"trim({x}, '{WHITE}')"


def unicode_words(d: Dialect, pattern: str) -> str:
    """A pattern, of any case, whose word characters are those of all scripts."""
    return f"(?iuU){pattern}" if d.spark else "(?i)" + pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\s", r"[\s\x{00A0}]")


def defect(d: Dialect, x: str, size: str | None = None) -> str:
    """The first defect of a document's text, or null; size: the file's bytes."""
    s = stripped(d, f"coalesce({x}, '')")
    head = f"substr({s}, 1, {HEAD})"
    some = lambda words, y: " OR ".join(f"position('{w}' IN {y}) > 0" for w in words)
    menu = " + ".join(f"(CASE WHEN position('{w}' IN {head}) > 0 THEN 1 ELSE 0 END)" for w in MENU)
    body = s
    for p in FRAME:
        body = d.sub(body, unicode_words(d, p), " ")
    body = d.sub(body, r"[^\p{L}\p{N}\p{M}]+", "")
    text = unicode_words(d, BODY)
    small = f"{size} < {LEAST_TEXT} OR " if size else ""
    return f"""CASE WHEN {small}length({s}) < {LEAST_TEXT} THEN 'bos'
 WHEN position('(cid:' IN {head}) > 0 THEN 'cid_bozuk'
 WHEN substr({s}, 1, 1) = 'ÿ' OR position('h#t#m#l' IN {head}) > 0 THEN 'encoding_cop'
 WHEN {some(PLACEHOLDERS, f"lower({head})")} THEN 'metin_pdfte'
 WHEN ({menu}) >= 2 AND NOT {d.like(head, text)} THEN 'menu_sayfasi'
 WHEN length({body}) < {LEAST_BODY} THEN 'iskelet' END"""


def garbled(d: Dialect, x: str) -> str:
    """Whether a passage reads like a broken table."""
    s = f"coalesce({x}, '')"
    letters = f"length({d.sub(s, chr(92) + 'P{L}', '')})"
    note = f"({d.like(s, r'\(\s*([Mm][üu]lga|[Dd]eğişik|[Ee]k|[İi]ptal)')} AND length({s}) < 220)"
    marks = d.like(s, r"(olol|lolo|\|\s*o\s*\||\d{6,})")
    return f"(length({s}) >= 40 AND NOT {note} AND ({marks} OR (length({s}) > 220 AND {letters} < 0.45 * length({s}))))"
