"""Keys that resolve in tiers, files that are claimed once, sources that are
compared: joins by equality with the order of the tiers as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import belongs, instrument_class, strip
from tessera.functions.status import lower_tr

#: Kinds of change that end a provision.
ENDS = ("mulga", "iptal")


def resolve_articles(asked: DataFrame, articles: DataFrame) -> DataFrame:
    """asked (belge, madde_id, ...) with `hedef`, the article of that document
    which the id means, and `kademe`, the tier that found it: 1 the id itself, 2
    without spaces and case, 3 what is before a slash, 4 N for 'N-1' where 'N-2'
    does not exist. Null if none does; the lowest tier wins.
    """
    ids = articles.select("belge", F.col("madde_id").alias("id")).distinct()
    bare = lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))
    second = ids.select("belge", F.regexp_extract("id", r"^(\d+)-2$", 1).alias("n")).where("n <> ''").withColumn("two", F.lit(True))
    first = ids.select("belge", F.regexp_extract("id", r"^(\d+)-1$", 1).alias("n"), "id").where("n <> ''").join(second, ["belge", "n"], "left").where("two IS NULL")
    keys = (
        ids.select("belge", F.lit(1).alias("t"), F.col("id").alias("k"), "id")
        .unionByName(ids.groupBy("belge", bare(F.col("id")).alias("k")).agg(F.max("id").alias("id")).withColumn("t", F.lit(2)))
        .unionByName(ids.select("belge", F.lit(3).alias("t"), F.col("id").alias("k"), "id"))
        .unionByName(first.select("belge", F.lit(4).alias("t"), F.col("n").alias("k"), "id"))
    )
    said = F.col("madde_id")
    base = strip(F.substring_index(said, "/", 1))
    tiers = F.array(
        F.struct(F.lit(1).alias("t"), said.alias("k")),
        F.struct(F.lit(2).alias("t"), bare(said).alias("k")),
        F.struct(F.lit(3).alias("t"), F.when(base != said, base).alias("k")),
        F.struct(F.lit(4).alias("t"), F.when(said.rlike(r"^\d+$"), said).alias("k")),
    )
    wanted = asked.select("belge", "madde_id").distinct().select("belge", "madde_id", F.explode(tiers).alias("x")).select("belge", "madde_id", "x.t", "x.k").where("k IS NOT NULL")
    found = wanted.join(keys, ["belge", "t", "k"]).groupBy("belge", "madde_id").agg(F.min(F.struct("t", "id")).alias("y"))
    return asked.join(found.select("belge", "madde_id", F.col("y.id").alias("hedef"), F.col("y.t").alias("kademe")), ["belge", "madde_id"], "left")


def files_by_key(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, ad: the stem of the name, kusur, sira) by the key their name
    says: (anahtar, path, kusur), and those of the older form, (no, path, kusur,
    sira). A dated name counts under its plain key too; of several files under a
    plain key a sound one wins, then the first; under a dated one the last."""
    part = F.split("ad", "_")
    at = lambda i: F.coalesce(F.get(part, F.lit(i)), F.lit(""))
    new = (F.size(part) >= 4) & at(1).rlike(r"^\d+$") & at(2).rlike(r"^\d+$")
    rows = files.withColumn("__new", new)
    plain = F.concat_ws("_", at(0), at(1), at(2))
    dated = rows.where(F.col("__new") & (F.size(part) >= 5) & at(3).rlike(r"^\d{8}$")).select(F.concat_ws("_", plain, at(3)).alias("anahtar"), F.struct("sira", "path", "kusur").alias("x"))
    dated = dated.groupBy("anahtar").agg(F.max("x").alias("x"))
    own = rows.where("__new").select(plain.alias("anahtar"), F.struct(F.col("kusur").isNotNull().alias("bad"), "sira", "path", "kusur").alias("x"))
    own = own.groupBy("anahtar").agg(F.min("x").alias("x"))
    both = own.select("anahtar", "x.path", "x.kusur").unionByName(dated.select("anahtar", "x.path", "x.kusur"))
    return both.dropDuplicates(["anahtar"]), rows.where(~F.col("__new")).select(at(0).alias("no"), "path", "kusur", "sira")


def classify(catalogue: DataFrame, files: DataFrame, state: DataFrame) -> DataFrame:
    """catalogue (anahtar, mevzuatNo, mevAdi, sira) with `kova` and `path`.

    files: (path, ad, metin: the head of the text, kusur, sira); state: (anahtar,
    durum) of what an earlier run found. In order: ocr_bekliyor and metni_yok from
    the state; a file of the key's own name is saglam or, with a defect, bozuk;
    else the k-th row of a number that is still open claims the k-th file of the
    older form: bozuk if that has a defect, tasinacak if the number occurs once or
    the title is in the text, else eksik. So each file is claimed once.
    """
    by_key, old = files_by_key(files)
    held = state.groupBy("anahtar").agg(F.max(F.col("durum") == "ocr_bekliyor").alias("__ocr"), F.max(F.col("durum") == "metni_yok").alias("__none"))
    no = Window.partitionBy("mevzuatNo")
    rows = catalogue.withColumn("__only", F.count(F.lit(1)).over(no) == 1).join(held, "anahtar", "left")
    rows = rows.join(by_key.select("anahtar", F.col("path").alias("__own"), F.col("kusur").alias("__defect")), "anahtar", "left")
    waits = F.when(F.col("__ocr"), "ocr_bekliyor").when(F.col("__none"), "metni_yok")
    rows = rows.withColumn("__waits", waits).withColumn("__open", waits.isNull() & F.col("__own").isNull())
    rows = rows.withColumn("__nth", F.when(F.col("__open"), F.row_number().over(Window.partitionBy("mevzuatNo", "__open").orderBy("sira"))))
    claims = old.join(files.select("path", "metin"), "path").withColumn("__nth", F.row_number().over(Window.partitionBy("no").orderBy("sira")))
    claims = claims.select(F.col("no").alias("mevzuatNo"), "__nth", F.col("path").alias("__old"), F.col("kusur").alias("__bad"), "metin")
    rows = rows.join(claims, ["mevzuatNo", "__nth"], "left")
    mine = F.col("__only") | belongs(F.col("mevAdi"), F.col("metin"))
    kova = (
        F.coalesce(F.col("__waits"), F.when(F.col("__own").isNotNull(), F.when(F.col("__defect").isNull(), "saglam").otherwise("bozuk")))
    )
    kova = F.coalesce(kova, F.when(F.col("__old").isNull(), "eksik").when(F.col("__bad").isNotNull(), "bozuk").when(mine, "tasinacak").otherwise("eksik"))
    path = F.when(kova.isin("saglam", "bozuk", "tasinacak"), F.coalesce("__own", "__old"))
    return rows.select(*catalogue.columns, kova.alias("kova"), path.alias("path"))


def pair_sources(texts: DataFrame, pdfs: DataFrame) -> DataFrame:
    """(belge, path) of texts (belge, no, ad) and PDFs (path, no, ad, sira): of one
    number the first PDF whose folded name starts as the text's does, within 20
    characters; without one, the only PDF of the only text. An ambiguous number
    without a name is left out."""
    fold = lambda c: F.regexp_replace(lower_tr(F.coalesce(F.col(c), F.lit(""))), "[^a-zçğıöşü]", "")
    t = texts.select("belge", "no", F.substring(fold("ad"), 1, 20).alias("ta"))
    p = pdfs.select("path", "no", "sira", F.substring(fold("ad"), 1, 20).alias("pa"))
    counts = t.groupBy("no").agg(F.count(F.lit(1)).alias("nt")).join(p.groupBy("no").agg(F.count(F.lit(1)).alias("np"), F.min_by("path", "sira").alias("sole")), "no")
    same = (F.col("ta") != "") & (F.col("pa") != "") & (F.col("ta").startswith(F.col("pa")) | F.col("pa").startswith(F.col("ta")))
    named = t.join(p, "no").where(same).groupBy("belge", "no").agg(F.min_by("path", "sira").alias("named"))
    rows = t.select("belge", "no").join(counts, "no").join(named, ["belge", "no"], "left")
    path = F.coalesce("named", F.when((F.col("nt") == 1) & (F.col("np") == 1), F.col("sole")))
    return rows.select("belge", path.alias("path")).where("path IS NOT NULL")


def cross_check(schedule: DataFrame, inline: DataFrame) -> DataFrame:
    """One row of counts: iki (schedule records whose instrument the text has),
    yalniz_cizelge, yalniz_cizelge_madde_var (the article has others),
    yalniz_metin (instruments of the text that no record has) and baglanmayan
    (annulments that neither the article nor the one it belongs to tells of).

    schedule: (belge, madde_id, durum, arac, tarih), counted by record; inline:
    (belge, madde_id, arac), counted by distinct instrument.
    """
    known = inline.select("belge", "madde_id", instrument_class(F.col("arac")).alias("no")).distinct()
    rows = schedule.select("belge", "madde_id", "durum", instrument_class(F.col("arac")).alias("no"))
    has = known.select("belge", "madde_id").distinct().withColumn("has", F.lit(True))
    both = known.where("no <> ''").withColumn("hit", F.lit(True))
    court = known.where("no = 'AYM'").select("belge", F.col("madde_id").alias("at")).distinct().withColumn("aym", F.lit(True))
    rows = rows.join(both, ["belge", "madde_id", "no"], "left").join(has, ["belge", "madde_id"], "left")
    rows = rows.withColumn("base", strip(F.substring_index("madde_id", "/", 1)))
    rows = rows.join(court.withColumnRenamed("at", "madde_id"), ["belge", "madde_id"], "left").withColumnRenamed("aym", "own")
    rows = rows.join(court.withColumnRenamed("at", "base"), ["belge", "base"], "left")
    hit = F.coalesce("hit", F.lit(False))
    counts = rows.agg(
        F.count_if(hit).alias("iki"),
        F.count_if(~hit).alias("yalniz_cizelge"),
        F.count_if(~hit & F.coalesce("has", F.lit(False))).alias("yalniz_cizelge_madde_var"),
        F.count_if((F.col("durum") == "iptal") & ~F.coalesce("own", F.lit(False)) & ~F.coalesce("aym", F.lit(False))).alias("baglanmayan"),
    )
    told = schedule.select("belge", "madde_id", instrument_class(F.col("arac")).alias("no")).distinct()
    only = known.where("no <> ''").join(told, ["belge", "madde_id", "no"], "left_anti").agg(F.count(F.lit(1)).alias("yalniz_metin"))
    return counts.join(only, F.lit(True))


def amendment_statistics(records: DataFrame, articles: DataFrame) -> DataFrame:
    """(tur, n, arac_bos) by kind of change, and under `mulga_kayitsiz` the
    repealed articles (belge, madde_id, mulga) that no record ends."""
    by = records.groupBy("tur").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("tur") != "iptal") & (F.coalesce("arac", F.lit("")) == "")).alias("arac_bos"))
    ended = records.where(F.col("tur").isin(*ENDS)).select("belge", "madde_id").distinct()
    mute = articles.where("mulga").join(records.select("belge", "madde_id").distinct(), ["belge", "madde_id"], "left_semi").join(ended, ["belge", "madde_id"], "left_anti")
    return by.unionByName(mute.agg(F.count(F.lit(1)).alias("n")).select(F.lit("mulga_kayitsiz").alias("tur"), "n", F.lit(0).cast("long").alias("arac_bos")))


def search_catalogue(catalogue: DataFrame, said: str, targets: tuple[int, ...]) -> DataFrame:
    """Rows of the target types by their exact number, or by a part of the name."""
    rows = catalogue.where(F.col("mevzuatTur").isin(*targets))
    if said.isdigit():
        return rows.where(F.col("mevzuatNo").cast("string") == said)
    return rows.where(F.upper(F.coalesce("mevAdi", F.lit(""))).contains(F.upper(F.lit(said))))


def dependents(edges: DataFrame, catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """What depends on the rows found: the sources of their edges with type and
    date, the newest first, those without a date last (`sira`)."""
    meta = catalogue.select(F.col("anahtar").alias("kaynak"), "resmiGazeteTarihi", "mevzuatTurEnumString")
    rows = edges.join(found.select(F.col("anahtar").alias("hedef")).distinct(), "hedef", "left_semi").join(meta, "kaynak", "left")
    day = F.when(F.size(F.split(F.coalesce("resmiGazeteTarihi", F.lit("")), "/")) == 3, F.array_join(F.reverse(F.split("resmiGazeteTarihi", "/")), "/"))
    rows = rows.withColumn("__day", day)
    return rows.withColumn("sira", F.row_number().over(Window.partitionBy("hedef").orderBy(F.desc_nulls_last("__day"), "kaynak"))).drop("__day")


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("mevzuatTurEnumString", F.lit("?")).alias("tur")).agg(F.count(F.lit(1)).alias("n"))


def amended(sources: DataFrame, records: DataFrame) -> DataFrame:
    """sources (belge, madde_id, ...) with `degismis`, whether an amendment of the
    article is on record."""
    known = records.select("belge", "madde_id").distinct().withColumn("__known", F.lit(True))
    return sources.join(known, ["belge", "madde_id"], "left").withColumn("degismis", F.coalesce("__known", F.lit(False))).drop("__known")


def history(articles: DataFrame, records: DataFrame) -> DataFrame:
    """articles with `kayitlar`, their amendments in the order they are told: by
    kind, then by the date as it is written."""
    from tessera.functions.present import change_order

    fields = [c for c in ("tur", "tarih", "arac", "kaynak", "ref", "detay", "asil_madde") if c in records.columns]
    told = F.struct(change_order(F.col("tur")).alias("o"), F.coalesce("tarih", F.lit("")).alias("d"), F.struct(*fields).alias("r"))
    lists = records.groupBy("belge", "madde_id").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["r"]).alias("kayitlar"))
    return articles.join(lists, ["belge", "madde_id"], "left")


def first_seen(chunks: DataFrame) -> DataFrame:
    """chunks (belge, tur, seq) with `ilk`, whether it is its document's first of
    the type: where a section header goes."""
    return chunks.withColumn("ilk", F.row_number().over(Window.partitionBy("belge", "tur").orderBy("seq")) == 1)


def schedule_rows(pages: DataFrame, last_pages: int = 30) -> DataFrame:
    """Rows of amendment schedules in tables cut from PDF pages.

    pages: (path, sayfa, basli: the page has the schedule's title, tablolar:
    array of tables of rows of cells). Of the last pages, a titled one and those
    right after it with tables belong to the schedule, until a page has none; rows
    have three cells or more, and header rows go. Returns path, sayfa, sira, arac,
    maddeler, tarih.
    """
    doc = Window.partitionBy("path")
    rows = pages.withColumn("__last", F.max("sayfa").over(doc)).where(F.col("sayfa") > F.col("__last") - last_pages)
    some = F.size("tablolar") > 0
    order = doc.orderBy("sayfa")
    state = F.when(F.col("basli"), True).when(~some, False)  # titled: on; no table: off
    rows = rows.withColumn("__on", F.coalesce(F.last(state, ignorenulls=True).over(order), F.lit(False)) & some)
    cells = rows.where("__on").select("path", "sayfa", F.posexplode(F.flatten("tablolar")).alias("sira", "row"))
    cell = lambda i: strip(F.replace(F.coalesce(F.get("row", F.lit(i)), F.lit("")), F.lit("\n"), F.lit(" ")))
    out = cells.where(F.size("row") >= 3).select("path", "sayfa", "sira", cell(0).alias("arac"), cell(1).alias("maddeler"), cell(2).alias("tarih"))
    return out.where((F.col("arac") != "") & ~F.col("arac").contains("Değiştiren") & ~F.col("maddeler").contains("Maddeleri"))


def hits(results: DataFrame) -> DataFrame:
    """results (chunk_id, belge, belge_ad, baslik, govde, dogru_chunk, dogru,
    ad_icerir, govde_icerir) with `isabet`: by chunk ids alone where the question
    has any; else by the document's key or leading number, a part of its name, or
    a part of title and body."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    any_of = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    belge = F.coalesce("belge", F.lit(""))
    name = F.upper(F.coalesce("belge_ad", F.lit("")))
    text = _fold(F.concat_ws(" ", F.coalesce("baslik", F.lit("")), F.coalesce("govde", F.lit(""))))
    loose = any_of("dogru", lambda d: (belge == d) | (F.substring_index(belge, "_", 1) == d)) | any_of("ad_icerir", lambda a: name.contains(F.upper(a))) | any_of("govde_icerir", lambda a: text.contains(_fold(a)))
    return results.withColumn("isabet", F.when(some(F.col("dogru_chunk")), F.coalesce(F.array_contains("dogru_chunk", F.col("chunk_id")), F.lit(False))).otherwise(loose))


def _fold(x: Column) -> Column:
    from tessera.functions.text import HATS, PLAIN

    return F.lower(F.translate(x, HATS, PLAIN))
