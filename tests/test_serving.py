"""Presentation, key resolution, chunks, trees, the engine and updates on
hand-written cases."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import present, text
from tessera.operators import chunks, engine, resolve, tree
from tessera.plans.dialect import SPARK
from tessera.streaming import update


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in sorted(rows.select("i", f(F.col("x")).alias("y")).collect(), key=lambda r: r["i"])]


def test_defects(spark):
    frame = "CUMHURBAŞKANI KARARI\n12 Ağustos 2020 Çarşamba Resmî Gazete Sayısı : 31212\n" + "3 Eylül 2021 " * 6
    body = "Bu bir gövdedir ve yeterince uzundur; " * 4
    menu = "Bize Ulaşın MEVZUAT BİLGİ SİSTEMİ " + body
    rows = ["\n" * 60 + "kisa", "\n\t ÿ" + body, frame, body, menu, menu + "yürürlüğe  girer", "(cid:3)" + body, None]
    got = one(spark, lambda x: F.expr(text.defect(SPARK, "x")), *rows)
    assert got == ["bos", "encoding_cop", "iskelet", None, "menu_sayfasi", None, "cid_bozuk", "bos"]
    sized = spark.createDataFrame([(body, 10), (body, 500)], "x string, n int").select(F.expr(text.defect(SPARK, "x", "n")).alias("y"))
    assert [r["y"] for r in sized.collect()] == ["bos", None]


def test_presentation(spark):
    assert one(spark, lambda x: present.without_heading(x, F.lit("Amaç")), "Amaç\nbir\n iki", "Başka\nbir", None) == ["bir iki", "Başka bir", ""]
    assert one(spark, lambda x: present.trimmed_heading(x, F.lit("Amaç")), "Amaç \n\nbir\n iki", "bir") == ["bir\n iki", "bir"]
    assert one(spark, lambda x: present.summary(x, 5), "abcde", "abcd  fgh") == ["abcde", "abcd…"]
    assert one(spark, present.without_notes, "Süre2 uzar. 3 Bu madde, 4/5/2016 tarihli Kanunla değiştirilmiştir. Son 12 gün.") == ["Süre uzar. Son 12 gün."]
    assert one(spark, present.marked, "Madde 4 – (Ek: 1/2/2003) x") == ['<strong class="madde-no">Madde 4 –</strong> <strong class="isaret">(Ek: 1/2/2003)</strong> x']
    assert one(spark, present.domain, "Kira.", "kira hukuku", "uzay", "", None) == ["Kira", "Kira", "Diğer", "Diğer", "Diğer"]
    assert one(spark, present.base_id, "a#1/2", "a#1", "a/b#3") == ["a#1", "a#1", "a/b#3"]
    kinds = one(spark, present.line_kinds, "CEVAP:\n\nBu doğrudur [2].\nBu uzun ama dayanaksız bir cümledir.\nkısa")[0]
    assert [k["tur"] for k in kinds] == ["baslik", "bos", "dayanakli", "dayanaksiz", "kisa"]
    said = one(spark, lambda x: present.model_json(x, "terim string, atif string"), 'işte {"terim": "a", "atif": "b"} son', "yok")
    assert (said[0]["terim"], said[0]["atif"]) == ("a", "b") and (said[1] is None or said[1]["terim"] is None)
    long = "x" * 300 + " konut sahibi " + "y" * 300
    assert "konut" in one(spark, lambda x: present.snippet(x, F.array(F.lit("konutlar"))), long)[0]
    assert one(spark, lambda x: present.snippet(x, F.array(F.lit("zzz"))), long) == ["x" * 160]
    assert one(spark, present.is_menu, "x" * 900, "x", "Kanunlar Fihristi MEVZUAT BİLGİ SİSTEMİ" + "x" * 900, "Kanunlar Fihristi MEVZUAT BİLGİ SİSTEMİ Amaç" + "x" * 900) == [False, True, True, False]
    cats = spark.createDataFrame([("Yürürlük:", "b", False), ("", "Bu Kanun yayımı tarihinde yürürlüğe girer.", False), ("", "x", True), ("", "x", False)], "h string, b string, m boolean")
    assert [r["y"] for r in cats.select(present.category(F.col("h"), F.col("b"), F.col("m")).alias("y")).collect()] == ["kalip", "kalip", "mulga", "icerik"]


def test_resolve_articles(spark):
    articles = spark.createDataFrame([("b", x) for x in ("5", "Ek 3", "8", "21-1", "30-1", "30-2")], "belge string, madde_id string")
    asked = spark.createDataFrame([("b", x) for x in ("5", "ek3", "8/C", "21", "30", "99")], "belge string, madde_id string")
    got = {r["madde_id"]: (r["hedef"], r["kademe"]) for r in resolve.resolve_articles(asked, articles).collect()}
    assert got == {"5": ("5", 1), "ek3": ("Ek 3", 2), "8/C": ("8", 3), "21": ("21-1", 4), "30": (None, None), "99": (None, None)}


def test_classify(spark):
    catalogue = spark.createDataFrame([("1_1_5", "1", "Bir", 1), ("2_1_5", "2", "İki", 2), ("3_1_5", "3", "Üç", 3), ("4_1_5", "4", "Dört", 4), ("4_2_5", "4", "Denizcilik Hakkında Yönetmelik", 5), ("5_1_5", "5", "Beş", 6), ("6_1_5", "6", "Altı", 7)], "anahtar string, mevzuatNo string, mevAdi string, sira int")
    files = spark.createDataFrame(
        [("p1", "1_1_5_Bir", "x", None, 1), ("p1b", "1_1_5_Bir_eski", "x", "bos", 0), ("p2", "2_1_5_iki", "x", "bos", 2), ("p4", "4_eski", "x", None, 3), ("p4b", "4_yeni", "Denizcilik  Hakkında Yönetmelik metni", None, 4), ("p5", "5_eski", "x", None, 5)],
        "path string, ad string, metin string, kusur string, sira int",
    )
    state = spark.createDataFrame([("6_1_5", "ocr_bekliyor")], "anahtar string, durum string")
    got = {r["anahtar"]: (r["kova"], r["path"]) for r in resolve.classify(catalogue, files, state).collect()}
    assert got == {"1_1_5": ("saglam", "p1"), "2_1_5": ("bozuk", "p2"), "3_1_5": ("eksik", None), "4_1_5": ("tasinacak", "p4"), "4_2_5": ("tasinacak", "p4b"), "5_1_5": ("tasinacak", "p5"), "6_1_5": ("ocr_bekliyor", None)}


def test_pair_sources(spark):
    texts = spark.createDataFrame([("a", "1", "Deniz İş Kanunu"), ("b", "1", "Kara Yolu"), ("c", "2", "Su")], "belge string, no string, ad string")
    pdfs = spark.createDataFrame([("x", "1", "deniz iş kanunu ve ekleri", 1), ("y", "2", "Hava", 2)], "path string, no string, ad string, sira int")
    assert {(r["belge"], r["path"]) for r in resolve.pair_sources(texts, pdfs).collect()} == {("a", "x"), ("c", "y")}


def test_cross_check(spark):
    schedule = spark.createDataFrame([("b", "1", "degisik", "5950 sayılı Kanun", "x"), ("b", "1", "degisik", "4000 sayılı Kanun", "x"), ("b", "2/A", "iptal", "Anayasa Mahkemesi", "x"), ("b", "9", "iptal", "Anayasa Mahkemesi", "x")], "belge string, madde_id string, durum string, arac string, tarih string")
    inline = spark.createDataFrame([("b", "1", "5950 sayılı Kanun"), ("b", "1", "7000 sayılı Kanun"), ("b", "2", "Anayasa Mahkemesi kararı")], "belge string, madde_id string, arac string")
    assert resolve.cross_check(schedule, inline).first().asDict() == {"iki": 1, "yalniz_cizelge": 3, "yalniz_cizelge_madde_var": 1, "baglanmayan": 1, "yalniz_metin": 2}


def test_dependents_and_history(spark):
    catalogue = spark.createDataFrame([("t", "77", 1, "Deniz Kanunu", None, "Kanun"), ("s1", "1", 7, "A", "05/03/2011", "Yönetmelik"), ("s2", "2", 7, "B", "01/01/2020", "Yönetmelik"), ("s3", "3", 9, "C", None, "Tebliğ")], "anahtar string, mevzuatNo string, mevzuatTur int, mevAdi string, resmiGazeteTarihi string, mevzuatTurEnumString string")
    edges = spark.createDataFrame([(s, "t") for s in ("s1", "s2", "s3")] + [("s1", "u")], "kaynak string, hedef string")
    for said in ("77", "deniz"):
        found = resolve.search_catalogue(catalogue, said, (1,))
        rows = resolve.dependents(edges, catalogue, found)
        assert [r["kaynak"] for r in rows.orderBy("sira").collect()] == ["s2", "s1", "s3"]
    assert {(r["tur"], r["n"]) for r in resolve.type_counts(rows).collect()} == {("Yönetmelik", 2), ("Tebliğ", 1)}
    records = spark.createDataFrame([("b", "1", "ek", "2/2/2002", "x"), ("b", "1", "iptal", "3/3/2003", ""), ("b", "1", "ek", "1/1/2001", "")], "belge string, madde_id string, tur string, tarih string, arac string")
    articles = spark.createDataFrame([("b", "1", True), ("b", "2", True)], "belge string, madde_id string, mulga boolean")
    told = {r["madde_id"]: r["kayitlar"] for r in resolve.history(articles, records).collect()}
    assert [(k["tur"], k["tarih"]) for k in told["1"]] == [("iptal", "3/3/2003"), ("ek", "1/1/2001"), ("ek", "2/2/2002")] and told["2"] is None
    assert {r["madde_id"]: r["degismis"] for r in resolve.amended(articles, records).collect()} == {"1": True, "2": False}
    assert {(r["tur"], r["n"], r["arac_bos"]) for r in resolve.amendment_statistics(records, articles).collect()} == {("ek", 2, 1), ("iptal", 1, 0), ("mulga_kayitsiz", 0, 0)}


def test_schedule_rows(spark):
    table = lambda *rows: [[list(r) for r in rows]]
    pages = [("p", 1, False, table(("a", "1", "t"))), ("p", 2, True, table(("Değiştiren", "Maddeleri", "t"), ("K1", "5,\n6", "t1"))), ("p", 3, False, table(("K2", "7", "t2"), ("K3", "8"))), ("p", 4, False, []), ("p", 5, False, table(("K9", "9", "t9")))]
    df = spark.createDataFrame(pages, "path string, sayfa int, basli boolean, tablolar array<array<array<string>>>")
    assert [(r["arac"], r["maddeler"]) for r in resolve.schedule_rows(df).orderBy("sayfa", "sira").collect()] == [("K1", "5, 6"), ("K2", "7")]
    assert [r["arac"] for r in resolve.schedule_rows(df, 3).collect()] == []


def test_hits(spark):
    schema = "chunk_id string, belge string, belge_ad string, baslik string, govde string, dogru_chunk array<string>, dogru array<string>, ad_icerir array<string>, govde_icerir array<string>"
    rows = [("c1", "77_1_5", "Deniz Kanunu", "Süre", "İŞÇİ ücreti", a, b, c, d) for a, b, c, d in ((["c1"], None, None, None), (["c2"], ["77"], None, None), ([], ["77"], None, None), (None, ["77_1_5"], None, None), (None, ["7"], ["deniz"], None), (None, None, None, ["işçi"]), (None, None, None, ["x"]))]
    assert [r["isabet"] for r in resolve.hits(spark.createDataFrame(rows, schema)).collect()] == [True, False, True, True, True, True, False]


BODY = "Bu hüküm, başvuru sahiplerinin haklarını ve ödevlerini ayrıntılı biçimde gösterir ve düzenler."


def test_chunks(spark):
    law = f"ÖRNEK KANUN metninin uzunca bir künyesi burada\nMadde 1 – {BODY}\nMadde 2 – (Mülga: 4/4/2004-5100/2 md.)\n(Madde 9 – yok) Madde 3 – {BODY}  Madde 4 – {BODY}\nMadde 6 ilâ 8 – (Mülga: 4/4/2004-5100/2 md.)\nMadde 12 – 1. {BODY}\n"
    prose = f"{BODY}\n \n{BODY} iki\n\nkısa\n"
    docs = spark.createDataFrame([("a", law), ("b", prose), ("c", None), ("d", "kısa")], "belge string, text string")
    rows = chunks.chunks(docs)
    got = [(r["chunk_id"], r["tur"], r["madde_id"], r["durum"]) for r in rows.orderBy("belge", "sira").collect()]
    assert got == [("a#1", "kunye", "", None), ("a#2", "madde", "1", "geçerli"), ("a#3", "madde", "2", "geçersiz"), ("a#4", "madde", "4", "geçerli"), ("a#5", "madde", "6-8", "geçersiz"), ("a#6", "madde", "12", "geçerli"), ("b#1", "paragraf", "", "geçerli"), ("b#2", "paragraf", "", "geçerli")]
    assert {(r["tur"], r["n"]) for r in chunks.chunk_counts(rows, docs).collect()} >= {("bos_belge", 2), ("kunye", 1)}
    assert chunks.chunks(docs.limit(0)).count() == 0


def test_tree(spark):
    law = "DENİZ KANUNU\nKanun Numarası : 77\nKabul Tarihi : 1/2/1953\nBİRİNCİ BÖLÜM\nAmaç\nMADDE 1 - İlk cümle.\ndevam eder.\nKapsam\nMADDE 2 - (Mülga: 1/1/2001)\nİKİNCİ BÖLÜM\nYürürlük\nGEÇİCİ MADDE 3 - Bu Kanun yayımı tarihinde yürürlüğe girer."
    docs = spark.createDataFrame([("77", law), ("1", "düz bir metin"), ("0", None)], "no string, text string")
    got = {r["no"]: r for r in tree.parse(docs).collect()}
    r = got["77"]
    assert (r["ad"], r["kunye_satirlari"], r["madde_sayisi"], r["duz_metin"]) == ("DENİZ KANUNU", ["Kanun Numarası : 77", "Kabul Tarihi : 1/2/1953"], 3, False)
    assert [(b["baslik"], [(m["no"], m["tip"], m["baslik"], m["metin"], m["kategori"]) for m in b["maddeler"]]) for b in r["bolumler"]] == [
        ("BİRİNCİ BÖLÜM", [(1, "MADDE", "Amaç", "İlk cümle.\ndevam eder.", "icerik"), (2, "MADDE", "Kapsam", "(Mülga: 1/1/2001)", "mulga")]),
        ("İKİNCİ BÖLÜM", [(3, "GEÇİCİ", "Yürürlük", "Bu Kanun yayımı tarihinde yürürlüğe girer.", "kalip")]),
    ]
    assert r["sayim"] == {"icerik": 1, "kalip": 1, "mulga": 1}
    assert got["1"]["duz_metin"] and got["1"]["tam_metin"] == "düz bir metin" and got["0"]["madde_sayisi"] == 0


@pytest.fixture(scope="module")
def searcher(spark, tmp_path_factory):
    rows = [("10_1_5#1", "10_1_5", "madde", "Kira süresi", "Kiracı konutu boşaltır ve kirayı öder", "Konut Kanunu", False), ("10_7_5#2", "10_7_5", "madde", "Kira bedeli", "Kira bedeli yıllık artar, kira ödenir", "Konut Yönetmeliği", False), ("11_1_5#1", "11_1_5", "madde", "Vergi", "Vergi beyanı ve kira stopajı", "Vergi Kanunu", True), ("12_1_5#1", "12_1_5", "paragraf", "", "Deniz yolu taşımacılığı", "Deniz Kanunu", False)]
    rows += [(f"9{i}_1_5#1", f"9{i}_1_5", "madde", "", f"başka söz {i}", "Ek Kanun", False) for i in range(6)]
    df = spark.createDataFrame(rows, "chunk_id string, belge string, tur string, baslik string, govde string, belge_ad string, mulga boolean")
    encode = lambda texts: [[float(t.count(c)) + 0.01 for c in "kvdb"] for t in texts]
    vectors = engine.embed(df, F.col("govde"), encode, "chunk_id")
    return engine.SearchEngine(spark, df, str(tmp_path_factory.mktemp("index")), vectors, encode).build()


def test_engine(spark, searcher):
    asked = searcher.asked([(1, "kira konut"), (2, "deniz")])
    rows = searcher.lexical(asked, 10).orderBy("qid", "bm").collect()
    assert [r["chunk_id"] for r in rows if r["qid"] == 2] == ["12_1_5#1"]
    assert [r["chunk_id"] for r in rows if r["qid"] == 1][-1] == "11_1_5#1"  # repealed rows rank lower
    both = searcher.hybrid(asked, 3).collect()
    assert {r["qid"]: r["chunk_id"] for r in both if r["rk"] == 1}[1].startswith("10_")
    assert {r["tur"] for r in searcher.hybrid(asked, 5, tur="madde").collect()} == {"madde"}
    assert not any(r["mulga"] for r in searcher.hybrid(asked, 10, hide=True).collect())
    pure = searcher.vector_only(asked, 4).collect()
    assert [r["s"] for r in sorted(pure, key=lambda r: (r["qid"], r["rk"]))][:4] == sorted((r["s"] for r in pure if r["qid"] == 1), reverse=True)


def test_engine_scorer_and_bridge(spark, searcher):
    calls = []

    def bridge(q):
        calls.append(q)
        if q == "bozuk":
            raise OSError("no network")
        return q + " konut"

    score = lambda q, t: [float("bedeli" in x) for x in t]
    e = engine.SearchEngine(spark, searcher.chunks, searcher.path, searcher.vectors, searcher.encode, score, bridge, rules=lambda q: q + " deniz")
    got = e.search([(1, "kira"), (2, "bozuk")], 10).collect()
    assert {r["qid"] for r in got} == {1, 2} and e.expand("bozuk") == "bozuk deniz" and calls == ["kira", "bozuk"]
    one_ = {r["chunk_id"]: r for r in got if r["qid"] == 1}
    assert one_["10_7_5#2"]["rr"] == 1 and one_["10_1_5#1"]["rk"] == 1  # a law's weight beats the ranks


def test_rule_bridge():
    run = engine.rule_bridge([("ev sahibi", ["kiraya veren", "konut"]), ("Tahliye", ["konut", "boşaltma"]), ("yok", ["x"])])
    assert run("EV SAHİBİ tahliye konut") == ("EV SAHİBİ tahliye konut kiraya veren boşaltma", ["kiraya veren", "boşaltma"], ["ev sahibi", "Tahliye"])


def test_updates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, keys: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"anahtar": k}) for k in keys))
    seen = []

    def fetch(missing):
        keys = sorted(r["anahtar"] for r in missing.collect())
        seen.append(keys)
        return missing.select("anahtar", F.lit("metin").alias("metin"), F.when(F.col("anahtar") == "b", "bos").alias("kusur"))

    stream = lambda: spark.readStream.schema("anahtar string").json(str(tmp_path / "in"))
    put("1.json", ["a", "b", "a"])
    update.update(spark, stream(), str(tmp_path / "store"), str(tmp_path / "cp"), fetch).awaitTermination()
    put("2.json", ["a", "b", "c"])
    update.update(spark, stream(), str(tmp_path / "store"), str(tmp_path / "cp"), fetch).awaitTermination()
    assert seen == [["a", "b"], ["b", "c"]]
    log = spark.createDataFrame([("j", i, i in (0, 4)) for i in range(8)], "is_id string, sira int, basarili boolean")
    assert [(r["ilk"], r["n"]) for r in update.failure_runs(log, 3).orderBy("ilk").collect()] == [(1, 3), (5, 3)]
    frames = spark.createDataFrame([(1, True, "uzun ana metin"), (1, False, "kısa"), (1, False, "orta"), (2, True, "ana"), (2, False, " ")], "page_id int, ana boolean, metin string")
    assert {r["page_id"]: r["metin"] for r in update.longest_frame(frames).collect()} == {1: "orta", 2: "ana"}
    pair = pd.DataFrame({"a": [" ", "x"], "b": ["y", "z"]})
    assert [r["t"] for r in spark.createDataFrame(pair).select(update.fetched(F.col("a"), F.col("b")).alias("t")).collect()] == ["y", "x"]
