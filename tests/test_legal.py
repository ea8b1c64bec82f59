"""Keys, notes, citations, layout, readers and sinks on hand-written cases."""

import json

from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators import citations, layout, legal, notes
from tessera.sources import readers, sinks


def one(spark, f, *values):
    """f over single string columns, value by value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in sorted(rows.select("i", f(F.col("x")).alias("y")).collect())]


def test_names(spark):
    assert one(spark, keys.plain_name, "Gümrük Kanunu", "ÇAĞ ışık", None) == ["GUMRUKKANUNU", "CAGSK", ""]
    assert one(spark, keys.name_key, "Gümrük Kanununun", "GÜMRÜK KANUNU", "İthalat Rejimi Kararına") == ["GUMRUKKANUN", "GUMRUKKANUN", "ITHALATREJIMIKARAR"]
    assert one(spark, keys.slug, " Vergi, Usul  Kanunu! ", "", None) == ["Vergi_Usul_Kanunu", "belge", "belge"]
    assert one(spark, lambda x: keys.belongs(x, F.lit("T.C. Gümrük  Kanunu metni")), "GÜMRÜK KANUNU", "Orman Kanunu yok", "kısa") == [True, False, True]
    assert one(spark, keys.even_spaces, "a\xa0b\u200bc\u2028d") == ["a bc\nd"]


def test_type_hint(spark):
    got = one(spark, keys.type_hint, "Kanun Hükmünde Kararnamenin", "KANUNUN", "Cumhurbaşkanı Kararı", "başka")
    assert got == [[4], [1, 0], [20], None]


def test_cells(spark):
    got = one(spark, keys.cell_articles, "17, 52, Geçici Madde 6", "8/A", "Kanunun Adı, 1, 3", "Ek Madde 2, 5 / b", None)
    assert got == [["17", "52", "Geçici 6"], ["8/A"], ["1", "3"], ["Ek 2", "Ek 5/b"], []]
    assert one(spark, keys.effective_date, "1/1/2018 (9/7/2018)", "yayımı 2/3/2004", "yayımı") == ["9/7/2018", "2/3/2004", "yayımı"]


def test_articles(spark):
    rows = spark.createDataFrame([("Geçici ", "3", None), ("EK", "8 / A", None), (None, "20", "25"), (None, "241", "1")], "o string, a string, b string")
    got = rows.select(keys.article_id(F.col("o"), F.col("a"), F.col("b")).alias("x"), keys.true_range(F.col("a"), F.col("b")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got] == [("Geçici 3", False), ("Ek 8/A", False), ("20-25", True), ("241-1", False)]


def test_references(spark):
    names = ("Anayasa Mahkemesi kararı (K:2014/52)", "5950 sayılı Kanun", "R.G. 5/6/2007", None)
    assert one(spark, keys.instrument_id, *names) == ["AYM-2014/52", "5950", "2007", ""]
    assert one(spark, keys.instrument_class, *names) == ["AYM", "5950", "2007", ""]
    said = ("Ek: 1/1/2008-5431/9 md.", "5431 sayılı Kanunun 5 inci maddesiyle", "Anayasa Mahkemesinin K.: 2019/33", "Mülga: 1/1/2001")
    assert one(spark, keys.full_reference, *said) == ["5431/9", "5431/5", "AYM-2019/33", ""]


def test_marks(spark):
    got = [(r["madde_id"], r["sira"], r["tur"], r["tarih"], r["arac"]) for r in legal.mark_rows(spark).orderBy(F.col("madde_id").cast("int"), "sira").collect()]
    assert got == [
        ("1", 1, "degisik", "12/3/2010", "5950 sayılı Kanun"),
        ("2", 1, "ek", "1/1/2001", "4000 sayılı Kanun"),
        ("2", 2, "mulga", "2/2/2005", "5300 sayılı Kanun"),
        ("3", 1, "mulga", "3/3/2003", "4800 sayılı Kanun"),
        ("4", 1, "iptal", "6/5/2013", "Anayasa Mahkemesi kararı (K:2013/46)"),
        ("6", 1, "ek", "1/1/2001", "4000 sayılı Kanun"),
    ]


def test_footnotes(spark):
    text = "Gövde. 1 Bu maddede yer alan  “on” ibaresi, 5431 sayılı Kanunun 5 inci maddesiyle değiştirilmiştir. Son."
    assert one(spark, notes.footnotes, text) == [["Bu maddede yer alan “on” ibaresi, 5431 sayılı Kanunun 5 inci maddesiyle değiştirilmiştir."]]
    note = "son 1234 Bu madde 1/7/2012 tarihinden itibaren 8 yıl süreyle uygulanmaz. Sonra uygulanır. Bu Kanun 1/1/2013 tarihinden itibaren uygulanır."
    got = [(r["no"], r["tur"]) for r in one(spark, notes.temporary_notes, note)[0]]
    assert got == [("234", "uygulama"), ("", "yururluk")]


def test_details_and_shared_notes(spark):
    told = "Bu fıkra, 5431 sayılı Kanunun 5 inci maddesiyle değiştirilmiştir."
    note = "2 Bu madde 1/7/2012 tarihinden itibaren iki yıl uygulanmaz, sonra uygulanır."
    rows = [("b", "1", 1, "Amaç2", "(Değişik: 1/1/2008-5431/5 md.) Gövde."), ("b", "2", 2, "Kapsam (234)", told), ("b", "3", 3, "Süre 3", note)]
    articles = spark.createDataFrame(rows, "belge string, madde_id string, seq int, baslik string, govde string")
    got = notes.with_details(notes.amendment_marks(articles), articles, "seq").collect()
    assert [(r["madde_id"], r["ref"], r["detay"]) for r in got] == [("1", "5431/5", told)]
    assert {(r["madde_id"], r["no"]) for r in notes.shared_notes(articles).collect()} == {("1", "2"), ("2", "2")}


def test_windows(spark):
    verb = "dayanılarak hazırlanmıştır"
    got = one(spark, citations.windows, f"{'a' * 1000}{verb}, b {verb}", "yok", None)
    assert got[1:] == [[], []] and [len(x) for x in got[0]] == [900 + 20, 900 + 20]
    assert got[0][0].endswith("adayanılarak hazırlan") and got[0][1].endswith("b dayanılarak hazırlan")


def test_citation_edges(spark):
    got = {(r["kaynak"], r["hedef"]): (r["yontem"], r["guvenilir"]) for r in legal.citation_edges(spark).collect()}
    assert got == {
        ("s1", "k100"): ("numara", True),
        ("s2", "k4a"): ("numara+tur", True),
        ("s3", "k7a"): ("numara+ad", True),
        ("s4", "k7b"): ("numara+tertip", False),
        ("s5", "k100"): ("ad", True),
        ("s6", "k100"): ("numara", True),
    }


def test_tail(spark):
    body = "Madde 1 - " + "metin " * 100
    title = "9/3/1961 TARİHLİ VE 3/1 SAYILI TÜZÜĞE EK VE DEĞİŞİKLİK GETİREN TÜZÜKLER"
    early = "yürürlüğe koyan " + body
    late = body + "kararın yürürlüğe giriş tarihini öne alır"
    table = body + "YÜRÜRLÜĞE GİRİŞ TARİHİNİ GÖSTEREN"
    assert one(spark, layout.tail_start, body + title, early, late, table, None) == [len(body), len(early), len(late), len(body), 0]
    assert one(spark, layout.tail_kind, title, "İŞLENEMEYEN HÜKÜMLER", "\nMadde 3 - x", "x") == ["cizelge", "ek_hukum", "yanlis", "cop"]


def test_headings(spark):
    got = [(r["baslik"], r["baslik_yol"]) for r in legal.heading_paths(spark).orderBy("sira").collect()]
    assert got == [("A. Amaç", "BİRİNCİ BÖLÜM Genel Hükümler"), ("I. Kapsam", "BİRİNCİ BÖLÜM Genel Hükümler > A. Amaç"), ("", "BİRİNCİ BÖLÜM Genel Hükümler > A. Amaç > I. Kapsam"), ("B. Süre", "BİRİNCİ BÖLÜM Genel Hükümler")]


def test_readers(spark, tmp_path):
    row = lambda no, day, name: json.dumps({"mevzuatNo": no, "mevzuatTur": 1, "mevzuatTertip": "5", "resmiGazeteTarihi": day, "mevAdi": name})
    (tmp_path / "k.jsonl").write_text("\n".join([row("1", "11/02/2021", "a"), "", row("1", "12/02/2021", "b"), row("1", "12/02/2021", "c"), row("2", None, "d")]))
    got = {r["anahtar"]: r["mevAdi"] for r in readers.catalogue(spark, str(tmp_path / "k.jsonl")).collect()}
    assert got == {"1_1_5_11022021": "a", "1_1_5_12022021": "b", "2_1_5": "d"}
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n{"a": 2}\n')
    assert [r["a"] for r in readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int", strict=False).collect()] == [1, 2]
    try:
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
        raise AssertionError("a bad line has to stop a strict read")
    except Exception as e:  # noqa: BLE001
        assert "MALFORMED" in str(e).upper()
    (tmp_path / "n.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": null, "b": "y"}\n{"a": 1, "b": "z"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "n.jsonl"), "a int, b string", strict=False)
    assert [tuple(r) for r in readers.last_by_key(rows, "a").collect()] == [(1, "z")]
    for name, text in (("a", '[{"soru": "x"},\n {"soru": "y"}]'), ("b", '{"soru": "x"},\n{"soru": "y"}\n'), ("c", '{"soru":\n "x"}')):
        (tmp_path / f"{name}.json").write_text(text)
        assert [r["soru"] for r in readers.questions(spark, str(tmp_path / f"{name}.json")).orderBy("sira").collect()] == (["x"] if name == "c" else ["x", "y"])
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1_2_3_ad.txt").write_bytes("ışık".encode() + b"\xff!")
    r = readers.peek(readers.text_files(spark, str(tmp_path / "t" / "*.txt"))).first()
    assert (r["key"], r["bas"], r["size"]) == ("1_2_3_ad", "ışık!", 9)
    assert readers.optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_sinks(spark, tmp_path):
    sinks.amendments(legal.mark_rows(spark), str(tmp_path / "a"))
    got = {r["madde_id"]: [x["tur"] for x in r["kayitlar"]] for r in spark.read.json(str(tmp_path / "a")).collect()}
    assert got["2"] == ["ek", "mulga"]
    sinks.edges(legal.citation_edges(spark), str(tmp_path / "e"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).agg(F.sum("n")).first()[0] == spark.read.json(str(tmp_path / "e")).count() == 6
    rows = spark.createDataFrame([("k1", "x"), ("k2", "y")], "anahtar string, kova string")
    sinks.reports(rows, str(tmp_path / "r"), "kova")
    assert {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {"kova=x", "kova=y"}
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    sinks.table(rows, str(tmp_path / "p"), files=1)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    gone = sinks.set_aside(rows, F.col("kova") == "x")
    assert sinks.put_back(gone, F.lit(True)).where("silindi").count() == 0 and gone.where("silindi").count() == 1
    assert [r["anahtar"] for r in sinks.pending(rows, rows, F.when(F.col("kova") == "y", "bos")).collect()] == ["k2"]
