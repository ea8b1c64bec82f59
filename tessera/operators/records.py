"""Ordered and nested records: neighbours, carried headings, schedules, trees,
set operations, statistics of logs; and the parsing operators on fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.status import article_status, instrument
from tessera.plans.dialect import Dialect


def next_turn(d: Dialect) -> str:
    return f"SELECT conv_id, turn, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM {d.t('conversations')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)"


def carry_heading(d: Dialect) -> str:
    """The last user turn heads the turns that follow it."""
    last = "last(h, true)" if d.spark else "last_value(h IGNORE NULLS)"
    return f"SELECT conv_id, turn, {last} OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM (SELECT *, CASE WHEN role = 'user' THEN substr(text, 1, 40) END AS h FROM {d.t('conversations')})"


def body_spans(d: Dialect) -> str:
    """A body runs from its own cut to the next one."""
    return f"SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER w - length(text) AS start, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text) AS next_n FROM {d.t('conversations')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def band_lead_attach(d: Dialect) -> str:
    """A record takes the note of its own row or, failing that, of the next."""
    return f"SELECT conv_id, turn, coalesce(own, nxt) AS note FROM (SELECT conv_id, turn, own, lead(own) OVER (PARTITION BY conv_id ORDER BY turn, text) AS nxt FROM (SELECT *, CASE WHEN length(text) > 200 THEN substr(text, 1, 30) END AS own FROM {d.t('conversations')}))"


def theta_marker_join(d: Dialect) -> str:
    """A marker run equals a note's number, or, of three digits, contains it."""
    s = d.string
    return f"""WITH m AS (SELECT event_id, user_id, cast(event_id % 1000 AS {s}) AS run FROM {d.t('events')}), n AS (SELECT DISTINCT user_id, cast(event_id % 10 AS {s}) AS no FROM {d.t('events')} WHERE event_type = 'error')
SELECT m.event_id, n.no FROM m JOIN n ON n.user_id = m.user_id AND (m.run = n.no OR (length(m.run) >= 3 AND position(n.no IN m.run) > 0))"""


def anti_known_instruments(d: Dialect) -> str:
    """Schedule rows whose instrument is not known; of equal ones the first;
    an empty instrument never suppresses."""
    return f"""WITH known AS (SELECT DISTINCT l_orderkey, l_partkey FROM {d.t('lineitem')} WHERE l_returnflag = 'R'), rows_ AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END AS arac FROM {d.t('lineitem')} WHERE l_returnflag <> 'R'),
fresh AS (SELECT r.* FROM rows_ r LEFT JOIN known k ON k.l_orderkey = r.l_orderkey AND k.l_partkey = r.arac WHERE k.l_orderkey IS NULL)
SELECT l_orderkey, l_linenumber, arac FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, arac ORDER BY l_linenumber) AS rk FROM fresh) WHERE rk = 1 OR arac IS NULL"""


def tier_join(d: Dialect) -> str:
    """Keys resolve exactly, by their base, or by the number before; the first
    tier that hits wins."""
    return f"""WITH ids AS (SELECT DISTINCT l_orderkey AS b, l_linenumber AS n FROM {d.t('lineitem')}), ask AS (SELECT o_orderkey AS b, cast(o_orderkey % 9 AS int) AS n FROM {d.t('orders')})
SELECT a.b, a.n, coalesce(x.n, y.n, z.n) AS hit, CASE WHEN x.n IS NOT NULL THEN 1 WHEN y.n IS NOT NULL THEN 2 WHEN z.n IS NOT NULL THEN 3 ELSE 0 END AS tier
FROM ask a LEFT JOIN ids x ON x.b = a.b AND x.n = a.n LEFT JOIN ids y ON y.b = a.b AND y.n = a.n % 5 LEFT JOIN ids z ON z.b = a.b AND z.n = a.n - 1"""


def tree_totals(d: Dialect) -> str:
    """Totals of a nested tree of orders and their lines."""
    if d.spark:
        return f"SELECT o.o_orderkey, size(t.lines) AS madde_sayisi, round(aggregate(t.lines, cast(0 AS double), (s, x) -> s + x.q), 4) AS toplam, size(filter(t.lines, x -> x.f = 'R')) AS mulga FROM {d.t('orders')} o JOIN (SELECT l_orderkey, array_sort(collect_list(struct(l_linenumber AS n, l_quantity AS q, l_returnflag AS f))) AS lines FROM {d.t('lineitem')} GROUP BY l_orderkey) t ON t.l_orderkey = o.o_orderkey"
    return f"SELECT o.o_orderkey, cast(count(*) AS int) AS madde_sayisi, round(sum(l_quantity), 4) AS toplam, cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS int) AS mulga FROM {d.t('orders')} o JOIN {d.t('lineitem')} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey"


def set_ops(d: Dialect) -> str:
    c, s = f"SELECT c_nationkey AS k FROM {d.t('customer')}", f"SELECT s_nationkey AS k FROM {d.t('supplier')}"
    return f"SELECT 'both' AS op, k FROM ({c} INTERSECT {s}) a UNION ALL SELECT 'customer' AS op, k FROM ({c} EXCEPT {s}) b UNION ALL SELECT 'supplier' AS op, k FROM ({s} EXCEPT {c}) e UNION ALL SELECT 'any' AS op, k FROM ({c} UNION {s}) f"


def feedback_stats(d: Dialect) -> str:
    """Counts and a half-even percentage of positive feedback."""
    pct = "cast(bround(100.0 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*)) AS int)" if d.spark else "cast(round_even(100.0 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*), 0) AS int)"
    n = lambda e: f"sum(CASE WHEN event_type = '{e}' THEN 1 ELSE 0 END)"
    return f"SELECT count(*) AS toplam_soru, {n('purchase')} AS olumlu, {n('error')} AS olumsuz, {pct} AS olumlu_oran FROM {d.t('events')}"


def domain_breakdown(d: Dialect) -> str:
    return f"SELECT event_type AS alan, count(*) AS soru, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS sira FROM {d.t('events')} GROUP BY event_type"


def corpus_counters(d: Dialect) -> str:
    """Counts by source and language, and documents of repeated text."""
    return f"SELECT source, lang, count(*) AS n, count(DISTINCT md5(text)) AS distinct_texts, sum(n_chars) AS chars FROM {d.t('documents')} GROUP BY source, lang"


def failure_runs(d: Dialect) -> str:
    """Runs of consecutive errors of a user, as gaps and islands."""
    return f"SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM {d.t('events')}) WHERE event_type = 'error' GROUP BY user_id, island"


PLANS = (next_turn, carry_heading, body_spans, band_lead_attach, theta_marker_join, anti_known_instruments, tier_join, tree_totals, set_ops, feedback_stats, domain_breakdown, corpus_counters, failure_runs)

#: Bodies of articles, one for each way to a status, which join the table's texts.
ARTICLES = (
    (-1, "Madde 1 – Bu Kanunun amacı, vergi usulünü ve mükelleflerin haklarını açık biçimde düzenlemektir ve uygulamayı göstermektir."),
    (-2, "Madde 5 – (Mülga: 12/3/2010-5950/4 md.)"),
    (-3, "Madde 20 ilâ 25 – (Mülga: 4/6/1985 - 3217/5 md.)"),
    (-4, "Madde 7 – (Mülga: 1/1/2001-4000/1 md.) (Yeniden düzenleme: 2/2/2005-5300/3 md.) Başvuru otuz gün içinde yapılır."),
    (-5, "Madde 9 – (Mülga fıkra: 1/1/2001-4000/1 md.) Kurumlar her yıl sonunda hesaplarını denetime açar ve sonuçları bir raporla bakanlığa bildirir."),
    (-6, "Madde 30 – (1) (Kaldırılan hükümler ile ilgili olup yerine işlenmiştir.)"),
    (-7, "Madde 8 – (İptal ibare: 3/3/2003) Süre otuz gündür, sonra uzar yine."),
    (-8, "Madde 11 – (İptal fıkra: 3/3/2003)"),
)
#: Notes, one for each branch of the instrument cascade, which join them too.
NOTES = (
    (-1, "(İptal: Danıştay 8. D. 3/4/2012 E:2010/1, K:2012/55)"),
    (-2, "(İptal: Anayasa Mahkemesinin 6/5/2013 tarihli E.:2012/7, K.:2013/46 sayılı kararı)"),
    (-3, "(Değişik: 2/7/2018-KHK-703/4 md.)"),
    (-4, "(Değişik: 5/5/2021-CK-2021/418)"),
    (-5, "(Ek: 10/7/2018-CK-4/2 md.)"),
    (-6, "(Ek: 1/2/1990 873 S.Karar)"),
    (-7, "(Değişik: 3/3/1999-99/12345 K.)"),
    (-8, "(Değişik: RG-5/6/2007-26543)"),
    (-9, "(Değişik: 12/3/2010-5950/4 md.)"),
    (-10, "(Ek: 5216 sayılı Kanunla)"),
    (-11, "(Mülga)"),
    (-12, "(Değişik: 12/3/2010‑5950/4 md.)"),
    (-13, "(Ek: 2/7/2018-KHK‐702/1 md.)"),
    (-14, "(Ek: KHK:5, 3/3/1999 gün ve 411 sayılı)"),
)


def _with_rows(spark: SparkSession, sf_dir: str, rows: tuple, names: str) -> DataFrame:
    """The whole texts of documents, and hand-written rows under ids below 0."""
    own = spark.createDataFrame([*rows], names)
    key, text = own.columns
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias(key), F.col("text").alias(text)).unionByName(own) if sf_dir else own


def article_statuses(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """Every document's text, and the bodies above, with status and repeal flag."""
    rows = _with_rows(spark, sf_dir, ARTICLES, "madde long, govde string")
    return rows.select("madde", article_status(F.col("govde")).alias("durum")).withColumn("mulga", F.col("durum") == "geçersiz")


def instrument_cascade(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The date and instrument of every document's text, and of the notes above."""
    rows = _with_rows(spark, sf_dir, NOTES, "no long, ham string")
    return rows.select("no", instrument(F.col("ham")).alias("x")).select("no", "x.tarih", "x.arac")


def fixtures() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"article_status": article_statuses, "instrument_cascade": instrument_cascade}
