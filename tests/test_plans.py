"""Every plan against its SQL on the smallest tables; fixtures by hand."""

import glob
import os

import duckdb
import pytest

from tessera.operators import records
from tessera.plans import catalog
from tessera.sources import readers

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_plan_equals_sql(spark, oracle, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    cursor = oracle.execute(catalog.oracle_sql()[name])
    order = [x[0] for x in cursor.description]
    assert sorted(order) == names
    want = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


def test_article_status(spark):
    got = {r["madde"]: r["durum"] for r in records.article_statuses(spark).collect()}
    assert got == {-1: "geçerli", -2: "geçersiz", -3: "geçersiz", -4: "geçerli", -5: "geçerli", -6: "belirsiz", -7: "belirsiz", -8: "geçersiz"}


def test_instruments(spark):
    got = [r["arac"] for r in sorted(records.instrument_cascade(spark).collect(), key=lambda r: -r["no"])]
    assert got == [
        "Danıştay kararı (K:2012/55)", "Anayasa Mahkemesi kararı (K:2013/46)", "703 sayılı KHK", "2021/418 sayılı Cumhurbaşkanı Kararı",
        "4 sayılı Cumhurbaşkanlığı Kararnamesi", "873 sayılı Karar", "99/12345 sayılı Karar", "R.G. 5/6/2007", "5950 sayılı Kanun", "5216 sayılı Kanun", "",
        "5950 sayılı Kanun", "702 sayılı KHK", "411 sayılı Kanun",
    ]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "rrf", "rk"]


def test_small_tables_are_dealt_over_all_cores_and_still_pruned(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = readers.spread(spark, path)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = rows.where("doc_id > 5").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "GreaterThan(doc_id,5)" in plan
    assert "Exchange" not in readers.spread(spark, path, 0)._jdf.queryExecution().executedPlan().toString()
