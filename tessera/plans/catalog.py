"""All plans of the library by name, for Spark and for the SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import corpus, legal, records, retrieval
from tessera.plans import index
from tessera.plans.dialect import ORACLE, SPARK, tables
from tessera.sources import readers
from tessera.streaming import logs

PLANS = {f.__name__: f for m in (retrieval, corpus, records) for f in m.PLANS}

#: Tables of whole texts, over which expressions cost far more than an exchange.
TEXTS = ("documents", "pages")


def run(plan) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = plan(SPARK)
        names = tables(sql)
        # What reads the index does little to the texts themselves.
        dear = () if any(name in index.PARTS for name in names) else TEXTS
        for name in names:
            if name in index.PARTS:
                spark.read.parquet(f"{index.build(spark, sf_dir)}/{name}").createOrReplaceTempView(f"tessera_{name}")
                continue
            path = f"{sf_dir}/{name}.parquet"
            rows = readers.spread(spark, path) if name in dear else spark.read.parquet(path)
            rows.createOrReplaceTempView(f"tessera_{name}")
        return spark.sql(sql)

    query.__doc__ = plan.__doc__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(plan) for name, plan in PLANS.items()} | logs.queries() | records.fixtures() | legal.queries()


def oracle_sql() -> dict[str, str]:
    return {name: plan(ORACLE) for name, plan in PLANS.items()} | logs.oracle_sql() | legal.oracle_sql()
