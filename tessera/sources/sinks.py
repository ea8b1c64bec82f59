"""Sinks: chunks, amendments, edges with their summary, logs, reports, removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(rows: DataFrame, path: str) -> None:
    """Chunks as JSON lines, replacing what was there."""
    rows.write.mode("overwrite").json(path)


def table(rows: DataFrame, path: str, files: int | None = None) -> None:
    """A Parquet table; `files` compacts it without a shuffle."""
    (rows.coalesce(files) if files else rows).write.mode("overwrite").parquet(path)


def amendments(records: DataFrame, path: str) -> None:
    """One JSON line an article, with its records nested in their order."""
    fields = [c for c in records.columns if c not in ("belge", "madde_id", "sira")]
    ordered = F.array_sort(F.collect_list(F.struct("sira", F.struct(*fields).alias("r"))))
    nested = records.groupBy("belge", "madde_id").agg(F.transform(ordered, lambda x: x["r"]).alias("kayitlar"))
    nested.write.mode("overwrite").json(path)


def edges(rows: DataFrame, path: str, summary: str) -> None:
    """Edges as JSON lines, and counts by relation and method beside them."""
    rows.write.mode("overwrite").json(path)
    rows.groupBy("iliski", "yontem").agg(F.count(F.lit(1)).alias("n"), F.count_if("guvenilir").alias("guvenilir")).write.mode("overwrite").json(summary)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def reports(rows: DataFrame, path: str, bucket: str) -> None:
    """One folder a bucket."""
    rows.write.mode("overwrite").partitionBy(bucket).json(path)


def set_aside(rows: DataFrame, condition: Column) -> DataFrame:
    """A removal that can be undone: the rows stay and are marked."""
    return rows.withColumn("silindi", F.coalesce(condition, F.lit(False)))


def put_back(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.withColumn("silindi", F.col("silindi") & ~F.coalesce(condition, F.lit(False)))


def pending(catalogue: DataFrame, documents: DataFrame, defect: Column) -> DataFrame:
    """What an update still has to fetch: catalogue rows without a sound text.
    Sound keys meet the catalogue in an anti-join, so a rerun resumes."""
    return catalogue.join(documents.where(defect.isNull()).select("anahtar").distinct(), "anahtar", "left_anti")
