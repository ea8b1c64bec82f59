"""Append-only logs as streams: running counts by domain."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream and counted by type; all that is there, once."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A single file is a stream of its folder's files of that name.
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    single = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file).isFile()
    read = spark.readStream.schema(schema)
    rows = read.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else read.parquet(path)
    name = f"log_counts_{uuid.uuid4().hex}"
    counts = rows.groupBy(F.col("event_type").alias("alan")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("toplam"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"log_stream_counts": log_stream_counts}


def oracle_sql() -> dict[str, str]:
    return {"log_stream_counts": "SELECT event_type AS alan, count(*) AS n, round(sum(value), 4) AS toplam FROM events GROUP BY event_type"}
