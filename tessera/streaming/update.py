"""Incremental updates: micro-batches that fetch only what is still missing, with
a breaker for runs of failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Fixed value: failures in a row that stop an update.
BREAK_AFTER = 10

Fetch = Callable[[DataFrame], DataFrame]


def fetched(fast: Column, fallback: Column) -> Column:
    """The guessed address's text, or else the detail page's; blank is none."""
    some = lambda x: F.when(F.length(F.trim(x)) > 0, x)
    return F.coalesce(some(fast), some(fallback))


def longest_frame(frames: DataFrame) -> DataFrame:
    """(page_id, ana, metin) to a page's text: its longest child frame, the main
    frame only where no child has any text."""
    child = ~F.col("ana") & (F.length(F.trim("metin")) > 0)
    size = F.length("metin")
    best = F.max_by(F.when(child, F.col("metin")), F.when(child, F.struct(size, "metin")))
    main = F.max_by(F.when(F.col("ana"), F.col("metin")), F.when(F.col("ana"), F.struct(size, "metin")))
    return frames.groupBy("page_id").agg(F.coalesce(best, main).alias("metin"))


def failure_runs(log: DataFrame, after: int = BREAK_AFTER) -> DataFrame:
    """(is_id, sira, basarili) to the runs of failures that trip the breaker:
    is_id, ilk, n. A run is told by the successes before it."""
    order = Window.partitionBy("is_id").orderBy("sira").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("__run", F.sum(F.col("basarili").cast("int")).over(order)).where("NOT basarili")
    return rows.groupBy("is_id", "__run").agg(F.min("sira").alias("ilk"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= after).drop("__run")


def pending(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of a batch of catalogue keys that no sound text is stored for."""
    return batch.dropDuplicates(["anahtar"]).join(store.where("kusur IS NULL").select("anahtar").distinct(), "anahtar", "left_anti")


def update(spark: SparkSession, catalogue: DataFrame, store: str, checkpoint: str, fetch: Fetch) -> StreamingQuery:
    """Run a stream of catalogue rows (anahtar, ...) against a Parquet store
    (anahtar, metin, kusur) until its input is read.

    Each micro-batch goes by anti-join: keys with a sound text are not fetched
    again, so a batch that runs twice after a failure adds nothing. fetch turns
    the missing rows into rows of the store.
    """
    schema = "anahtar string, metin string, kusur string"

    def step(batch: DataFrame, _: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        held = spark.read.schema(schema).parquet(store) if there else spark.createDataFrame([], schema)
        fetch(pending(batch, held)).select("anahtar", "metin", "kusur").write.mode("append").parquet(store)

    return catalogue.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
