"""Readers: JSON lines, the catalogue, question lists, text files, optional tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOGUE = "mevzuatNo string, mevzuatTur int, mevzuatTertip string, mevAdi string, mevzuatTurEnumString string, resmiGazeteTarihi string, resmiGazeteSayisi string, url string"
QUESTION = "soru string, alan string, dogru_chunk array<string>, dogru array<string>, ad_icerir array<string>, govde_icerir array<string>"
#: How much of a text file is looked at, in characters.
PEEK = 4000


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are skipped. A bad line stops a
    strict read; otherwise it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def last_by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all there; of equal keys the last of the file wins."""
    meta = F.col("_metadata")
    at = rows.select("*", F.struct(meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id()).alias("__at")).na.drop(subset=[*keys])
    last = Window.partitionBy(*keys).orderBy(F.desc("__at"))
    return at.withColumn("__rk", F.row_number().over(last)).where("__rk = 1").drop("__at", "__rk")


def base_key() -> Column:
    return F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("mevzuatNo", "mevzuatTur", "mevzuatTertip")))


def with_keys(rows: DataFrame, order: str) -> DataFrame:
    """Catalogue rows with `anahtar`. A number, type and series that recur get
    the gazette's date, if it has eight digits; a key that still recurs is a
    true copy, of which the first by `order` stays."""
    triple = Window.partitionBy("mevzuatNo", "mevzuatTur", "mevzuatTertip")
    day = F.substring(F.regexp_replace(F.coalesce("resmiGazeteTarihi", F.lit("")), r"\D", ""), 1, 8)
    dated = (F.count(F.lit(1)).over(triple) > 1) & (F.length(day) == 8)
    keyed = rows.withColumn("anahtar", F.when(dated, F.concat_ws("_", base_key(), day)).otherwise(base_key()))
    first = Window.partitionBy("anahtar").orderBy(order)
    return keyed.withColumn("__rk", F.row_number().over(first)).where("__rk = 1").drop("__rk")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue, one row a key, in file order `sira`."""
    return with_keys(json_lines(spark, path, CATALOGUE).withColumn("sira", F.monotonically_increasing_id()), "sira")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a JSON array, from one object, or from lines that may end
    in a comma. A question list is hand-written: a file is read as one text."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<struct<{QUESTION}>>")
    lines = F.transform(F.split("v", r"\R"), lambda x: F.from_json(F.regexp_replace(F.trim(x), r",\s*$", ""), QUESTION))
    rows = F.when(F.col("v").startswith("["), listed).otherwise(lines)
    whole = F.array(F.from_json("v", QUESTION))
    rows = F.when(F.col("v").startswith("{") & whole[0]["soru"].isNotNull() & ~F.col("v").rlike(r"\}\s*,?\s*\R\s*\{"), whole).otherwise(rows)
    return text.select(F.posexplode(rows).alias("sira", "s")).where("s.soru IS NOT NULL").select("sira", "s.*")


def text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, key (the file's name), size and text; bytes that are no UTF-8 are
    left out."""
    files = spark.read.format("binaryFile").load(pattern)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("key"), F.col("length").alias("size"), text.alias("text"))


def peek(files: DataFrame) -> DataFrame:
    """The head of each text and the size of its file."""
    return files.select("path", "key", F.substring("text", 1, PEEK).alias("bas"), "size")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or no rows of that schema where there is no file."""
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def spread(spark: SparkSession, path: str, small: int = 64 << 20) -> DataFrame:
    """A Parquet table of whole texts, dealt evenly over all cores where it is small.

    A file is split by row groups, so that a small one is often one task, however
    dear the expressions over its texts are. Of up to `small` bytes, rows are
    dealt by one exchange of so many bytes at most, below which columns and
    filters still reach the scan; larger tables are read as their files lie.
    """
    rows, place = spark.read.parquet(path), spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= small else rows
