"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Rows combine locally and per (digest, content, salt): a partial aggregate in
   each task, then one shuffle of the distinct texts of each task.
2. The salt winners combine globally per (digest, content).
3. The verdicts go back to the rows over slim columns (digest and salt). Only
   where one digest stands for several contents, which a 256-bit digest does
   not do in practice, the content joins too, so the answer stays exact.

A group that holds a third of all rows meets a task as at most `salts` rows of
each map task, and its own rows spread over `salts` join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _rows(docs: DataFrame, salts: int, digest) -> DataFrame:
    text = normalized(F.col("text"))
    return docs.select("doc_id", text.alias("content"), digest(text).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _verdicts(docs: DataFrame, salts: int, digest) -> DataFrame:
    """(digest, keep_id, group_size, of, content) of each group of equal texts:
    of lists the salts it has, content is null unless the digest clashes."""
    salted = _rows(docs, salts, digest).groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    # One shuffle by digest serves both the combining and the look for clashes.
    whole = salted.repartition("digest").groupBy("digest", "content").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("of"))
    by = whole.groupBy("digest").agg(F.collect_list(F.struct("content", "keep_id", "group_size", "of")).alias("each"))
    by = by.select("digest", F.explode("each").alias("e"), (F.size("each") > 1).alias("clash")).select("digest", "e.*", "clash")
    return by.select("digest", "keep_id", "group_size", "of", F.when(F.col("clash"), F.col("content")).alias("content"))


def exact_groups(docs: DataFrame, salts: int = 64, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id of the equal
    texts), group_size, kept, text_sha256.

    Null text equals empty text. A null doc_id is smaller than any other; a
    group of null ids alone has a null keep_id. Repeated rows of one id count
    in group_size and are kept or dropped together. Other columns are ignored.
    digest may be any function of a text; equal texts must have equal digests.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    verdict = _verdicts(docs, salts, digest)
    verdict = scratch.keep(verdict.select("digest", F.explode("of").alias("salt"), "keep_id", "group_size", "content"), "verdicts")
    rows = _rows(docs, salts, digest)
    out = rows.select("doc_id", "digest", "salt").join(verdict.where("content IS NULL").drop("content"), ["digest", "salt"])
    clashes = verdict.where("content IS NOT NULL")
    if not clashes.isEmpty():
        out = out.unionByName(rows.join(clashes, ["digest", "salt", "content"]).drop("content"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, salts: int = 64, digest=sha256) -> DataFrame:
    """One row of docs, all columns, of each group of equal texts: that with the
    largest doc_id.

    Null text equals empty text; a null doc_id is smaller than any other. Of
    rows that share text and doc_id one stays, the one with the largest hash of
    all its columns. A doc_id that several texts share is kept for each of them.
    Columns of any other names pass through.
    """
    scratch = Scratch(docs.sparkSession, "exact-rows")
    verdict = scratch.keep(_verdicts(docs, salts, digest).select(F.col("digest").alias("of_digest"), "keep_id", "content"), "kept")
    text = normalized(F.col("text"))
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), digest(text).alias("own_digest"))
    sole, clash = verdict.where("content IS NULL"), verdict.where("content IS NOT NULL")
    mine = (F.col("own_digest") == F.col("of_digest")) & F.col("id").eqNullSafe(F.col("keep_id"))
    out = rows.join(sole, mine, "left_semi")
    if not clash.isEmpty():
        out = out.unionByName(rows.join(clash, mine & (normalized(F.col("row.text")) == F.col("content")), "left_semi"))
    # Rows under one doc_id may have one text, too.
    again = scratch.keep(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return out.select("row.*")
    twice = F.col("id").eqNullSafe(F.col("doc_id"))
    one = out.join(again, twice, "left_semi").groupBy("id", normalized(F.col("row.text")).alias("content")).agg(F.max_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return out.join(again, twice, "left_anti").select("row.*").unionByName(one.select("row.*"))
