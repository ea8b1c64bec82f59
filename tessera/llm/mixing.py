"""Mixing sources to target weights by subset-sum budget fitting.

Sources get targets by weight; a target over its source's size is met by whole
repeats of the source and a remainder. The remainder is fitted over counts of
documents by exact size: a proportional share of every size, a greedy fill, and
bounded-knapsack dynamic programming for what is left. Documents are then drawn
by seeded order within each size until its count is met.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Words separated by the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """How many words a text has; null: 0."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


#: Words of the table that a fit which falls short may always grow to.
WIDE = 1 << 22


def fit(counts: dict[int, int], budget: int, dp_words: int = 20_000) -> dict[int, int]:
    """How many items of each size to take, of counts by size, for a sum as
    near to budget as the table allows, and never above it. The table decides
    the last dp_words words; while the sum falls short it grows, up to the whole
    budget, WIDE words or eight of the longest items, whichever of the last two
    is more."""
    best, span = _fit(counts, budget, dp_words), dp_words
    made = lambda take: sum(s * n for s, n in take.items())
    most = min(budget, max(WIDE, 8 * max(counts, default=0)))
    while made(best) < min(budget, made(counts)) and span < most:
        span = min(most, 8 * span)
        best = max(best, _fit(counts, budget, span), key=made)
    return best


def _fit(counts: dict[int, int], budget: int, dp_words: int) -> dict[int, int]:
    total = sum(s * c for s, c in counts.items())
    if budget >= total:
        return dict(counts)
    take = {s: c * budget // total for s, c in counts.items()}
    left = budget - sum(s * n for s, n in take.items())
    for s in sorted(counts, reverse=True):  # greedy, down to what the table can hold
        if left <= dp_words:
            break
        n = min(counts[s] - take[s], (left - dp_words) // s)
        take[s], left = take[s] + n, left - n * s
    for s in sorted(counts, reverse=True):  # what the table may decide anew
        n = min(take[s], max(0, dp_words - left) // s)
        take[s], left = take[s] - n, left + n * s
    if 0 < left <= dp_words:
        # reach: the sums that the chunks so far can make, as a bit set; by[x]:
        # the chunk that first made x.
        chunks, mask = [], (1 << (left + 1)) - 1
        for s in sorted(counts):
            free, k = min(counts[s] - take[s], left // s), 1
            while free > 0:
                chunks.append((s, min(k, free)))
                free, k = free - k, 2 * k
        reach, by = 1, np.zeros(left + 1, np.int32)
        for i, (s, k) in enumerate(chunks):
            new = (reach << (s * k)) & mask & ~reach
            if new:
                low = (new & -new).bit_length() - 1
                bits = np.frombuffer((new >> low).to_bytes((new.bit_length() - low + 7) // 8, "little"), np.uint8)
                by[low + np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = i
                reach |= new
            if reach >> left & 1:
                break
        at = reach.bit_length() - 1
        while at:
            s, k = chunks[by[at]]
            take[s], at = take[s] + k, at - s * k
    return take


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], most: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target): weights repeat over the sources by code point,
    null last; a target over most times its source stops there and the rest
    shares what it left by weight, until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weigh = [weights[i % len(weights)] for i in range(len(order))]
    total, full = float(sum(n for _, n in order)), set()
    goal = [0.0] * len(order)
    while True:
        room = total - sum(most * order[i][1] for i in full)
        share = sum(weigh[i] for i in range(len(order)) if i not in full)
        for i in range(len(order)):
            goal[i] = float(most * order[i][1]) if i in full else float(room * weigh[i] / share)
        over = {i for i in range(len(order)) if i not in full and goal[i] > most * order[i][1]}
        if not over:
            return [(s, n, g) for (s, n), g in zip(order, goal, strict=True)]
        full |= over


def _drawn(docs: DataFrame, keep: list[Column], weights: tuple[float, ...], most: int, seed: int, slices: int, dp_words: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of docs as keep with (size, key, copies), the targets by key).
    key stands for the source, null too."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key")
    pick = F.xxhash64(F.lit(seed), "doc_id")
    base = [key, n_words(F.col("text")).alias("size"), pick.alias("pick"), F.pmod(F.shiftright(pick, 20), F.lit(slices)).cast("int").alias("slice")]
    counts = scratch.keep(docs.select(*base).groupBy("key", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "counts")
    per = [(r["key"][1:] if r["key"] else None, r["n"]) for r in counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()]
    made = targets(per, weights, most)
    goal = spark.createDataFrame([("=" + s if s is not None else "", s, n, t) for s, n, t in made], "key string, source string, source_size long, target double")
    plan_of = {"=" + s if s is not None else "": (n, t) for s, n, t in made}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = plan_of[pdf["key"].iloc[0]]
        have = {int(s): int(n) for s, n in zip(pdf["size"], pdf["n"], strict=True) if s > 0}
        whole = min(most, int(target // size)) if size else 0
        extra = fit(have, int(round(target)) - whole * size, dp_words) if whole < most else {}
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "whole": whole, "extra": [extra.get(int(s), 0) for s in pdf["size"]]})

    by_size = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    quota = scratch.keep(by_size.groupBy("key").applyInPandas(plan, "key string, size long, whole int, extra long"), "quotas")
    # What the slices before this one draw; the rest of the quota is drawn here.
    before = F.sum("n").over(W.partitionBy("key", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    ahead = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    cut = scratch.keep(ahead.join(quota, ["key", "size"]).select("key", "size", "slice", "whole", (F.col("extra") - F.col("before")).alias("draw")), "draws")
    order = W.partitionBy("key", "size", "slice").orderBy("pick", "id", "tie")
    rows = docs.select(*keep, F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), *base)
    ranked = rows.withColumn("rank", F.row_number().over(order)).drop("pick", "id", "tie")
    taken = ranked.join(cut, ["key", "size", "slice"]).withColumn("copies", F.col("whole") + (F.col("rank") <= F.col("draw")).cast("int"))
    return taken.drop("slice", "rank", "whole", "draw"), goal


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 17, slices: int = 256, dp_words: int = 20_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its
    source's), taken (size times the repeats drawn, 0 to most), copies.

    Null text has size 0 and is taken 0 times its nothing; a null source is a
    source of its own, last in order. Rows of equal doc_id and size are drawn one
    by one, in the order of a hash of their text; equal rows, in any. The number
    of sources is taken to fit the driver (a name and a total each); nothing else
    of the corpus goes there. The draw ranks within (source, size, slice of the
    seeded hash), so a size that a third of all rows share splits over the
    slices. Other columns are ignored.
    """
    rows, goal = _drawn(docs, [F.col("doc_id")], weights, most, seed, slices, dp_words)
    return rows.join(goal, "key").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 17, slices: int = 256, dp_words: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix draws that row.

    A row of no words is repeated as often as its source as a whole. Repeated
    and null doc_ids are rows like any other; columns of any names pass through.
    """
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows, _ = _drawn(docs, [row], weights, most, seed, slices, dp_words)
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("nth")).select("row.*")
