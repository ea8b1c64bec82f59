"""Best-fit packing with certified bin counts.

Pieces are dealt by hash to groups of about GROUP. A group packs its pieces by
best-fit decreasing and bounds its bin count from below by dual feasible
functions over its lengths; equal counts certify that no packing needs fewer.
Groups with a gap exchange documents (they are dealt anew among the groups that
have one) and pack again, and the better of both packings stays.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.tokens import encoder

GROUP = 8192


def lower_bound(count: np.ndarray, size: int) -> int:
    """Bins of `size` that items need at least; count[n] is the number of items
    of length n. Three families of dual feasible functions, in whole numbers."""
    n = np.arange(size + 1, dtype=np.int64)
    count = count.astype(np.int64)
    best = -(-int((n * count).sum()) // size)
    for k in range(1, 21):  # rounding to k-ths
        whole = (k + 1) * n % size == 0
        value = np.where(whole, n * k, (k + 1) * n // size * size)
        best = max(best, -(-int((value * count).sum()) // (k * size)))
    some = np.flatnonzero(count)
    edges = np.unique(np.concatenate((some, size - some)))
    items, held = some.astype(np.int64), count[some]
    for e in edges[(edges > 0) & (2 * edges <= size)]:
        e = int(e)
        # Above size - e counts as a bin, below e as nothing.
        value = np.where(items > size - e, size, np.where(items < e, 0, items))
        best = max(best, -(-int((value * held).sum()) // size))
        top = size // e
        value = np.where(2 * items > size, top - (size - items) // e, np.where(items >= e, 1, 0))
        best = max(best, -(-int((value * held).sum()) // top))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item, and the number of bins, longest item first."""
    bins, offs, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b, used = size, used, used + 1
        bins[i], offs[i] = b, size - r
        left = r - n
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins, offs, used


def _cut(vocabulary: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            row = 0
            for ids, at in enc.blocks(batch.column(1)):
                k = len(at) - 1
                closed = np.full(len(ids) + k, end, "<u4")
                closed[np.arange(len(ids)) + np.repeat(np.arange(k), np.diff(at))] = ids
                raw, out = memoryview(closed.view(np.uint8)), []
                for d, s, n in zip(batch.column(0).slice(row, k).to_pylist(), (at[:-1] + np.arange(k)).tolist(), (np.diff(at) + 1).tolist(), strict=True):
                    a = 0
                    for i in range(-(-n // size)):
                        b = a + (size if i else (n - 1) % size + 1)
                        out.append((d, i, a, b - a, zlib.crc32(raw[4 * (s + a) : 4 * (s + b)])))
                        a = b
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                row += k
        enc.rest()

    return run


def _pack(size: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offs, used = best_fit(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        more = {"bin": bins, "offset": offs, "bins": np.full(len(bins), used), "bound": np.full(len(bins), bound)}
        for name, value in more.items():
            table = table.append_column(name, pa.array(value, pa.int64()))
        return table

    return run


PIECE = "doc_id long, piece long, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end: int = 0, rounds: int = 2, seed: int = 11) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.

    A document is the ids of its text (null: empty) and the id end. Longer ones
    are cut into pieces of size ids, of which the first may be shorter. Repeated
    rows and null doc_ids are packed as rows of their own; other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(vocabulary, end, size), PIECE)
    pieces = scratch.keep(pieces, "pieces")
    names, done, base = pieces.columns, [], 0
    best = None
    for k in range(rounds + 1):
        n = pieces.count() if best is None else int(best.agg(F.count(F.lit(1))).first()[0])
        groups = max(1, math.ceil(n / GROUP))
        # Equal rows are dealt apart by their place in the file.
        source = (pieces if best is None else best).select(*names)
        deal = F.pmod(F.xxhash64(F.lit(seed + k), "doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)) + F.lit(base)
        packed = source.withColumn("group", deal).groupBy("group").applyInArrow(_pack(size), f"{PIECE}, group long, bin long, offset long, bins long, bound long")
        packed = scratch.keep(packed, "packed")
        base += groups
        if best is not None:
            each = packed.select("group", "bins").distinct().agg(F.sum("bins")).first()[0]
            before = best.select("group", "bins").distinct().agg(F.sum("bins")).first()[0]
            if each >= before:
                break
        done.append(packed.where("bins = bound"))
        best = packed.where("bins > bound")
        if best.isEmpty():
            best = None
            break
    if best is not None:
        done.append(best)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("group") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")
