"""Token-id output as canonical length-limited Huffman codes.

Documents are encoded once; their ids are counted over the whole corpus, which
gives one canonical code of at most LONGEST bits. Ids then go out in ascending
doc_id order as self-contained records of about RECORD ids: per document its id
and count, the code bits, and a checkpoint (bit offset) every BLOCK ids, so that
a reader decodes all blocks of a record side by side by table look-up.

A file is a Parquet file of records (part, first: ids of the part before the
record, doc_ids, counts, checkpoints, bits), written by Spark's committer; the
code is a second small table (id, length). Nothing else is needed to read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions
from tessera.llm.tokens import encoder

LONGEST, BLOCK, RECORD = 20, 256, 1 << 19
U = np.uint64


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths up to longest by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    rows, pack = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate((leaf, pack))
        at = np.argsort(both, kind="stable")
        rows.append(at < len(leaf))  # where the leaves are in this list
        both = both[at]
        pack = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, length = 2 * len(leaf) - 2, np.zeros(len(leaf), np.uint8)
    for row in reversed(rows):
        n = int(row[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id, counting up."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - last
        at = np.flatnonzero(lengths == n)
        codes[at] = np.arange(code, code + len(at), dtype=np.uint64)
        code, last = code + len(at), n
    return codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits as big-endian 64-bit words, the bit offset of every BLOCK-th id)."""
    size = lengths[ids].astype(np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    word, over = at[:-1] >> 6, (at[:-1] & 63) + size - 64
    value = codes[ids]
    here = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[heads]] = np.bitwise_or.reduceat(here, heads)
        cut = np.flatnonzero(over > 0)
        out[word[cut] + 1] |= value[cut] << (64 - over[cut]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at[:-1:BLOCK].copy()


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) by the next `width` bits, and width."""
    width = max(1, int(lengths.max(initial=1)))
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = 1 << (width - lengths[used].astype(np.int64))
    ids, size = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    ids[: span.sum()] = np.repeat(used, span)
    size[: span.sum()] = np.repeat(lengths[used], span)
    return ids, size, width


def decode_bits(bits: bytes, marks: np.ndarray, n: int, look: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids; all blocks advance together, one id a step."""
    ids, size, width = look
    word = np.frombuffer(bits, ">u8").astype(np.uint64)
    at, out = marks.astype(np.int64).copy(), np.zeros((len(marks), BLOCK), np.uint32)
    keep = U(64 - width)
    for i in range(min(BLOCK, n)):
        live = len(marks) - (1 if (len(marks) - 1) * BLOCK + i >= n else 0)
        p = at[:live]
        k, shift = p >> 6, (p & 63).astype(np.uint64)
        window = word[k] << shift | (word[k + 1] >> U(1)) >> (U(63) - shift)
        key = (window >> keep).astype(np.int64)
        out[:live, i] = ids[key]
        p += size[key]
    return out.reshape(-1)[:n]


def _encode(path: str, end: int):
    """(doc_id, n, packed ids); then, with null ids, (id, count) of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack, names = encoder(path), zstandard.ZstdCompressor(1), ["doc_id", "n", "ids"]
        total = np.zeros(0, np.int64)
        tail, size = np.array([end], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            row = 0
            for ids, at in enc.blocks(batch.column(1)):
                k, raw = len(at) - 1, ids.view(np.uint8)
                count = np.bincount(ids, minlength=max(len(total), end + 1))
                count[: len(total)] += total
                count[end] += k
                total = count
                cells = [pack.compress(raw[s:t].tobytes() + tail) for s, t in zip(at[:-1] * size, at[1:] * size, strict=True)]
                yield pa.record_batch([batch.column(0).slice(row, k).cast(pa.int64()), pa.array(np.diff(at) + 1), pa.array(cells, pa.binary())], names)
                row += k
        enc.rest()
        used = np.flatnonzero(total)
        if len(used):
            yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(total[used].astype(np.int64)), pa.nulls(len(used), pa.binary())], names)

    return run


def _write(path: str, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, unpack = encoder(path).dtype, zstandard.ZstdDecompressor()
        codes, part, first = canonical(lengths), TaskContext.get().partitionId(), 0
        names = ["part", "first", "doc_ids", "counts", "checkpoints", "bits"]
        docs, counts, ids, held = [], [], [], 0

        def record() -> pa.RecordBatch:
            bits, marks = encode_bits(np.concatenate(ids), codes, lengths)
            cell = lambda a, t: pa.array([a], t)
            return pa.record_batch([cell(part, pa.int32()), cell(first, pa.int64()), cell(docs, pa.list_(pa.int64())), cell(counts, pa.list_(pa.int64())), cell(marks.tolist(), pa.list_(pa.int64())), cell(bits, pa.binary())], names)

        for batch in batches:
            for d, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                docs.append(d)
                counts.append(n)
                ids.append(np.frombuffer(unpack.decompress(raw), dtype))
                held += n
                if held >= RECORD:
                    yield record()
                    docs, counts, ids, first, held = [], [], [], first + held, 0
        if docs:
            yield record()

    return run


def write_tokens(docs: DataFrame, out: str, vocabulary: str, end: int = 2) -> None:
    """Encode every text (null: empty) and write the files under out.

    vocabulary is the path of a tokenizer file on every machine; end closes
    each document. Null doc_ids come first; rows of one doc_id are ordered by
    length, then by content. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    made = scratch.keep(docs.select("doc_id", "text").mapInArrow(_encode(vocabulary, end), "doc_id long, n long, ids binary"), "ids")
    # One count per id of the vocabulary.
    count = made.where("ids IS NULL").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["doc_id"] for r in count), default=0) + 1, np.int64)
    for r in count:
        counts[r["doc_id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths) if n], "id int, length int").coalesce(1).write.parquet(f"{out}/code")
    rows = made.where("ids IS NOT NULL").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    records = rows.mapInArrow(_write(vocabulary, lengths), "part int, first long, doc_ids array<long>, counts array<long>, checkpoints array<long>, bits binary")
    records.write.option("compression", "none").parquet(f"{out}/records")
    scratch.drop(made)


def _read(lengths: np.ndarray, before: dict[int, int], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = table(lengths)
        for batch in batches:
            for part, first, docs, counts, marks, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_bits(bits, np.array(marks, np.int64), sum(counts), look).astype("<u4")
                ends = np.cumsum(counts)
                raw, start = memoryview(ids.tobytes()), before[part] + first
                runs = [raw[4 * (e - n) : 4 * e] for n, e in zip(counts, ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in runs], pa.int64()) if digest else pa.array([np.frombuffer(x, "<i4") for x in runs], pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + ends - np.array(counts), pa.int64()), pa.array(counts, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, or, with
    digest, ids_crc32 of its ids as little-endian 32-bit integers. start counts
    the ids of all documents before it."""
    code = spark.read.schema("id int, length int").parquet(f"{out}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    records = spark.read.schema("part int, first long, doc_ids array<long>, counts array<long>, checkpoints array<long>, bits binary").parquet(f"{out}/records")
    # A total for each part that was written, in order.
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    parts = records.groupBy("part").agg(F.max(F.col("first") + n).alias("n")).collect()
    before, held = {}, 0
    for part, size in sorted((r["part"], r["n"]) for r in parts):
        before[part], held = held, held + size
    last = "ids_crc32 long" if digest else "ids array<int>"
    return records.mapInArrow(_read(lengths, before, digest), f"doc_id long, start long, n_tokens long, {last}")
