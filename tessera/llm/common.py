"""What the operators of this subpackage share: scratch tables, byte views of
Arrow text, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    that is unset, as in tests, a temporary folder of this machine, which only a
    local master can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written once to the shared folder. They cut the lineage, outlive
    a lost executor, and are read back with an exchange of their own, so that
    adaptive execution can split a skewed side of a later join."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.scratch_path)

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
        atexit.unregister(self.clear)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sampled_ids(slim: DataFrame, most_rows: int, most_chars: int, seed: int) -> dict:
    """doc_id -> label of at most so many rows (label, doc_id, n characters),
    evenly by label and in seeded order; together about most_chars characters.
    What comes to the driver is a bounded share of the ids."""
    slim = slim.select("label", "doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"), "n")
    count = {r["label"]: r["n"] for r in slim.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return {}
    each = max(1, most_rows // len(count))
    share = F.create_map(*(F.lit(x) for k, n in count.items() for x in (k, min(1.0, (2.0 * each + 30) / n))))
    few = slim.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)).orderBy("h", "doc_id").limit(4 * most_rows)
    ids, held, size = {}, dict.fromkeys(count, 0), dict.fromkeys(count, 0)
    for r in few.collect():
        k = r["label"]
        if r["doc_id"] is not None and held[k] < each and size[k] + r["n"] <= most_chars / len(count):
            ids[r["doc_id"]] = k
            held[k], size[k] = held[k] + 1, size[k] + r["n"]
    return ids


def labelled_sample(rows: DataFrame, most_rows: int, most_chars: int, seed: int) -> list:
    """The sampled rows (label, doc_id, text) with whole texts: one scan brings
    ids and lengths, the next the texts."""
    ids = sampled_ids(rows.select("label", "doc_id", F.length("text").alias("n")), most_rows, most_chars, seed)
    out = rows.where(F.col("doc_id").isin([*ids])).select("label", "doc_id", "text").collect() if ids else []
    return sorted(out, key=lambda r: (r["doc_id"], str(r["label"]), r["text"] or ""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Give memory that this worker no longer holds back to the system: workers
    are used again, by tasks of other kinds too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


@functools.cache
def lean() -> None:
    """From now on large blocks that this worker frees go back to the system at
    once: Arrow takes memory from the C library, as numpy does, and that maps each
    block of 4 MB or more for itself."""
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD; setting it ends its growth
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not this C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, whose memory goes back to the system when it ends, its last batch and
    all it held included."""

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from run(batches)
        tidy()

    return held


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """From now on this session's rows go to Python in batches of about so many
    bytes, not of 10,000 rows whatever their length: batches are held several
    times over, by the worker and in buffers beside the executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, at * 8) if offsets is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most_bytes: int, most_rows: int):
    """Row ranges of at most so many bytes and rows; a longer text is alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most_bytes, "right")) - 1
        b = min(max(b, a + 1), a + most_rows, n)
        yield a, b
        a = b


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from its bytes and the end offset of each value."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Nodes of an edge list (a, b) with the root of their component.

    Contraction: every node moves to the neighbour of least priority (a hash of
    the id, so that no chain of ids is slow), the edges move along, and loops
    and repeated edges go, until no edge is left. Nothing is collected, and a
    hub's edges meet only in partial aggregates and splittable joins.
    Returns (node, root), for nodes that have an edge; roots map to themselves.
    """
    pri = lambda c: F.struct(F.xxhash64(F.lit(7), c).alias("p"), c.alias("v"))
    edges = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(pri(F.col("b"))).alias("m"))
        moved = scratch.keep(low.select(F.col("a").alias("node"), F.least(pri(F.col("a")), F.col("m")).getField("v").alias("to")), "moves")
        maps.append(moved)
        left, right = (moved.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in "ab")
        there = edges.join(left, "a").join(right, "b").select("a_to", "b_to").where("a_to <> b_to")
        there = there.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        edges = scratch.keep(there, "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), "to")
        out = scratch.keep(out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return out
