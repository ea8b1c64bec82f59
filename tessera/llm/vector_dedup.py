"""Embedding near-dedup by sorted projection passes.

Equal vectors form a class, compared once. Each pass hashes a class's vector to
the signs of 64 random projections, orders all classes lexicographically by the
concatenated bits (ties by one more projection) and compares every vector with
the `window` before it in that order, in double precision. The verified links
of all passes are united into components.

How many passes: two vectors at the threshold angle agree on a bit with
q = 1 - angle / pi. Each pass measures for each vector the b bits that tell it
from the vectors `window` places before and after it: all that share them lie
between, so the pass finds a link of this vector with q ** b or more. In a dense
region b is large and a pass counts for little. A vector is settled once the
chance that all its passes miss a link is at most `miss`; passes go on over the
others (a link of which one end is settled is covered), however many it takes,
until all are settled or so few are left that comparing each with each costs less
than the passes that they still need. A few passes are dealt out together, so
that a shuffle holds at most `together` copies of the vectors.

Windows bound the work, not the answer: within a component all links are then
counted. In a large component the vectors within half the threshold angle of its
centre all link with one another (the triangle inequality on the sphere), so
they are counted without comparison; the others are compared in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components, partitions

#: Vectors of a block; a component of more has its centre looked at.
BLOCK = 512
#: Vectors of a block where all are compared, and how many such comparisons
#: cost about as much as one in a window.
FULL, CHEAP = 2048, 32


def passes(n: int, window: int, least: float, miss: float) -> int:
    if n <= window:
        return 1
    q = 1 - math.acos(least) / math.pi
    hit = q ** math.log2(n / window)
    return max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


def agreement(least: float) -> float:
    """The chance that two vectors at the threshold angle agree on a bit."""
    return 1 - math.acos(least) / math.pi


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits of two signatures are equal, 0 to 64."""
    x = (a ^ b).view(np.uint64)
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def _depths(cls: np.ndarray, group: np.ndarray, sig: np.ndarray, window: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, pass, bits) for both ends of each span of window places whose
    later end is at first to last: the bits that the ends share, -1 across
    groups."""
    k = np.arange(max(window, first), last)
    far = k - window
    bits = np.where(group[k] == group[far], shared_bits(sig[k], sig[far]), -1)
    return np.concatenate((cls[k], cls[far])), np.concatenate((group[k], group[far])) >> 32, np.concatenate((bits, bits))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each row) of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """Unit rows of the vectors at these places, which have one length."""
    values, size = _matrix(column.take(pa.array(at)))
    return _unit(values.reshape(len(at), size[0] if len(at) else 0))


def _sign(first: int, count: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pass", "dim", "sig", "tie", "class", "embedding"]
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                own = batch.take(pa.array(at))
                x = _rows(own.column(1), np.arange(len(at)))
                for p in range(first, first + count):
                    y = x @ np.random.default_rng((seed, p, int(d))).standard_normal((int(d), 65))
                    sig = np.packbits(y[:, :64] > 0, axis=1, bitorder="big").view(">i8").astype(np.int64).reshape(-1)
                    yield pa.record_batch([pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), d, np.int32)), pa.array(sig), pa.array(y[:, 64]), own.column(0), own.column(1)], names)

    return run


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place of each place's component under links u - v."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _window(x: np.ndarray, group: np.ndarray, window: int, least: float, ahead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of rows at most window apart in one group; rows before
    place `ahead` were already compared with one another."""
    us, vs = [], []
    for k in range(1, min(window, len(x) - 1) + 1):
        s = max(0, ahead - k)
        hit = (group[s + k :] == group[s : len(x) - k]) & (np.einsum("ij,ij->i", x[s + k :], x[s : len(x) - k]) >= least)
        at = np.flatnonzero(hit) + s
        us.append(at + k)
        vs.append(at)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(window: int, least: float):
    """Edges (kind 0) of a sorted partition, its first (1) and last (2) rows,
    with signatures as b, which its neighbours compare, and the depths of its
    spans (3) with bits as pos."""
    names = ["kind", "part", "pos", "pass", "dim", "a", "b", "embedding"]

    def rows(kind, part, pos, table):
        n = table.num_rows
        return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), *(table.column(i).combine_chunks() for i in (0, 1, 4, 2)), table.column(5).combine_chunks()], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if seen < window:
                yield rows(1, part, seen, table.slice(0, window - seen))
            seen += table.num_rows
            both = pa.concat_tables([held, table]) if held is not None else table
            cls = both.column(4).to_numpy()
            dim = both.column(1).to_numpy()
            group = both.column(0).to_numpy().astype(np.int64) << 32 | dim
            column = both.column(5).combine_chunks()
            c, p, bits = _depths(cls, group, both.column(2).to_numpy(), window, both.num_rows - table.num_rows, both.num_rows)
            none = pa.nulls(len(c), pa.int32())
            yield pa.record_batch([pa.array(np.full(len(c), 3, np.int32)), none, pa.array(bits.astype(np.int64)), pa.array(p.astype(np.int32)), none, pa.array(c), pa.nulls(len(c), pa.int64()), pa.nulls(len(c), column.type)], names)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                fresh = len(held) if held is not None else 0
                u, v = _window(_rows(column, at), group[at], window, least, int((at < fresh).sum()))
                low = _joined(len(at), u, v)
                moved = np.flatnonzero(low != np.arange(len(at)))
                if len(moved):
                    n = len(moved)
                    none = pa.nulls(n, pa.int32())
                    yield pa.record_batch([pa.array(np.zeros(n, np.int32)), none, pa.nulls(n, pa.int64()), none, none, pa.array(cls[at[moved]]), pa.array(cls[at[low[moved]]]), pa.nulls(n, column.type)], names)
            held = both.slice(max(0, both.num_rows - window)).combine_chunks()
        if held is not None:
            yield rows(2, part, 0, held)

    return run


def _border(window: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "descending"), ("pos", "ascending")])
        cls, dim = table["a"].to_numpy(), table["dim"].to_numpy()
        group = table["pass"].to_numpy().astype(np.int64) << 32 | dim
        head = int((table["kind"].to_numpy() == 2).sum())
        column, us, vs = table["embedding"].combine_chunks(), [], []
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            u, v = _window(_rows(column, at), group[at], window, least, int((at < head).sum()))
            low = _joined(len(at), u, v)  # links that span what is joined, not all pairs
            moved = np.flatnonzero(low != np.arange(len(at)))
            us.append(cls[at[moved]])
            vs.append(cls[at[low[moved]]])
        u, v = np.concatenate(us), np.concatenate(vs)
        c, p, bits = _depths(cls, group, table["b"].to_numpy(), window, head, min(len(cls), head + window))
        none = pa.nulls(len(u), pa.int32())
        return pa.table(
            {
                "a": np.concatenate((u, c)),
                "b": pa.chunked_array([pa.array(v, pa.int64()), pa.nulls(len(c), pa.int64())]),
                "pass": pa.chunked_array([none, pa.array(p.astype(np.int32))]),
                "bits": pa.chunked_array([none, pa.array(bits.astype(np.int32))]),
            }
        )

    return run


def _pair(least: float):
    """Edges that join what links within two blocks of one dimension."""

    def run(table: pa.Table) -> pa.Table:
        one = table["block"].to_numpy()
        cls, x = table["class"].to_numpy(), _rows(table["embedding"].combine_chunks(), np.arange(len(one)))
        i, j = np.flatnonzero(one == one.min()), np.flatnonzero(one == one.max())
        if one.min() == one.max() and table["lo"][0].as_py() != table["hi"][0].as_py():
            i = i[:0]  # the other block is empty
        u, v = np.nonzero(x[i] @ x[j].T >= least)
        low = _joined(len(cls), i[u], j[v])
        moved = np.flatnonzero(low != np.arange(len(cls)))
        return pa.table({"a": cls[moved], "b": cls[low[moved]]})

    return run


def _in_full(rest: DataFrame, n: int, least: float) -> DataFrame:
    """Edges (a, b) of rest, each vector compared with each."""
    blocks = -(-n // FULL)
    block = F.pmod(F.xxhash64(F.lit(11), "class"), F.lit(blocks)).cast("int")
    dealt = rest.select("class", "embedding", F.size("embedding").alias("dim"), block.alias("block"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("class", "embedding", "dim", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return dealt.groupBy("dim", "lo", "hi").applyInArrow(_pair(least), "a long, b long")


def _total(table: pa.Table) -> pa.Table:
    """The sum of unit vectors of one component, or of one salt of it."""
    column = table["embedding"].combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    s = _rows(column, np.arange(len(size))).sum(axis=0)
    return pa.table({"root": table["root"].slice(0, 1), "dim": pa.array([len(s)], pa.int32()), "total": pa.array([s.tolist()], pa.list_(pa.float64()))})


def _sum(table: pa.Table) -> pa.Table:
    values, size = _matrix(table["total"].combine_chunks())
    s = values.reshape(len(size), size[0]).sum(axis=0)
    return pa.table({"root": table["root"].slice(0, 1), "centre": pa.array([s.tolist()], pa.list_(pa.float64()))})


def _core(least: float):
    """Whether a vector lies within half the threshold angle of the centre."""
    bound = math.cos(math.acos(least) / 2 - 1e-7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = batch.column(4), batch.column(5)
            core = np.zeros(batch.num_rows, bool)
            has = np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False))
            for i in has:
                v, w = (_unit(np.asarray(y[int(i)].values, np.float64)[None]) for y in (x, c))
                core[i] = (v * w).sum() >= bound
            yield pa.record_batch([*batch.columns[:5], pa.array(core)], ["root", "size", "class", "n", "embedding", "core"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One row per block: ids, weights, core flags and unit vectors as bytes."""
    column, core = table["embedding"].combine_chunks(), table["core"].to_numpy()
    x = _rows(column, np.arange(len(column)))
    cell = lambda a: pa.array([a.tobytes()], pa.binary())
    few = np.flatnonzero(~core)
    return pa.table(
        {
            "root": table["root"].slice(0, 1),
            "block": table["block"].slice(0, 1),
            "rest": pa.array([len(few)], pa.int64()),
            "ids": cell(table["class"].to_numpy()),
            "weights": cell(table["n"].to_numpy()),
            "core": cell(core),
            "vectors": cell(x),
        }
    )


def _count(least: float):
    """Links of the rest of one block with all of another, as (class, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                get = lambda k, s, t: np.frombuffer(r[f"{k}_{s}"], t)  # noqa: B023, E731
                a, b = get("ids", "a", np.int64), get("ids", "b", np.int64)
                few = np.flatnonzero(~get("core", "a", bool))
                x, y = (get("vectors", s, np.float64).reshape(len(i), -1) for s, i in (("a", a), ("b", b)))
                hit = (x[few] @ y.T >= least) & (a[few][:, None] != b[None, :])
                links = hit @ get("weights", "b", np.int64)
                core = np.flatnonzero(get("core", "b", bool))
                back = hit[:, core].T @ get("weights", "a", np.int64)[few]
                yield pa.record_batch([pa.array(np.concatenate((a[few], b[core]))), pa.array(np.concatenate((links, back)).astype(np.int64))], ["class", "links"])

    return run


def vector_components(vectors: DataFrame, least: float = 0.95, window: int = 64, miss: float = 0.01, together: int = 3, seed: int = 5) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows with cosine >= least,
    within its component), component_id (smallest vec_id reachable by links,
    itself included), kept (vec_id = component_id).

    A vector that is null, empty, zero or holds a null, NaN or infinity links
    with nothing; so do vectors of different lengths. Repeated rows and equal
    vectors link with one another. A null vec_id counts as a row, but names a
    component only if all its ids are null (then kept is true). Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    value = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists(value, lambda x: x != 0), F.lit(False))
    while True:
        rows = vectors.select("vec_id", F.when(fine, F.xxhash64(F.lit(seed), "embedding")).alias("class"), "embedding")
        ends = [F.min("embedding").alias("embedding"), F.max("embedding").alias("other")]
        classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), *ends)
        classes = scratch.keep(classes, "classes")
        if classes.where("embedding <> other").isEmpty():
            break
        seed += 1  # two vectors share a hash: another seed

    # A pass that tells a vector apart by so many bits leaves its links out with
    # this chance; its log adds up over the passes.
    q, goal = agreement(least), math.log(miss)
    rest, n, first, edges = classes.select("class", "embedding", F.lit(0.0).alias("left_out")), classes.count(), 0, []
    need = passes(n, window, least, miss)
    while n > CHEAP * window * need:
        count = min(together, need)
        signed = rest.select("class", "embedding").mapInArrow(_sign(first, count, seed), f"pass int, dim int, sig long, tie double, class long, embedding {classes.schema['embedding'].dataType.simpleString()}")
        parts = max(1, min(partitions(spark), n * count // (32 * window)))
        dealt = signed.repartitionByRange(parts, "pass", "dim", "sig", "tie").sortWithinPartitions("pass", "dim", "sig", "tie")
        found = dealt.mapInArrow(_compare(window, least), f"kind int, part int, pos long, pass int, dim int, a long, b long, embedding {classes.schema['embedding'].dataType.simpleString()}")
        found = scratch.keep(found, "windows")
        edges.append(found.where("kind = 0").select("a", "b"))
        spans = found.where("kind = 3").select("a", "pass", F.col("pos").cast("int").alias("bits"))
        if parts > 1 or found.where("part > 0").limit(1).count():
            side = found.where("kind IN (1, 2)").withColumn("border", F.col("part") - (F.col("kind") == 1).cast("int"))
            met = scratch.keep(side.groupBy("border").applyInArrow(_border(window, least), "a long, b long, pass int, bits int"), "borders")
            edges.append(met.where("b IS NOT NULL").select("a", "b"))
            spans = spans.unionByName(met.where("b IS NULL").select("a", "pass", "bits"))
        # Both spans of a vector are known, and tell it apart; else the pass does not count.
        told = spans.groupBy("a", "pass").agg(F.max("bits").alias("bits"), F.count(F.lit(1)).alias("sides")).where("sides = 2 AND bits < 64")
        told = told.groupBy("a").agg(F.sum(F.log1p(-F.pow(F.lit(q), F.greatest(F.col("bits") + 1, F.lit(1))))).alias("more"))
        after = rest.join(told.withColumnRenamed("a", "class"), "class", "left")
        after = after.select("class", "embedding", (F.col("left_out") + F.coalesce("more", F.lit(0.0))).alias("left_out"))
        rest, first = scratch.keep(after.where(F.col("left_out") > goal), "rest"), first + count
        n, mean = rest.agg(F.count(F.lit(1)), F.avg("left_out")).first()
        # Passes that those left need at their pace so far; at least one.
        need = max(1, math.ceil(first * (goal / min(mean, -1e-9) - 1))) if n else 1
    if n:
        edges.append(_in_full(rest, n, least))
    union = edges[0] if edges else spark.createDataFrame([], "a long, b long")
    for e in edges[1:]:
        union = union.unionByName(e)
    roots = scratch.keep(components(scratch, union), "roots")
    counted = _links(scratch, classes, roots, least)

    own = classes.select("class", "rep", "n").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    own = scratch.keep(own.join(counted, "class", "left"), "own")
    low = scratch.keep(own.groupBy("root").agg(F.min("rep").alias("low")), "lows")
    named = scratch.keep(own.join(low, "root").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "low"), "named")
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(scratch: Scratch, classes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(class, links): the rows of other classes that a class links with."""
    sizes = scratch.keep(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    kind = classes.schema["embedding"].dataType.simpleString()
    members = roots.withColumnRenamed("node", "class").join(sizes, "root").join(classes.select("class", "n", "embedding"), "class")
    members = scratch.keep(members.select("root", "size", "class", "n", "embedding"), "members")
    large = members.where(F.col("size") > BLOCK)
    salted = large.withColumn("salt", F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / (8 * BLOCK))))
    sums = salted.groupBy("root", "salt").applyInArrow(_total, "root long, dim int, total array<double>")
    centres = scratch.keep(sums.groupBy("root").applyInArrow(_sum, "root long, centre array<double>"), "centres")
    marked = members.join(centres, "root", "left").select("root", "size", "class", "n", "embedding", "centre")
    marked = scratch.keep(marked.mapInArrow(_core(least), f"root long, size long, class long, n long, embedding {kind}, core boolean"), "marked")
    inner = scratch.keep(marked.where("core").groupBy("root").agg(F.sum("n").alias("inner")), "inner")

    block = F.pmod(F.xxhash64(F.lit(3), "class"), F.ceil(F.col("size") / BLOCK)).cast("long")
    packed = marked.withColumn("block", block).groupBy("root", "block").applyInArrow(_pack, "root long, block long, rest long, ids binary, weights binary, core binary, vectors binary")
    packed = scratch.keep(packed, "blocks")
    side = lambda s: packed.select("root", *(F.col(c).alias(f"{c}_{s}") for c in ("rest", "ids", "weights", "core", "vectors")))
    pairs = side("a").where("rest_a > 0").join(side("b"), "root").drop("root", "rest_a", "rest_b")
    hits = pairs.mapInArrow(_count(least), "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))
    core = marked.where("core").join(inner, "root").select("class", (F.col("inner") - F.col("n")).alias("links"))
    return hits.unionByName(core).groupBy("class").agg(F.sum("links").alias("links"))
