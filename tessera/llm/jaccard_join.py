"""N-gram Jaccard join by token-combination prefixes.

Texts with one word sequence form a class, joined once. Then:

1. Global token frequencies: every class sends its distinct shingles, packed in
   blocks per hash bucket; a bucket finds the shingles that several classes
   hold. A shingle of one class can be in no intersection, so a class goes on
   only if at least 75 of 100 of its shingles are shared. Shingles that a sketch
   over all texts shows as very common skip the buckets (they are known to be
   shared), so that no bucket collects one of them.
2. Prefixes: shingles are ordered by frequency class, then hash. A class indexes
   each rare shingle of its prefix alone. Where a prefix reaches frequent
   shingles it is extended by B and indexes pairs of them within B subclasses:
   similar sets whose common prefix shingles are all frequent share at least
   B + 1 of those, so two in one subclass. Sets too small for that (one shingle)
   index the shingle itself, however frequent.
3. Verification: a parity bitmap of each set bounds the difference of two sets
   from below, which refutes most candidates in the JVM; the others are compared
   on all their shared shingles. The result is the partition into components,
   so in rounds every list is reduced to one seeded member of each component it
   holds, which is compared with that of its largest component (linear in the
   list); components are contracted, and rounds go on while they leave clearly
   fewer members to compare. Pairs that are still in different components are
   then verified in full; a list of one component needs no comparison.

Nothing is dropped or capped; the order of steps only saves comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.common import Scratch, binary, components, lean, mix, tidied, tidy, utf8

U = np.uint64
#: Shingles per hash bucket, of which there are 32 at least.
BUCKET = 1_500_000
#: The sketch keeps so many counters a task; common means over total / COMMON.
COUNTERS, COMMON = 1 << 15, 1 << 17
#: From this frequency on, prefixes index pairs of shingles.
FREQUENT = 32
#: Longs of a parity bitmap; index entries of a sketch.
WORDS, SKETCH = 16, 8
#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"
#: Rounds of representatives go on while they leave at most this share.
SHRINK = 0.8


def _class(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _survey(seed: int, sketch: bool):
    """Rows of documents as (doc_id, mark, digest, n) and, with null digest,
    counters of common shingles as (shingle, null, null, count)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, val, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), ["id", "mark", "digest", "n"]
        for batch in batches:
            ids = batch.column(0)
            data, offs = utf8(batch.column(1))
            for a, b, low, o in S.text_blocks(data, offs):
                w = S.words(low, o)
                tokens, first = S.distinct(*S.grams(w))
                dig = S.digests(low, o, w, seed)
                n = np.diff(first)
                yield pa.record_batch([ids.slice(a, b - a).cast(pa.int64()), batch.column(2).slice(a, b - a), pa.array(dig, pa.binary()), pa.array(n.astype(np.int64))], names)
                if not sketch:
                    continue
                _, once = np.unique(np.array(dig, "S16"), return_index=True)
                some = np.zeros(b - a, bool)
                some[once] = True
                u, c = np.unique(tokens[np.repeat(some, n)], return_counts=True)
                key, val = np.append(key, u[c > 1]), np.append(val, c[c > 1])
                if len(key) > 4 * COUNTERS:
                    key, val = _fold(key, val)
        key, val = _fold(key, val)
        if len(key):
            yield pa.record_batch([pa.array(key.astype(np.int64)), pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.binary()), pa.array(val)], names)

    return run


def _fold(key: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters of equal keys added; of too many, all lose the first excess count."""
    key, at = np.unique(key, return_inverse=True)
    val = np.bincount(at, val, len(key)).astype(np.int64)
    if len(key) > COUNTERS:
        val = val - np.partition(val, -COUNTERS - 1)[-COUNTERS - 1]
        key, val = key[val > 0], val[val > 0]
    return key, val


def _scatter(seed: int, buckets: int, common: np.ndarray):
    """Blocks of (class, shingle) by bucket; common shingles go to buckets below 0."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for _, _, low, o in S.text_blocks(data, offs):
                w = S.words(low, o)
                tokens, first = S.distinct(*S.grams(w))
                if not len(tokens):
                    continue
                dig = S.digests(low, o, w, seed)
                cls, once = np.unique(np.array([_class(d) for d in dig], np.int64), return_index=True)
                n = np.diff(first)
                some = np.zeros(len(n), bool)
                some[once] = True
                rank = np.zeros(len(n), np.int64)
                rank[once] = np.arange(len(once))
                held = np.repeat(some, n)
                tokens, text = tokens[held], np.repeat(rank, n)[held]
                bucket = (tokens % U(buckets)).astype(np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    bucket = np.where(common[at] == tokens, -1 - (mix(cls.view(np.uint64)) % U(buckets)).astype(np.int64)[text], bucket)
                order = np.lexsort((text, bucket))
                tokens, text, bucket = tokens[order], text[order], bucket[order]
                # Runs of one bucket and text; then ranges of runs of one bucket.
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])))
                size = np.diff(np.append(new, len(text))).astype(np.uint32)
                heads = np.flatnonzero(np.append(True, np.diff(bucket[new]) != 0))
                ends = np.append(heads[1:], len(new))
                stop = np.append(new, len(text))
                raw = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :7]
                yield pa.record_batch(
                    [
                        pa.array(bucket[new[heads]].astype(np.int32)),
                        binary(cls[text[new]].view(np.uint8), ends * 8),
                        binary(size.view(np.uint8), ends * 4),
                        binary(raw.reshape(-1), stop[ends] * 7),
                    ],
                    ["bucket", "classes", "sizes", "tokens"],
                )

    return run


def _values(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(dtype)


def frequency_byte(df: np.ndarray) -> np.ndarray:
    """Exact up to 127, then eight steps a doubling, up to 254."""
    far = 128 + 8 * np.log2(np.maximum(df, 128) / 128)
    return np.where(df < 128, df, np.minimum(far, 254)).astype(np.uint64)


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket, the shingles of two or more classes, as one row per class."""
    lean()
    out = _held_twice(table)
    tidy()
    return out


def _held_twice(table: pa.Table) -> pa.Table:
    cls = np.repeat(_values(table["classes"], np.int64), _values(table["sizes"], np.uint32))
    raw = _values(table["tokens"], np.uint8).reshape(-1, 7)
    tokens = np.zeros((len(raw), 8), np.uint8)
    tokens[:, :7] = raw
    del raw
    tokens = tokens.reshape(-1).view(np.uint64)
    if table["bucket"][0].as_py() >= 0:
        order = np.argsort(tokens)
        t = tokens[order]
        del tokens
        same = t[1:] == t[:-1]
        multi = np.zeros(len(t), bool)
        multi[1:] |= same
        multi[:-1] |= same
        t, c = t[multi], cls[order[multi]]
        del cls, order, same, multi
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        one = np.ones(len(t), bool)  # a class counts once
        one[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[one], c[one]
        heads = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        df = np.diff(np.append(heads, len(t)))
        some = np.repeat(df > 1, df)
        t, c, df = t[some], c[some], df[df > 1]
        byte = np.repeat(frequency_byte(df), df)
    else:
        order = np.lexsort((tokens, cls))
        t, c = tokens[order], cls[order]
        del tokens, cls, order
        one = np.ones(len(t), bool)
        one[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[one], c[one]
        byte = np.full(len(t), 255, np.uint64)
    byte <<= U(56)
    t |= byte
    del byte, one
    order = np.argsort(c, kind="stable")
    word, c = t[order], c[order]
    del t, order
    heads = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(c)) if len(c) else heads
    return pa.table({"class": pa.array(c[heads]), "m": pa.array((ends - heads).astype(np.int64)), "part": binary(word.view(np.uint8), ends * 8)})


@tidied
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shared shingles of each class from its parts, how many it has
    for itself, and the parity of its shared shingles per bit of a bitmap."""
    for batch in batches:
        sets = [np.sort(np.frombuffer(b"".join(p), np.uint64)) for p in batch.column(2).to_pylist()]
        odd = np.array([np.packbits(np.bincount((t % U(WORDS * 64)).astype(np.int64), minlength=WORDS * 64).astype(np.uint8) & 1) for t in sets], np.uint8)
        odd = odd.reshape(-1, WORDS * 8).view(np.int64)
        own = batch.column(1).to_numpy() - np.array([len(t) for t in sets], np.int64)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(own), pa.array([t.tobytes() for t in sets], pa.binary()), *(pa.array(odd[:, i]) for i in range(WORDS))],
            ["class", "n", "own", "tokens", *(f"w{i}" for i in range(WORDS))],
        )


def _marks(sets: DataFrame, k: str) -> DataFrame:
    return sets.select(F.col("class").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "own", *(f"w{i}" for i in range(WORDS)))))


def _differ():
    return sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(WORDS)), F.col("own_a") + F.col("own_b"))


def _may_link(percent: int):
    """No link is possible if the bits that differ, a lower bound of the shared
    shingles that do, and the shingles of one class alone are too many."""
    return _differ() * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def subclasses(n: int) -> int:
    """B for sets of which the smaller has n shingles: a power of two by n / 8."""
    return 1 << max(0, (max(n, 8) // 8).bit_length() - 1)


def signatures(n: int, tokens: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of a set: n shingles, of which tokens are shared."""
    m, need = len(tokens), -(-percent * n // 100)
    base = tokens[: max(0, m - need + 1)]
    frequent = U(FREQUENT) << U(56)
    sizes = {subclasses(k) for k in (-(-percent * n // 100), n)}
    # Sets that need not share B + 1 shingles may share no pair of a subclass.
    out = [base if need <= max(sizes) else base[base < frequent]]
    if len(base) and base[-1] >= frequent:
        for b in sizes:
            far = tokens[: m - need + b + 1]
            far = far[far >= frequent]
            if len(far) <= b:
                continue
            sub = (far % U(b)).astype(np.int64)
            order = np.argsort(sub, kind="stable")
            far, sub = far[order], sub[order]
            for gap in range(1, int(np.bincount(sub).max())):
                both = sub[gap:] == sub[:-gap]
                out.append(mix(mix(far[:-gap][both]) * U(3) + far[gap:][both] + U(b)))
    return np.concatenate(out)


def _index(percent: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sigs = [signatures(int(k), np.frombuffer(t, np.uint64), percent) for k, t in zip(n, batch.column(2).to_pylist(), strict=True)]
            size = [len(s) for s in sigs]
            yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64) if sigs else [], pa.int64()), pa.array(np.repeat(cls, size)), pa.array(np.repeat(n, size))], ["sig", "class", "n"])

    return run


def _verify(percent: int):
    """(a, b, linked) of rows (a, b, n_a, n_b, tokens_a, tokens_b)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            both = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                z = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                z.sort(kind="stable")
                both.append(np.count_nonzero(z[1:] == z[:-1]))
            both = np.array(both, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(100 * both >= percent * (n - both))], ["a", "b", "linked"])

    return run


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links of Jaccard similarity >= percent / 100, itself
    included).

    Words are runs of all but the six ASCII white-space characters, A-Z
    lower-cased; a set is the distinct five-word shingles, of fewer words the
    whole sequence. Null, empty or blank text has n_shingles 0 and links with
    nothing. A null doc_id takes part, but names a component only if all its
    ids are null. Repeated rows give repeated rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, rooted = _members(scratch, docs, percent)
    lows = scratch.keep(rooted.where("n > 0").groupBy("root").agg(F.min("rep").alias("low")), "lows")
    named = scratch.keep(rooted.join(lows, "root").select("class", "low"), "named")
    out = members.select("id", "class", "n").join(named, "class", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"))


def _members(scratch: Scratch, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (id, mark: a hash of the text, class, n, root), and
    their classes as (class, rep: the smallest id, n, root)."""
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    seed = 0
    while True:
        survey = text.mapInArrow(_survey(seed, True), "id long, mark long, digest binary, n long")
        survey = scratch.keep(survey, "survey")
        slim = survey.where("digest IS NOT NULL").withColumn("class", _class_column())
        one = slim.groupBy("class").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.min("id").alias("rep"), F.max("n").alias("n"))
        classes = scratch.keep(one, "classes")
        if classes.where("lo <> hi").isEmpty():
            break
        seed += 1  # two texts share 64 bits of the digest: another salt

    total = classes.agg(F.sum("n")).first()[0] or 0
    floor = max(64, total // COMMON)
    counters = survey.where("digest IS NULL").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= floor)
    # At most total / floor shingles can be so common: COMMON of eight bytes.
    common = np.sort(np.array([r["id"] for r in counters.select("id").collect()], np.int64).view(np.uint64))

    # As many partitions as buckets: what a task reads does not grow with the table.
    buckets = max(32, -(-total // BUCKET))
    blocks = text.select("text").mapInArrow(_scatter(seed, buckets, common), "bucket int, classes binary, sizes binary, tokens binary")
    parts = blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared, "class long, m long, part binary")
    sets = parts.groupBy("class").agg(F.sum("m").alias("m"), F.collect_list("part").alias("parts"))
    sets = sets.join(classes.select("class", "n"), "class").where(F.col("m") * 100 >= F.col("n") * percent).select("class", "n", "parts")
    sets = scratch.keep(sets.mapInArrow(_gather, "class long, n long, own long, tokens binary, " + ", ".join(f"w{i} long" for i in range(WORDS))), "sets")

    sigs = sets.select("class", "n", "tokens").mapInArrow(_index(percent), "sig long, class long, n long")
    sigs = scratch.keep(sigs.select("sig", "class"), "signatures")
    near = _links(scratch, sets, sigs, percent)
    rooted = classes.select("class", "rep", "n").join(near.withColumnRenamed("node", "class"), "class", "left")
    rooted = scratch.keep(rooted.withColumn("root", F.coalesce("root", "class")), "rooted")
    return slim.select("id", "mark", "class", "n").join(rooted.select("class", "root"), "class", "left"), rooted


def _class_column():
    """The first eight bytes of the digest, big-endian, as a long."""
    return F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")


def _links(scratch: Scratch, sets: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(node, root) over the classes that have a link."""
    spark = scratch.spark
    tested = None
    roots = spark.createDataFrame([], "node long, root long")

    def check(pairs: DataFrame) -> None:
        nonlocal tested, roots
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "pairs")
        left, right = (sets.select(F.col("class").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}")) for k in "ab")
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b")
        done = scratch.keep(rows.mapInArrow(_verify(percent), "a long, b long, linked boolean"), "tested")
        tested = done if tested is None else tested.unionByName(done)
        if not done.where("linked").isEmpty():
            links = tested.where("linked").select("a", "b")
            roots = scratch.keep(components(scratch, links), "components")

    # Lists that hold several components; the others are settled.
    lists, before, k = sigs.withColumn("root", F.col("class")), None, 0
    while True:
        # Of each component of a list a seeded member: in the first round the same
        # one in all lists, so that few pairs arise; then another in each list.
        seeded = F.xxhash64(F.lit(k), "class") if k == 0 else F.xxhash64(F.lit(k), "sig", "class")
        held = scratch.keep(lists.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(seeded.alias("h"), "class"))["class"].alias("a")), "held")
        most = F.max(F.struct("size", F.xxhash64("root"), "root", "a"))
        tops = held.groupBy("sig").agg(most.alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1")
        tops = scratch.keep(tops.select("sig", F.col("x.root").alias("top"), F.col("x.a").alias("b")), "tops")
        others = scratch.keep(held.join(tops, "sig").where("root <> top").select("sig", "root", "a", "b"), "others")
        n = others.count()
        if not n:
            return roots
        mixed = scratch.keep(lists.join(tops.select("sig", "top"), "sig"), "mixed")
        if before is not None and n > SHRINK * before:
            break
        check(others.select("a", "b").distinct().join(_marks(sets, "a"), "a").join(_marks(sets, "b"), "b").where(_may_link(percent)))
        own = mixed.select("sig", "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
        lists, before, k = scratch.keep(own.select("sig", "class", F.coalesce("root", "class").alias("root")), "lists"), n, k + 1
    # In full: members outside a list's largest component against its members. A
    # pair comes from the least list that both sketches hold, not from each list
    # that both are in.
    few = mixed.where("root <> top").select("sig", F.col("class").alias("a"), F.col("root").alias("r"))
    many = mixed.select("sig", F.col("class").alias("b"), "root")
    least = scratch.keep(sigs.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, SKETCH).alias("least")), "sketches")
    side = lambda t, c: scratch.keep(t.join(_marks(sets, c), c).join(least.select(F.col("class").alias(c), F.col("least").alias(f"least_{c}")), c), "full")
    first = F.coalesce(F.array_min(F.array_intersect("least_a", "least_b")) >= F.col("sig"), F.lit(True))
    pairs = side(few, "a").join(side(many, "b"), "sig")
    check(pairs.where("r <> root").where(_may_link(percent)).where(first).select("a", "b"))
    return roots


def drop_near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of docs, all columns, of each component: that with the smallest
    doc_id; rows without words stay, all of them.

    A null doc_id counts as larger than any other. Of rows that share component
    and doc_id the one with the smallest hash of its text stays; of equal rows
    under one doc_id, one. Columns of any other names pass through.
    """
    scratch = Scratch(docs.sparkSession, "near-rows")
    members, _ = _members(scratch, docs, percent)
    least = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "mark")).alias("low")
    best = members.where("n > 0").groupBy("root").agg(least).select(F.col("low.id").alias("low_id"), F.col("low.mark").alias("low_mark"))
    best = scratch.keep(best, "best")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.coalesce(F.col("text"), F.lit("")).rlike(WORD).alias("worded"))
    out = rows.where("worded").join(best, F.col("id").eqNullSafe(F.col("low_id")) & (F.col("mark") == F.col("low_mark")), "left_semi")
    blank = rows.where("NOT worded").select("row.*")
    again = scratch.keep(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return out.select("row.*").unionByName(blank)
    twice = F.col("id").eqNullSafe(F.col("doc_id"))
    one = out.join(again, twice, "left_semi").groupBy("id", "mark").agg(F.max_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return out.join(again, twice, "left_anti").select("row.*").unionByName(one.select("row.*")).unionByName(blank)
