"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly.

A text is the bag of its distinct words' character n-grams (3 to 5 bytes with the word's
edges) and its whole words, hashed to buckets; every bucket has an embedding,
the text is their average, and a linear softmax over the average gives the
score. A misspelling that was never seen shares most n-grams with what it
misspells. Embeddings and softmax learn together, by Adam on mini-batches.

At prediction the softmax of an average is the average of one number a bucket
(its embedding times the difference of the two class vectors), so scoring a text
is one look-up and one addition for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.chars import Frame, frames, ngrams, once, whole
from tessera.llm.common import sampled_ids, utf8

BITS, SIZES = 16, (3, 4, 5)
BUCKETS = (len(SIZES) + 1) << BITS


@dataclass
class Model:
    weight: np.ndarray  # one number a bucket
    bias: float
    prior: float  # the score of an empty bag


def bags(f: Frame) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the n-grams and words of each text's distinct words."""
    at = once(f)
    start, end = f.start[at], f.end[at]
    size = np.diff(f.first)
    text = np.repeat(np.arange(len(size)), size)[at]
    # From the space before each word on, the place of the space after it.
    n, span = len(f.byte), end - start + 1
    place = np.arange(span.sum()) + np.repeat(start - 1 - (np.cumsum(span) - span), span)
    close, of = np.repeat(end, span), np.repeat(text, span)
    out, where = [whole(f, BITS)[at].astype(np.int64) + (len(SIZES) << BITS)], [text]
    for i, k in enumerate(SIZES):
        ok = place + k - 1 <= close
        out.append(ngrams(f.byte, k, BITS)[place[ok]].astype(np.int64) + (i << BITS))
        where.append(of[ok])
    return np.concatenate(out), np.concatenate(where)


def train(texts: list[str | None], toxic: list[int], dim: int = 8, epochs: int = 24, rate: float = 0.02, batch: int = 64, decay: float = 1e-4, least: int = 3, keep: float = 0.15, seed: int = 3) -> Model:
    """Fit on texts and labels (1: toxic). The settings were chosen on a split
    inside the rows that are not held out (README)."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.int64)
    weight = np.zeros(BUCKETS, np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return Model(weight, float(np.log(prior / (1 - prior))), prior)
    data, offs = utf8(pa.array(texts, pa.string()))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, f in frames(data, offs, 1 << 20):
        bucket, text = bags(f)
        key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
        edge = np.searchsorted(key, np.arange(b - a + 1) * BUCKETS)
        rows += [((key[s:t] % BUCKETS).astype(np.int32), (count[s:t] / max(1, count[s:t].sum())).astype(np.float32)) for s, t in zip(edge[:-1], edge[1:], strict=True)]
    # Buckets of fewer than `least` texts say nothing of others: they stay at zero.
    held = np.bincount(np.concatenate([i for i, _ in rows]), minlength=BUCKETS) >= least
    rows = [(i[held[i]], v[held[i]]) for i, v in rows]
    emb = rng.uniform(-0.1, 0.1, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    m1, v1 = np.zeros_like(emb), np.zeros_like(emb)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (out, bias)]
    weigh = (len(y) / (2.0 * np.bincount(y, minlength=2)))[y]
    step = 0
    full = [i for i in range(len(y)) if len(rows[i][0])]
    for _ in range(epochs):
        order = rng.permutation(full)
        for s in range(0, len(order), batch):
            step += 1
            own = order[s : s + batch]
            # A seeded share of each bag at a time: no text can be known by one n-gram.
            part = [rng.random(len(rows[i][0])) < keep for i in own]
            own, part = own[[p.any() for p in part]], [p for p in part if p.any()]
            if not len(own):
                continue
            idx = np.concatenate([rows[i][0][p] for i, p in zip(own, part, strict=True)])
            val = np.concatenate([rows[i][1][p] for i, p in zip(own, part, strict=True)])[:, None] / np.float32(keep)
            first = np.append(0, np.cumsum([p.sum() for p in part]))[:-1]
            used, back = np.unique(idx, return_inverse=True)
            mean = np.add.reduceat(emb[idx] * val, first, axis=0)
            score = SCALE * mean @ out + bias
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            g = (p * weigh[own, None] / len(own)).astype(np.float32)
            gm = SCALE * g @ out.T
            each = np.repeat(gm, np.diff(np.append(first, len(idx))), axis=0) * val
            ge = np.stack([np.bincount(back, each[:, j], len(used)) for j in range(dim)], axis=1).astype(np.float32) + decay * emb[used]
            fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            m1[used] += 0.1 * (ge - m1[used])
            v1[used] += 0.01 * (ge * ge - v1[used])
            emb[used] -= rate * fix * m1[used] / (np.sqrt(v1[used]) + 1e-8)
            for q, gq, (m, v) in zip((out, bias), (SCALE * mean.T @ g, g.sum(axis=0)), state, strict=True):
                m += 0.1 * (gq - m)
                v += 0.01 * (gq * gq - v)
                q -= (rate * fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    weight = np.where(held, SCALE * emb @ (out[:, 1] - out[:, 0]), 0)
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]), prior)


#: The average of many n-grams is small; the softmax sees it at this scale.
SCALE = np.float32(20.0)


def scores(model: Model, f: Frame, n: int) -> np.ndarray:
    bucket, text = bags(f)
    total = np.bincount(text, model.weight[bucket], n)
    count = np.bincount(text, minlength=n)
    out = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -40, 40)))
    return np.where(count > 0, out, min(model.prior, 0.499))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for a, b, f in frames(data, offs, 2 << 20):
                part, s = batch.slice(a, b - a), scores(model, f, b - a)
                yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_chars: int = 8_000_000) -> Model:
    """Train on at most `sample` labelled texts (about most_chars characters)
    that are not held out, as many of either label as there are, up to half.
    Labels meet ids and lengths only; the texts of the sampled ids come after."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    ids = sampled_ids(texts.select("doc_id", F.length("text").alias("n")).join(own, "doc_id"), sample, most_chars, seed=21)
    got = texts.where(F.col("doc_id").isin([*ids])).collect() if ids else []
    got.sort(key=lambda r: (r["doc_id"], str(ids[r["doc_id"]]), r["text"]))
    return train([r["text"] for r in got], [ids[r["doc_id"]] for r in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1), predicted.

    Empty, blank or null text scores the share of toxic texts learned from,
    below 0.5. Repeated rows give repeated rows; other columns are not read.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, score double, predicted int")
