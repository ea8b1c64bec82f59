"""Language ID of words and texts by a linear-chain conditional random field.

Each word is a place of the chain, each language a label. A word's score for a
label adds up learned weights of its character trigrams (with its edges), its
prefix and suffix of three, and itself (the lexicon), all hashed; neighbours add
learned transition weights. Forward-backward gives every word's posterior, and a
text's language is the one with the largest mean posterior, so a text that
switches codes is judged by all its words.

Forward-backward is exact for texts of any length, yet takes few steps: words
are laid in rows of ROW, the product of each row's transfer matrices carries the
messages from row to row, and all rows then run side by side.

Training: on the driver, on at most `sample` labelled texts in seeded order and
`windows` seeded windows of WINDOW words of each, and as many spliced from two
languages, so that the transitions see switches. A step's gradient covers all
chains, added up over blocks of them, so that memory holds one block's messages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.chars import Frame, frames, ngrams, whole
from tessera.llm.common import labelled_sample, tidied, tidy, utf8

ROW, WINDOW = 128, 48
#: Bytes of text that are judged at a time; a longer text is alone.
BLOCK = 1 << 20
#: Chains and words that training works on at a time.
CHAINS, WORDS = 1024, 32768
TRI, AFFIX, LEXICON = 15, 15, 16


@dataclass
class Model:
    labels: list[str]
    tri: np.ndarray
    affix: np.ndarray
    lexicon: np.ndarray
    step: np.ndarray  # transition weights, from (row) to (column)


def features(f: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte of a word the bucket of the trigram about it; per word the
    buckets of prefix, suffix (with edges) and the word."""
    tri = ngrams(f.byte, 3, TRI)[np.flatnonzero(f.byte != 0x20) - 1]
    four = ngrams(f.byte, 4, AFFIX - 1)
    affix = np.stack((four[f.start - 1], four[np.maximum(f.end - 3, f.start - 1)] + (1 << AFFIX - 1)), axis=1)
    return tri.astype(np.int64), affix.astype(np.int64), whole(f, LEXICON).astype(np.int64)


def emissions(model: Model, f: Frame) -> np.ndarray:
    """(words, labels) scores."""
    if not len(f.start):
        return np.zeros((0, len(model.labels)), np.float32)
    tri, affix, lex = features(f)
    first = np.append(0, np.cumsum(f.end - f.start))
    out = model.affix[affix[:, 0]] + model.affix[affix[:, 1]] + model.lexicon[lex]
    for i in range(0, len(out), WORDS):  # a table of trigram weights for some words at a time
        j = min(i + WORDS, len(out))
        out[i:j] += np.add.reduceat(model.tri[tri[first[i] : first[j]]], first[i:j] - first[i], axis=0)
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(score: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of each word; first: the texts' ranges."""
    n, k = score.shape
    e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    a = np.exp(step.astype(np.float64))
    size = np.diff(first)
    rows = -(-size // ROW)
    text = np.repeat(np.arange(len(size)), rows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    at = first[:-1][text] + nth * ROW
    long = np.minimum(ROW, first[1:][text] - at)
    # All rows as long as the longest; rows by length, so that the live ones lead.
    order = np.argsort(-long, kind="stable")
    at, long, text, nth = at[order], long[order], text[order], nth[order]
    live = [int(np.searchsorted(-long, -j, "left")) for j in range(ROW + 1)]  # rows longer than j
    move = np.broadcast_to(np.eye(k), (len(at), k, k)).copy()
    for j in range(ROW):
        m = live[j]
        if not m:
            break
        x = move[:m] @ a * e[at[:m] + j][:, None, :]
        move[:m] = x / x.max(axis=(1, 2), keepdims=True)
    # From row to row of each text.
    come, leave = np.full((len(at), k), 1.0 / k), np.ones((len(at), k))
    by = np.lexsort((nth, text))
    base = np.zeros(len(size) + 1, np.int64)
    np.cumsum(rows, out=base[1:])
    most = int(rows.max(initial=0))
    for j in range(1, most):
        t = np.flatnonzero(rows > j)
        here, prior = by[base[t] + j], by[base[t] + j - 1]
        come[here] = _normal(np.einsum("ti,tij->tj", come[prior], move[prior]))
        late, after = by[base[t + 1] - j - 1], by[base[t + 1] - j]
        leave[late] = _normal(np.einsum("tij,tj->ti", move[after], leave[after]))
    forth = np.zeros((n, k))
    x = come
    for j in range(ROW):
        m = live[j]
        if not m:
            break
        y = x[:m] @ a
        if j == 0:
            y[nth[:m] == 0] = 1.0
        x = _normal(y * e[at[:m] + j])
        forth[at[:m] + j] = x
    back = leave.copy()
    out = np.zeros((n, k), np.float32)
    for j in range(ROW - 1, -1, -1):
        m = live[j]
        if not m:
            continue
        y = back[:m]
        out[at[:m] + j] = _normal(forth[at[:m] + j] * y)
        back[:m] = _normal((e[at[:m] + j] * y) @ a.T)
    return out


def _chains(e: np.ndarray, a: np.ndarray, chain: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over a block of chains (words, -1 beyond the end): the
    words, posterior less truth of each, and expected less seen transitions."""
    k = len(a)
    valid = chain >= 0
    hot = np.eye(k)[np.where(valid, truth[chain], 0)] * valid[..., None]
    pairs = valid[:, 1:] & valid[:, :-1]
    e = e[chain]
    e[~valid] = 1.0
    forth, back = np.zeros_like(e), np.zeros_like(e)
    forth[:, 0] = _normal(e[:, 0])
    for t in range(1, WINDOW):
        forth[:, t] = _normal(np.where(valid[:, t, None], (forth[:, t - 1] @ a) * e[:, t], forth[:, t - 1]))
    back[:, -1] = 1.0 / k
    for t in range(WINDOW - 2, -1, -1):
        back[:, t] = _normal(np.where(valid[:, t + 1, None], (e[:, t + 1] * back[:, t + 1]) @ a.T, back[:, t + 1]))
    post = _normal(forth * back) * valid[..., None]
    # Expected transitions, without a table of all pairs of labels per step.
    came, left = forth[:, :-1].reshape(-1, k), (e[:, 1:] * back[:, 1:]).reshape(-1, k)
    weigh = pairs.reshape(-1) / ((came @ a) * left).sum(axis=1)
    seen = np.einsum("bti,btj->ij", hot[:, :-1] * pairs[..., None], hot[:, 1:])
    return chain[valid], (post - hot)[valid], a * ((came * weigh[:, None]).T @ left) - seen


def train(texts: list[str], langs: list[str], windows: int = 4, epochs: int = 40, rate: float = 0.05, seed: int = 3) -> Model:
    """Fit by Adam on the chain's log-likelihood of WINDOW-word windows."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(seed)
    data, offs = utf8(pa.array(texts, pa.string()))
    tris, affixes, lexes, sizes, gold = [], [], [], [], []
    lang = np.array([labels.index(x) for x in langs], np.int64)
    for a, b, f in frames(data, offs, 1 << 18):
        tri, affix, lex = features(f)
        size = f.end - f.start
        start = np.append(0, np.cumsum(size))
        for i in range(b - a):
            lo, hi = int(f.first[i]), int(f.first[i + 1])
            many = min(windows, (hi - lo) // WINDOW + 1) if hi > lo else 0
            for _ in range(many):
                s = lo + int(rng.integers(0, max(1, hi - lo - WINDOW + 1)))
                t = min(hi, s + WINDOW)
                tris.append(tri[start[s] : start[t]].astype(np.int32))
                affixes.append(affix[s:t].astype(np.int32))
                lexes.append(lex[s:t].astype(np.int32))
                sizes.append(size[s:t].copy())
                gold.append(int(lang[a + i]))
    model = Model(labels, *(np.zeros((1 << bits, k), np.float32) for bits in (TRI, AFFIX, LEXICON)), np.zeros((k, k), np.float32))
    if not sizes:
        return model
    tri, affix, lex, size = (np.concatenate(x) for x in (tris, affixes, lexes, sizes))
    count = np.array([len(x) for x in sizes])
    del data, offs, tris, affixes, lexes, sizes
    first = np.append(0, np.cumsum(size))
    lo = np.append(0, np.cumsum(count))
    # Chains: every window alone, and spliced ones of two halves.
    alone = np.full((len(count), WINDOW), -1, np.int64)
    for i, c in enumerate(count):
        alone[i, :c] = np.arange(lo[i], lo[i + 1])
    other = rng.permutation(len(count))
    half = np.where(np.arange(WINDOW)[None, :] < WINDOW // 2, alone, alone[other])
    full = (count >= WINDOW) & (count[other] >= WINDOW)
    chain = np.concatenate((alone, half[full]))
    truth = np.repeat(np.array(gold), count)
    held = int((chain >= 0).sum())
    params = [model.tri, model.affix, model.lexicon, model.step]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    places = len(size)
    for epoch in range(1, epochs + 1):
        e = np.empty((places, k))
        for i in range(0, places, WORDS):
            j = min(i + WORDS, places)
            score = np.add.reduceat(model.tri[tri[first[i] : first[j]]], first[i:j] - first[i], axis=0) + model.affix[affix[i:j]].sum(axis=1) + model.lexicon[lex[i:j]]
            e[i:j] = np.exp(score - score.max(axis=1, keepdims=True))
        a = np.exp(model.step.astype(np.float64))
        per, steps = np.zeros((places, k)), np.zeros((k, k))
        for i in range(0, len(chain), CHAINS):
            flat, g, more = _chains(e, a, chain[i : i + CHAINS], truth)
            steps += more
            for j in range(k):
                per[:, j] += np.bincount(flat, g[:, j], places)
        scale = 1.0 / held
        per *= scale
        grads = [
            np.stack([np.bincount(tri, np.repeat(per[:, j], size), 1 << TRI) for j in range(k)], axis=1),
            np.stack([np.bincount(affix.reshape(-1), np.repeat(per[:, j], 2), 1 << AFFIX) for j in range(k)], axis=1),
            np.stack([np.bincount(lex, per[:, j], 1 << LEXICON) for j in range(k)], axis=1),
            steps * scale,
        ]
        for p, grad, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= (rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)).astype(np.float32)
    return model


def judge(model: Model, text: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text; letter: whether it holds a letter."""
    labels = np.array([*model.labels, "und"], object)
    data, offs = utf8(text)
    langs, scores = [np.zeros(0, object)], [np.zeros(0)]
    for a, b, f in frames(data, offs, BLOCK):
        mean = np.zeros((b - a, len(model.labels)))
        if len(f.start) and model.labels:
            post = posteriors(emissions(model, f), model.step, f.first)
            size = np.diff(f.first)
            some = np.flatnonzero(size)
            mean[some] = np.add.reduceat(post, f.first[:-1][some], axis=0, dtype=np.float64) / size[some, None]
        best = mean.argmax(axis=1) if model.labels else np.zeros(b - a, np.int64)
        known = letter[a:b].astype(bool) & (mean.sum(axis=1) > 0)
        langs.append(labels[np.where(known, best, len(model.labels))])
        scores.append(np.clip(np.where(known, mean.max(axis=1, initial=0.0), 0.0), 0.0, 1.0))
    return np.concatenate(langs), np.concatenate(scores)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = judge(model, batch.column(2), batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
        tidy()

    return run


def _known(model: Model, text: int, least: float):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = judge(model, batch.column(0).field(text), batch.column(1).to_numpy(zero_copy_only=False))
            yield batch.select([0]).filter(pa.array((lang != "und") & (score >= least)))

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample: int = 3000, most_chars: int = 4_000_000, windows: int = 4) -> Model:
    """Train on at most `sample` texts that are not held out, evenly by language,
    in seeded order, and on about most_chars characters of them, of which at most
    `windows` seeded windows of WINDOW words a text are read."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select(F.col("lang").alias("label"), "doc_id", "text")
    got = labelled_sample(rows, sample, most_chars, seed=9)
    return train([r["text"] for r in got], [r["label"] for r in got], windows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score.

    Text that is null or has no letter is `und` with score 0, as is every text
    when nothing was learned. score is the mean posterior of the language over
    the text's words. Repeated rows give repeated rows; other columns are not
    read.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None = None, least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of at
    least `least`.

    Every row is judged by its own text, so repeated and null ids are rows like
    any other. Rows whose text is null or has no letter go; so do all rows when
    nothing was learned, as where no row has a lang.
    """
    made = model or learn(docs)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), letter.alias("letter"))
    held = T.StructType([T.StructField("row", docs.schema)])
    return rows.mapInArrow(_known(made, docs.columns.index("text"), least), held).select("row.*")
