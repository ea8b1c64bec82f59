"""Links inside a dense topic, where signs of projections hardly split."""

import numpy as np

from tessera.llm import vector_dedup


def dense(n, planted, cosine, seed, dims=64):
    """A topic of vectors at about this cosine with one another, and near copies
    of the first ones at cosine 0.955."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    own = rng.standard_normal((n, dims - 1))
    x = np.hstack((np.full((n, 1), np.sqrt(cosine)), np.sqrt(1 - cosine) * unit(own)))
    # The copy keeps the topic's share and turns its own part.
    turn = 1 - 0.045 / (1 - cosine)
    side = rng.standard_normal((planted, dims - 1))
    base = unit(own[:planted])
    side = unit(side - (side * base).sum(axis=1)[:, None] * base)
    copies = turn * base + np.sqrt(1 - turn * turn) * side
    return np.vstack((x, np.hstack((np.full((planted, 1), np.sqrt(cosine)), np.sqrt(1 - cosine) * copies))))


def recall(spark, x, planted, **options):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.astype("f4").tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["component_id"] for r in vector_dedup.vector_components(df, **options).collect()}
    n = len(x) - planted
    return np.mean([got[i] == got[n + i] for i in range(planted)])


def test_shared_bits():
    a = np.array([0, -1, 5, 5, 1 << 40, -(1 << 63)], np.int64)
    b = np.array([0, 0, 4, 5, 0, 0], np.int64)
    assert vector_dedup.shared_bits(a, b).tolist() == [64, 0, 63, 64, 23, 0]


def test_dense_topic_in_full(spark):
    assert recall(spark, dense(6000, 200, 0.8, 1), 200) == 1


def test_dense_topic_by_passes(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHEAP", 0.7)
    assert recall(spark, dense(3000, 200, 0.5, 2), 200, window=16) >= 0.97
