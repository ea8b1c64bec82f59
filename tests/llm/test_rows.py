"""Stages of the pipeline keep rows, not doc_ids: repeated and null ids, equal
rows, empty tables, clashing names, long texts, against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, language, mixing, vector_dedup
from tessera.llm.common import Scratch, shared_dir

#: Columns of documents, and names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark long, row string, content string, digest string, keep_id long, copies int, nth int, size long, key string, root long, n long"
BASE = [f"w{i}" for i in range(60)]


def near(i):
    return " ".join([*BASE[:i], "other", *BASE[i + 1 :]])


def rows():
    texts = [
        (7, "same text"), (7, "Same Text"), (None, "same text"), (3, "same text"), (5, None), (5, ""), (None, None), (9, " \n"), (7, "another thing said"),
        (4, " ".join(BASE)), (4, near(0)), (2, near(59)), (2, near(59)), (None, near(30)), (11, "z " * 5_000), (12, "z " * 5_000), (8, "é è ü"), (8, "12 34"),
    ]
    return [(d, t, "en", [None, "a", "b"][k % 3], 1, 2, 3, "r", "c", "d", 4, 5, 6, 7, "k", 8, 9) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def low(t):
    return exact_dedup_lower(t or "")


def exact_dedup_lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string")], ids=["sha256", "clashing"])
def test_exact_keeps_one_row_of_equal_texts(docs, digest):
    got = exact_dedup.drop_exact_copies(docs, digest=digest)
    assert got.columns == docs.columns
    best = {}
    for r in rows():
        best[low(r[1])] = max(best.get(low(r[1]), -1), -1 if r[0] is None else r[0])
    kept = collections.Counter((r["doc_id"], low(r["text"])) for r in got.collect())
    assert kept == collections.Counter((None if d < 0 else d, t) for t, d in best.items())
    assert not bag(got) - bag(docs)
    groups = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, digest=digest).collect()}
    assert (3, 7, 4) in groups and (9, 9, 1) in groups
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_near_keeps_one_row_a_component(docs):
    got = jaccard_join.drop_near_copies(docs)
    assert got.columns == docs.columns and not bag(got) - bag(docs)
    kept = collections.Counter(r["doc_id"] for r in got.collect() if (r["text"] or "").strip())
    # same text (3), another thing (7), the near copies (2), z (11), two of 8
    assert kept == collections.Counter({3: 1, 7: 1, 2: 1, 11: 1, 8: 2})
    assert sum(1 for r in got.collect() if not (r["text"] or "").strip()) == 4  # blank rows stay
    assert jaccard_join.drop_near_copies(docs.limit(0)).count() == 0


def test_repeats_follow_the_draw(docs):
    got = mixing.repeat_documents(docs)
    assert got.columns == docs.columns
    drawn = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        drawn[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    told = collections.Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in got.collect())
    assert +told == +drawn
    assert bag(got).keys() <= bag(docs).keys()
    assert mixing.repeat_documents(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(["w"] * int(rng.integers(1, 90))), f"s{int(rng.integers(0, 5))}") for i in range(600)]
    data += [(1000, "w " * 3, "tiny"), (1001, "w " * 5, None)]
    got = mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    # targets by hand: weights 1, 2, 3 repeating in code point order, null last
    order = sorted((s for s in sizes if s is not None)) + [None]
    weigh = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full = {}
    while True:
        room = sum(sizes.values()) - sum(full.values())
        share = sum(weigh[s] for s in order if s not in full)
        goal = {s: full.get(s, room * weigh[s] / share) for s in order}
        over = {s: 3.0 * sizes[s] for s in order if s not in full and goal[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)


def test_language_judges_rows(spark, docs):
    model = language.train(["the of and to in that is was " * 20, "le la les des une est dans que " * 20] * 6, ["en", "fr"] * 6)
    data = [(1, "the and that was in the of", 5), (1, "le la les une des", 6), (None, "the of and is", 7), (2, "12 34", 8), (3, None, 9), (4, "the of that " * 3_000, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, letter long")
    got = language.keep_known(df, model)
    assert got.columns == df.columns
    assert bag(got) == collections.Counter([data[0], data[1], data[2], data[5]])
    assert language.keep_known(df.limit(0), model).count() == 0
    assert language.keep_known(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0  # nothing learned


def test_language_gradient():
    """The gradient over chains is that of the log-likelihood, by differences."""
    rng = np.random.default_rng(1)
    score, step = rng.standard_normal((language.WINDOW, 3)), rng.standard_normal((3, 3))
    truth = rng.integers(0, 3, language.WINDOW)
    chain = np.arange(language.WINDOW)[None, :].copy()
    chain[0, 40:] = -1

    def loss(s, a):
        m = s[0]
        for t in range(1, 40):
            m = np.log(np.exp(m[:, None] + a).sum(axis=0)) + s[t]
        gold = s[np.arange(40), truth[:40]].sum() + a[truth[:39], truth[1:40]].sum()
        return np.log(np.exp(m).sum()) - gold

    words, per, steps = language._chains(np.exp(score), np.exp(step), chain, truth)
    for t, j in ((0, 0), (17, 2), (39, 1)):
        s = score.copy()
        s[t, j] += 1e-5
        assert per[list(words).index(t), j] == pytest.approx((loss(s, step) - loss(score, step)) / 1e-5, abs=1e-3)
    a = step.copy()
    a[1, 2] += 1e-5
    assert steps[1, 2] == pytest.approx((loss(score, a) - loss(score, step)) / 1e-5, abs=1e-3)


def test_vector_components(spark):
    """component_id and kept against brute force."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 32))
    for i in range(0, 300, 3):  # chains of three near copies
        x[i + 1] = x[i] + 0.03 * rng.standard_normal(32) * np.linalg.norm(x[i]) / 5
        x[i + 2] = x[i + 1] + 0.03 * rng.standard_normal(32) * np.linalg.norm(x[i]) / 5
    ids = rng.permutation(400)
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.vector_components(df, window=16).collect()}
    y = x / np.linalg.norm(x, axis=1)[:, None]
    link = y @ y.T >= 0.95
    root = np.arange(400)
    for _ in range(400):
        new = np.array([root[link[i]].min() for i in range(400)])
        if np.array_equal(new, root):
            break
        root = new
    names = {r: min(int(ids[i]) for i in range(400) if root[i] == r) for r in set(root)}
    want = {int(ids[i]): (int(link[i].sum()) - 1, names[root[i]], names[root[i]] == int(ids[i])) for i in range(400)}
    assert sum(w[0] > 0 for w in want.values()) > 200
    assert got == want


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_scratch_goes_when_cleared(spark):
    scratch = Scratch(spark, "gone")
    path = scratch.keep(spark.range(3), "x").scratch_path
    scratch.clear()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
