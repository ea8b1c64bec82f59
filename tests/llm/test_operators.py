"""The ten operators against brute force on small tables with odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest

from tessera.llm import exact_dedup, jaccard_join, language, licenses, mixing, packing, token_output, toxicity, url_templates, vector_dedup
from tessera.llm.common import Scratch, components
from tessera.llm.queries import RULES, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, root long, class long"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "gamma,", "delta", "eps", "Zeta.", "eta", "théta", "iota\n", "kappa"]
    text = lambda n: " ".join(rng.choice(words, n))
    long = text(3000)
    base = text(60).split(" ")
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (0, 59, 30)]
    texts = [None, "", "  \n\t", "one", "One", "a b c d e", "A b c d e", "a b c d", long, long.upper(), " ".join(base), *near, text(40), text(40), "x" * 5000, "\x01 a \x01b  c", "é è", "12 34"]
    out = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s1"][i % 4], 1, 2, "d", 3, 4) for i, t in enumerate(texts)]
    return [*out, out[8], (None, "one", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").translate(LOWER)


def test_exact(docs, none):
    got = collections.Counter(tuple(r) for r in exact_dedup.exact_groups(docs).collect())
    groups = collections.defaultdict(list)
    for r in rows():
        groups[low(r[1])].append(r[0])
    want = collections.Counter()
    import hashlib

    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_jaccard(docs, none):
    sets = []
    for r in rows():
        w = WORD.findall(low(r[1]))
        sets.append((r[0], {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        names[find(i)].append(d)
    name = lambda i: min((d for d in names[find(i)] if d is not None), default=None)
    want = sorted((repr((d, len(s), name(i) if s else d)) for i, (d, s) in enumerate(sets)))
    assert sorted(repr(tuple(r)) for r in jaccard_join.jaccard_components(docs).collect()) == want
    assert jaccard_join.jaccard_components(none).count() == 0


def test_signatures_meet():
    """Similar sets share an index entry, also where all shingles are frequent."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        pool = rng.choice(2**50, 2 * n, replace=False).astype(np.uint64) | rng.choice([2, 40, 90, 255], 2 * n).astype(np.uint64) << np.uint64(56)
        a = pool[:n]
        cut = int(rng.integers(0, n // 4 + 1))
        b = np.append(a[: n - cut], pool[n : n + int(rng.integers(0, n // 8 + 1))])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = (jaccard_join.signatures(len(t), np.sort(t), 75) for t in (a, b))
            assert len(np.intersect1d(x, y))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 16))
    x[10:60] = x[0] + 0.02 * rng.standard_normal((50, 16))
    x[61] = x[60]
    data = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    data += [(90, None, 1), (91, [], 1), (92, [0.0] * 16, 1), (93, [float("nan")] * 16, 1), (94, [None] * 16, 1), (95, [1.0, 2.0], 1), data[3], (None, data[5][1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, class int")
    got = collections.Counter((r["vec_id"], r["n_links"]) for r in vector_dedup.vector_components(df).collect())
    ok = [d for d in data if d[1] and len(d[1]) == 16 and None not in d[1] and np.isfinite(d[1]).all() and any(d[1])]
    y = np.array([d[1] for d in ok], np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = (y @ y.T >= 0.95).sum(axis=1) - 1
    want = collections.Counter((d[0], int(n)) for d, n in zip(ok, links, strict=True)) + collections.Counter((i, 0) for i in (90, 91, 92, 93, 94, 95))
    assert got == want
    assert vector_dedup.vector_components(df.limit(0)).count() == 0


def test_window_links_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(8)[None, :] + 0.12 * rng.standard_normal((90, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.vector_components(df).collect()}
    y = x / np.linalg.norm(x, axis=1)[:, None]
    assert list(got[i] for i in range(90)) == list((y @ y.T >= 0.95).sum(axis=1) - 1)


def encoded(end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in rows()]


def test_tokens(spark, docs, none):
    scratch = Scratch(spark, "test")
    out = scratch.path("tokens")
    token_output.write_tokens(docs, out, vocabulary(), 2)
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in token_output.read_tokens(spark, out).collect())
    assert got == collections.Counter((d, tuple(i)) for d, i in encoded(2))
    at = 0
    for r in sorted(token_output.read_tokens(spark, out, True).collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    empty = scratch.path("tokens")
    token_output.write_tokens(none, empty, vocabulary(), 2)
    assert token_output.read_tokens(spark, empty, True).count() == 0


def test_code_is_limited_and_complete():
    counts = np.array([0, *(2**i for i in range(40))], np.float64)
    lengths = token_output.code_lengths(counts, 12)
    assert lengths.max() <= 12 and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    ids = np.random.default_rng(0).integers(1, 41, 1000)
    bits, marks = token_output.encode_bits(ids, token_output.canonical(lengths), lengths)
    assert (token_output.decode_bits(bits, marks, 1000, token_output.table(lengths)) == ids).all()


def test_packing(docs, none):
    got = packing.pack_documents(docs, vocabulary(), size=512).collect()
    want = collections.Counter()
    for d, ids in encoded(0):
        first = (len(ids) - 1) % 512 + 1
        cuts = [0, *range(first, len(ids) + 1, 512)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512
    assert len(seqs) == -(-sum(r["length"] for r in got) // 512)
    assert packing.pack_documents(none, vocabulary()).count() == 0


def test_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = rng.integers(1, 101, int(rng.integers(1, 80)))
        bins, offs, used = packing.best_fit(lengths, 100)
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= used
        assert np.bincount(bins, lengths).max() <= 100
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    size = collections.Counter()
    for r in rows():
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = {s: (n, t) for s, n, t in mixing.targets([*size.items()], (1, 2, 3), 3)}
    taken = collections.Counter()
    assert len(got) == len(rows())
    for r in got:
        assert (r["source_size"], r["target"]) == want[r["source"]]
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
    total = sum(n for n, _ in want.values())
    assert abs(sum(t for _, t in want.values()) - total) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).count() == 0


def test_fit_is_exact_when_it_can_be():
    assert sum(s * n for s, n in mixing.fit({7: 10, 5: 10, 300: 4}, 622).items()) == 622
    counts = {n: 50 for n in range(1, 400, 7)}
    for budget in (1, 1000, 123_457):
        assert sum(s * n for s, n in mixing.fit(counts, budget).items()) == budget


def test_licenses(spark, none):
    texts = [dict(licenses.texts_known())["MIT"].replace("License", "LICENCE").replace(".", " . "), "Released under the MIT License", "released under the mit licence!", "Some text. Released under the MIT License.", None, "", "...", "(c) 2020 me\nLicensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    assert [r["license"] for r in sorted(licenses.scan(df).collect())] == ["MIT", "MIT", "MIT", None, None, None, None, "CC-BY-NC-4.0"]
    assert licenses.scan(none).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en/12", "https://m.example.org/en/2", "http://x.com/fr/1", "http://x.com/de", "http://x.com/de/3#a", "http://y.net/de/5", "nothing", None, "http://h.net", "a://b://c/d", "http://org/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.classify(df, RULES).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2] is None and got[5][2:] == ("com/de/", "block")
    assert got[7][:2] == got[8][:2] == ("", "") and got[9][:2] == ("h.net", "") and got[10][:2] == ("b:", "//c/d")
    assert got[11][2:] == ("org/", "allow") and {v[3] for v in got.values()} <= {"allow", "block"}
    assert url_templates.classify(df.limit(0), RULES).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(0)
    score, step, first = rng.standard_normal((700, 3)).astype("f4"), rng.standard_normal((3, 3)).astype("f4"), np.array([0, 0, 5, 300, 300, 700])
    post, a = language.posteriors(score, step, first), np.exp(step.astype(float))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        e = np.exp(score[lo:hi].astype(float))
        forth, back = [], [np.ones(3)]
        for t in range(hi - lo):
            x = e[t] if not forth else (forth[-1] @ a) * e[t]
            forth.append(x / x.sum())
        for t in range(hi - lo - 1, 0, -1):
            x = a @ (e[t] * back[-1])
            back.append(x / x.sum())
        if forth:
            g = np.array(forth) * np.array(back[::-1])
            assert np.abs(g / g.sum(axis=1, keepdims=True) - post[lo:hi]).max() < 1e-5


def test_language(spark, docs, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(big, sample=400)
    got = language.predict(big, model).join(big.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = {(r["doc_id"], r["lang_pred"] == "und") for r in language.predict(docs, model).collect()}
    assert {(0, True), (1, True), (2, True), (19, True), (3, False)} <= odd
    assert language.predict(none, language.learn(none)).count() == 0


def test_toxicity(spark, docs, none):
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(big, labels, sample=1500)
    got = toxicity.predict(big, model).join(labels, "doc_id").where("held_out").collect()
    yes, no = ([r["score"] for r in got if r["toxic"] == t] for t in (1, 0))
    assert np.mean(np.array(yes)[:, None] > np.array(no)[None, :]) > 0.85
    odd = toxicity.predict(docs, model).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.predict(none, toxicity.learn(none, labels.limit(0))).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components(Scratch(spark, "c"), spark.createDataFrame(edges, "a long, b long")).collect()}
    same = collections.defaultdict(set)
    for n, r in got.items():
        same[r].add(find(n))
    assert all(len(s) == 1 for s in same.values()) and len(same) == len({find(n) for n in got})


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [(r[0], r[1], r[2] or "en", r[3], 1) for r in rows()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
