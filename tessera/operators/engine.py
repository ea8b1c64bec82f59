"""The search engine: an index that is built once and kept, and a facade over it.

An index is four Parquet tables under one folder: postings (term, doc_id, w, and
its first letters p3, by which the files are laid out), lengths, vocabulary (term,
documents that hold it) and totals. Questions meet the vocabulary by an equality
on three letters before the prefix test, and then only the postings of the terms
that matched; no query reads a text that is not in its result.

Encoder, scorer and bridge are callables, so that any model can stand behind them:
encode(Series of texts) -> list of vectors; score(Series of questions, Series of
texts) -> floats; bridge(question) -> expanded question.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ALPHABET, HATS, PLAIN, STOP, SUFFIXES

# As in retrieval.py; the cut of texts for encoder and scorer, the
# sizes of the legs and of the pool, weights of types of documents.
K1, B, WEIGHTS, PENALTY, C, RERANK, BOOST = 1.2, 0.75, {"baslik": 5.0, "govde": 1.0, "belge_ad": 2.5}, 4.0, 60, 2.0, 0.05
ENCODE_CHARS, SCORE_CHARS, LEG, PURE, POOL = 1400, 1500, 100, 60, 200
RANK_OF_TYPE = {"1": 1.0, "3": 0.7, "19": 0.7, "2": 0.5, "4": 0.5}

Encoder = Callable[[pd.Series], list]
Scorer = Callable[[pd.Series, pd.Series], list]
Bridge = Callable[[str], str]


def fold(x: Column) -> Column:
    return F.lower(F.translate(F.coalesce(x, F.lit("")), HATS, PLAIN))


def words(x: Column) -> Column:
    return F.regexp_extract_all(fold(x), F.lit(ALPHABET), F.lit(0))


def root(w: Column) -> Column:
    head = F.regexp_extract(w, rf"^(.{{4,}}?)({'|'.join(SUFFIXES)})$", 1)
    return F.when(head != "", head).otherwise(w)


def phrases(questions: DataFrame) -> DataFrame:
    """(qid, p, m): the prefixes that a question asks for, and how often."""
    said = F.filter(words(F.col("soru")), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))
    both = F.flatten(F.transform(said, lambda w: F.when(root(w) == w, F.array(w)).otherwise(F.array(w, root(w)))))
    return questions.select("qid", F.explode(both).alias("p")).groupBy("qid", "p").agg(F.count(F.lit(1)).alias("m"))


def build_index(chunks: DataFrame, path: str, files: int | None = None) -> None:
    """Write the index of chunks (chunk_id, baslik, govde, belge_ad) under path.

    Each field is tokenised once; postings are summed per term and chunk before
    they are laid out by the first three letters of the term, sorted, so that a
    prefix reads the row groups of its letters only.
    """
    fields = chunks.select("chunk_id", *(words(F.col(c)).alias(c) for c in WEIGHTS))
    told = F.flatten(F.array(*(F.transform(c, lambda t, w=w: F.struct(t.alias("term"), F.lit(w).alias("w"))) for c, w in WEIGHTS.items())))
    postings = fields.select("chunk_id", F.explode(told).alias("x")).groupBy("x.term", "chunk_id").agg(F.sum("x.w").alias("w"))
    postings = postings.withColumn("p3", F.substring("term", 1, 3))
    laid = postings.repartitionByRange(files, "p3", "term") if files else postings.repartitionByRange("p3", "term")
    laid.sortWithinPartitions("p3", "term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    fields.select("chunk_id", sum(F.size(c) for c in WEIGHTS).alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    spark = chunks.sparkSession
    spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")
    spark.read.parquet(f"{path}/postings").groupBy("p3", "term").agg(F.count(F.lit(1)).alias("df")).where(F.length("term") >= 3).write.mode("overwrite").parquet(f"{path}/vocabulary")


def lexical(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """(qid, chunk_id, skor): BM25 over prefixes; lower is better."""
    asked = phrases(questions)
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    matched = asked.select("p").distinct().withColumn("p3", F.substring("p", 1, 3)).join(vocabulary, "p3").where(F.col("term").startswith(F.col("p"))).select("p", "p3", "term")
    hits = matched.join(spark.read.parquet(f"{path}/postings"), ["p3", "term"]).groupBy("p", "chunk_id").agg(F.sum("w").alias("f"))
    total = spark.read.parquet(f"{path}/totals")
    rare = hits.groupBy("p").agg(F.count(F.lit(1)).alias("np")).join(F.broadcast(total), F.lit(True))  # totals is one row
    idf = F.log((F.col("n") - F.col("np") + 0.5) / (F.col("np") + 0.5))
    rare = rare.select("p", "avgdl", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"))
    rows = asked.join(rare, "p").join(hits, "p").join(spark.read.parquet(f"{path}/lengths"), "chunk_id")
    part = F.col("m") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("qid", "chunk_id").agg((-F.round(F.sum(part), 6)).alias("skor"))


def top(rows: DataFrame, by: str, order: list[Column], k: int, name: str = "rk") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def embed(texts: DataFrame, text: Column, encode: Encoder, *keep: str) -> DataFrame:
    """texts with `embedding`, unit vectors of the first ENCODE_CHARS characters,
    batch by batch."""

    def run(batches):
        for pdf in batches:
            vectors = [[float(x) for x in v] for v in encode(pdf["__t"])]
            norms = [max(sum(x * x for x in v) ** 0.5, 1e-12) for v in vectors]
            yield pdf.drop(columns="__t").assign(embedding=[[x / n for x in v] for v, n in zip(vectors, norms, strict=True)])

    rows = texts.select(*keep, F.substring(F.coalesce(text, F.lit("")), 1, ENCODE_CHARS).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__t").schema) + ", embedding array<float>"
    return rows.mapInPandas(run, schema)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, s, vr): of each question vector the k nearest of all."""
    asked = questions.select("qid", F.col("embedding").alias("__q"))
    pairs = vectors.select("chunk_id", "embedding").crossJoin(asked).select("qid", "chunk_id", F.round(dot("__q", "embedding"), 6).alias("s"))
    return top(pairs, "qid", [F.desc("s"), F.asc("chunk_id")], k, "vr")


@dataclass
class SearchEngine:
    """Search over chunks (chunk_id, belge, tur, baslik, govde, belge_ad, mulga),
    their index under `path`, and their vectors (chunk_id, embedding).

    search(questions (qid, soru)) gives the n best of each question, with rank
    and score. Filters act after fusion, as the vector leg knows no types. With a
    scorer the fused pool is ranked again. A bridge that fails is replaced by the
    rules' bridge, and each question is bridged once.
    """

    spark: SparkSession
    chunks: DataFrame
    path: str
    vectors: DataFrame | None = None
    encode: Encoder | None = None
    score: Scorer | None = None
    bridge: Bridge | None = None
    rules: Bridge | None = None
    bridged: dict[str, str] = field(default_factory=dict)

    def build(self, files: int | None = None) -> SearchEngine:
        build_index(self.chunks, self.path, files)
        return self

    def expand(self, question: str) -> str:
        """The question as the bridge tells it: remembered; the rules' on error."""
        if question not in self.bridged:
            plain = self.rules or (lambda q: q)
            try:
                said = (self.bridge or plain)(question)
            except Exception:  # noqa: BLE001  a model or network error must not stop a search
                said = plain(question)
            self.bridged[question] = said
        return self.bridged[question]

    def asked(self, questions: list[tuple[int, str]]) -> DataFrame:
        return self.spark.createDataFrame([(i, self.expand(q)) for i, q in questions], "qid long, soru string")

    def _hydrate(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.chunks, "chunk_id")

    def _allowed(self, rows: DataFrame, tur: str | None, hide: bool) -> DataFrame:
        rows = rows.where(F.col("tur") == tur) if tur else rows
        return rows.where(~F.coalesce("mulga", F.lit(False))) if hide else rows

    def lexical(self, questions: DataFrame, n: int, tur: str | None = None, hide: bool = False) -> DataFrame:
        """The lexical leg: filtered before the cut; repealed rows rank lower."""
        slim = self.chunks.select("chunk_id", "tur", "mulga")
        rows = self._allowed(lexical(self.spark, self.path, questions).join(slim, "chunk_id"), tur, hide)
        rank = F.col("skor") + PENALTY * F.coalesce("mulga", F.lit(False)).cast("int")
        return top(rows, "qid", [rank.asc(), F.asc("chunk_id")], n, "bm").select("qid", "chunk_id", "skor", "bm")

    def vector_only(self, questions: DataFrame, n: int = 10, tur: str | None = None, hide: bool = False) -> DataFrame:
        """Nearest PURE vectors, then filters, then the cut."""
        near = nearest(self.vectors, embed(questions, F.col("soru"), self.encode, "qid"), PURE)
        return top(self._allowed(self._hydrate(near), tur, hide), "qid", [F.asc("vr")], n)

    def hybrid(self, questions: DataFrame, n: int = 10, tur: str | None = None, hide: bool = False) -> DataFrame:
        """Both legs fused by reciprocal ranks; `rrf`, `rk` and the chunk."""
        bm = self.lexical(questions, LEG, tur, hide).select("qid", "chunk_id", "bm")
        if self.vectors is not None and self.encode is not None:
            vr = nearest(self.vectors, embed(questions, F.col("soru"), self.encode, "qid"), LEG).select("qid", "chunk_id", "vr")
            rows = bm.join(vr, ["qid", "chunk_id"], "full")
        else:
            rows = bm.withColumn("vr", F.lit(None).cast("int"))
        share = lambda c: F.coalesce(F.lit(1.0) / (C + F.col(c)), F.lit(0.0))
        rows = self._allowed(self._hydrate(rows.withColumn("rrf", F.round(share("bm") + share("vr"), 9))), tur, hide)
        return top(rows, "qid", [F.desc("rrf"), F.asc_nulls_last("bm"), F.asc_nulls_last("vr"), F.asc("chunk_id")], n)

    def reranked(self, questions: DataFrame, n: int = 10, tur: str | None = None, hide: bool = False) -> DataFrame:
        """The hybrid pool ranked again by the scorer, fused, with the weight of
        each document's type (the second part of its key)."""
        pool = self.hybrid(questions, POOL, tur, hide).withColumnRenamed("rk", "pr")
        text = F.substring(F.trim(F.concat_ws(" ", F.coalesce("baslik", F.lit("")), F.coalesce("govde", F.lit("")))), 1, SCORE_CHARS)
        score = self.score
        judge = F.pandas_udf(lambda q, t: pd.Series([float(x) for x in score(q, t)]), "double")
        rows = pool.join(questions.select("qid", "soru"), "qid").withColumn("rerank_skor", judge("soru", text)).drop("soru")
        rows = rows.withColumn("rr", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_skor"), F.asc("pr"))))
        kind, weight = F.get(F.split("belge", "_"), F.lit(1)), F.lit(0.0)
        for k, v in RANK_OF_TYPE.items():
            weight = F.when(kind == k, v).otherwise(weight)
        rows = rows.withColumn("puan", F.round(F.lit(1.0) / (C + F.col("pr")) + RERANK / (C + F.col("rr")) + BOOST * weight, 9))
        return top(rows, "qid", [F.desc("puan"), F.asc("pr")], n)

    def search(self, questions: list[tuple[int, str]], n: int = 10, tur: str | None = None, hide: bool = False) -> DataFrame:
        asked = self.asked(questions)
        return (self.reranked if self.score else self.hybrid)(asked, n, tur, hide)


def rule_bridge(dictionary: list[tuple[str, list[str]]]) -> Callable[[str], tuple[str, list[str], list[str]]]:
    """Expansion by a dictionary (phrase, terms), in its order: (question with the
    terms added, terms added, phrases that triggered). Terms that the question
    already has, and those already added, are left out."""
    low = lambda s: s.translate(str.maketrans(HATS, PLAIN)).lower()

    def run(question: str) -> tuple[str, list[str], list[str]]:
        said = low(question)
        hit = [(k, ts) for k, ts in dictionary if low(k) in said]
        added = list(dict.fromkeys(t for _, ts in hit for t in ts if low(t) not in said))
        return " ".join([question, *added]), added, [k for k, _ in hit]

    return run
