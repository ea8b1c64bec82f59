"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, jaccard_join, language, licenses, mixing, packing, token_output, toxicity, url_templates, vector_dedup
from tessera.llm.common import Scratch

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(table(spark, sf_dir, "embeddings"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "token-files").path("tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), out, vocabulary(), end=2)
    return token_output.read_tokens(spark, out, digest=True)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.classify(table(spark, sf_dir, "pages"), RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP10 = f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_token_output, op3_license_scan, op4_url_filter, op5_toxicity, op6_source_mixing, op7_best_fit_packing, op8_jaccard_join, op9_language_id, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.oracle(), "op8_jaccard_join": OP8, "op10_exact_dedup": OP10}
