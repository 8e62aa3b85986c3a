"""The registered queries of this subpackage, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_dedup, filter_audit, licence_scan, mixing, ngram_join, pii, quality_cnn, quality_rules, substring_dedup, token_counts, toxicity_svm, vector_codes
from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_svm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def _tokenizer() -> tuple[str, str]:
    """The ranks' path and the pattern: parameters of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), *_tokenizer(), ids=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), *_tokenizer())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("removed")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_REACH = """
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

OP1_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q
    ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.v) = len(q.v)
  WHERE list_cosine_similarity(p.v, q.v) >= 0.98
),
{_REACH},
deg AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT n.id AS vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, n.id = c.component_id AS kept
FROM nodes n JOIN comp c USING (id) LEFT JOIN deg d USING (id)
"""

OP3_SQL = f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
grams AS (
  SELECT doc_id, unnest(CASE WHEN coalesce(len(w), 0) = 0 THEN []::VARCHAR[]
      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS g
  FROM words
),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS o FROM grams p JOIN grams q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2
),
pairs AS (
  SELECT a, b FROM common JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * o >= 90 * (s.n + t.n - o)
),
{_REACH}
SELECT n.id AS doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM nodes n JOIN comp c USING (id) LEFT JOIN size s ON s.doc_id = n.id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op5_licence_scan": licence_scan.duckdb_sql(), "op11_vector_codes": vector_codes.duckdb_sql(), "op12_substring_dedup": substring_dedup.DUCKDB_SQL, "op13_filter_audit": filter_audit.duckdb_sql()}
