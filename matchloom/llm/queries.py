"""One query per operator on the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import codes, fingerprint, jaccard, knn, language, license, mixing, packing, quality, substring, suffix, variants, warc

REGISTRY = {}
# Queries that SQL can express at the driver's size; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_archives": """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
described AS (
  SELECT page_id, url, strlen(payload) AS n, sha256(payload) AS digest,
         min(page_id) OVER (PARTITION BY payload) AS first_page
  FROM payloads)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_page THEN first_page END AS refers_to,
       url AS target_uri
FROM described""",
    "op5_exact_top_k": """
WITH kept AS (
  SELECT CAST(vec_id AS BIGINT) AS id,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (
  SELECT DISTINCT id, v FROM kept WHERE id % 100 = 0),
scored AS (
  SELECT a.id AS query_id, a.v AS asked, b.id AS vec_id,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM asked AS a JOIN kept AS b ON a.id <> b.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS place
  FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10""",
    "op13_vector_code_compression": codes.compress_sql(),
}


def query(function):
    REGISTRY[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


@query
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_table(spark, sf_dir, "documents"))


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_table(spark, sf_dir, "documents"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).select(
        "doc.doc_id", "held_out", "score", "predicted", "n_passages"
    )


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(_table(spark, sf_dir, "documents"))


@query
def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score_documents(_table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_table(spark, sf_dir, "documents"))
