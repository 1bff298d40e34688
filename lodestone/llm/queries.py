"""The queries of this subpackage, over the whole of their tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, bpe, exact_dedup, html_extract, line_dedup, near_dedup, packing, pii, quality, secrets

#: Pruning in vector search: 1 is exact, whatever the structure of the vectors. Larger factors lose neighbours where there is some.
ANN_FACTOR = 1.0
#: The key of the surrogates: who knows it can test guesses. Where none is set, one of this process that nobody knows.
PII_KEY = os.environ.get("LODESTONE_PII_KEY", "").encode() or os.urandom(32)
VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", bpe.VOCABULARY)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(_documents(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extract.extract_text(pages, html_extract.fit_extractor(pages))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary=bpe.load(VOCABULARY))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the vectors of ids divisible by 100, searched among all; distances are rounded for the comparison."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), factor=ANN_FACTOR).withColumn("distance", F.round("distance", 6))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(_documents(spark, sf_dir), PII_KEY)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), bpe.load(VOCABULARY))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_line_dedup, op2_html_extraction, op3_best_fit_packing, op4_nearest_neighbours, op5_pii_surrogates, op6_exact_dedup, op7_near_dedup, op8_secret_scans, op9_quality_classifier, op10_bpe_encoding)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op4_nearest_neighbours": """
            SELECT vec_id, neighbour_id, rank, round(d, 6) AS distance FROM (
                SELECT q.vec_id, v.vec_id AS neighbour_id, d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id)::INTEGER AS rank
                FROM embeddings q, embeddings v, LATERAL (SELECT list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d)
                WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
            ) WHERE rank <= 10
        """,
        "op6_exact_dedup": """
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
            FROM documents
        """,
    }
