"""The corpus pipeline: bad documents go, then exact and near copies, secrets are masked, what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, exact_dedup, near_dedup, packing, quality, secrets
from lodestone.llm._common import shared_dir
from lodestone.llm.queries import VOCABULARY


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, fitted on ``labels``, takes for good, with all their columns. A null or empty text is
    judged as the empty text, repeated rows alike, a text of any length whole; an empty table stays empty. Without labels
    of both classes every row is good."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the smallest id, a null id being larger than any; of repeated rows one. Rows without
    text stay, the empty text is a text, an empty table stays empty."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without those that have a near copy of a smaller id. Rows without id or text stay, rows that repeat one id
    and text stay all; an empty table stays empty."""
    return near_dedup.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by ``[SECRET]`` and n_chars brought up to date. Null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row, and its bin; tokens are those of the BPE vocabulary, as in op10. Rows without
    tokens (null or empty text) have no piece; a null id is packed like any other; an empty table gives no rows."""
    return packing.pack(docs, vocabulary=bpe.load(VOCABULARY))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL can express neither the trees nor the signatures; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
