"""Micro-batch ingest: documents that arrive are hashed, those that are there already are dropped, the rest is appended.

Exact dedup over all time would need unbounded state; instead every batch meets the table by an anti-join on hashes.
Batches are written under their number, so that one that is run again replaces itself and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.blake3 import content_hash
from lodestone.functions.columns import col, stored
from lodestone.operators.dedup import BROADCAST_ROWS, first_of_each
from lodestone.sources import files


def new_documents(batch: DataFrame, known: DataFrame | None, order: str, content: str = "text", algorithm: str = "blake3") -> DataFrame:
    """Rows of contents that aren't known, the first of each in order, with doc_hash."""
    hashed = batch.where(col(content).isNotNull()).withColumn("doc_hash", content_hash(col(content), algorithm))
    fresh = first_of_each(hashed, F.col("doc_hash"), order)
    if known is None:
        return fresh
    # the batch is the small side: its hashes go to the table, not the table's to the batch
    asked = stored(fresh.select("doc_hash"), "asked")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    old = known.select("doc_hash").join(F.broadcast(asked) if few else asked, "doc_hash", "left_semi").distinct()
    return fresh.join(F.broadcast(old) if few else old, "doc_hash", "left_anti")


def appender(path: str, order: str, content: str = "text", algorithm: str = "blake3") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes to ``path/batch=N``."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = None
        if files.exists(spark, path):
            known = spark.read.parquet(path).where(F.col("batch") < number)
        new_documents(batch, known, order, content, algorithm).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return append


def start(spark: SparkSession, source: str, path: str, checkpoint: str, schema: T.StructType, order: str = "doc_id", content: str = "text", kind: str = "parquet", algorithm: str = "blake3", **trigger: object) -> StreamingQuery:
    """Watch the folder ``source``; triggers as for ``DataStreamWriter.trigger``."""
    stream = spark.readStream.schema(schema).format(kind).load(source)
    return stream.writeStream.foreachBatch(appender(path, order, content, algorithm)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
