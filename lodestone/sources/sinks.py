"""Exports of documents and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import OutOfSyncError
from lodestone.functions.canonical import hex_of, lossy_text_exact
from lodestone.functions.columns import col
from lodestone.operators.metadata import export_names

_OWN = ("doc_ord", "doc_hash", "content", "content_size")


def table(docs: DataFrame, view: DataFrame | None = None, metadata: bool = True) -> DataFrame:
    """(text, doc_hash[, tokens], metadata...) for people and other libraries: text decoded, hashes in hex, metadata renamed
    where a name is taken. Tokens are joined by document, one without tokens has an empty list; tokens of a document that
    isn't there are an error."""
    reserved = ["text", "doc_hash", *(["tokens"] if view is not None else [])]
    names = export_names([c for c in docs.columns if c not in _OWN], reserved) if metadata else {}
    if view is not None:
        strays = view.select("doc_hash").join(docs.select("doc_hash"), "doc_hash", "left_anti")
        if not strays.isEmpty():
            raise OutOfSyncError("the view has tokens of documents that aren't there")
        docs = docs.join(view.select("doc_hash", "tokens"), "doc_hash", "left")
    tokens = [F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens")] if view is not None else []
    return docs.select(lossy_text_exact("content").alias("text"), hex_of(F.col("doc_hash")).alias("doc_hash"), *tokens, *(col(a).alias(b) for a, b in names.items()), "doc_ord")


def to_jsonl(docs: DataFrame, path: str, content: str = "text", hashes: bool = True, metadata: bool = True, compression: str = "none") -> None:
    """A document a line, in order within each file; the files of a corpus follow each other as its documents do."""
    out = table(docs, metadata=metadata).sortWithinPartitions("doc_ord").drop("doc_ord")
    out = out.withColumnRenamed("text", content)
    (out if hashes else out.drop("doc_hash")).write.option("compression", compression).json(path)


def to_parquet(docs: DataFrame, path: str, content: str = "text", hashes: bool = True, metadata: bool = True) -> None:
    out = table(docs, metadata=metadata).sortWithinPartitions("doc_ord").drop("doc_ord").withColumnRenamed("text", content)
    (out if hashes else out.drop("doc_hash")).write.option("compression", "zstd").parquet(path)


def to_token_files(view: DataFrame, path: str) -> None:
    """Raw streams of 32-bit tokens, least byte first: one row of bytes for each document, as Parquet binary."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column("tokens")
            data = [np.array(x, "<u4").tobytes() for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_ord"), pa.array(data, pa.binary())], ["doc_ord", "stream"])

    view.select("doc_ord", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens")).mapInArrow(run, "doc_ord long, stream binary").write.parquet(path)
