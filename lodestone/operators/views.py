"""What follows from a view (tokens of each document): offsets, chunks, seek points, batches, and their checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrow import flat, list_values, slices
from lodestone.functions.columns import col
from lodestone.functions.tokenizers import Tokenizer, from_config
from lodestone.operators.prefix import running_sum

CHUNK = 65_536
#: Tokens that are widened to 64 bits at a time.
SLICE = 1 << 20


def source_map(counts: DataFrame, order: list[str], count: str = "token_count", partitions: int | None = None) -> DataFrame:
    """``counts`` with ``token_offset``; documents without tokens are left out."""
    return running_sum(counts.where(col(count) > 0), order, count, "token_offset", partitions)


def chunks(placed: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk_id, num_tokens, num_docs) from a source map: each document adds to every chunk that it reaches into."""
    first, last = F.floor(F.col("token_offset") / size), F.floor((F.col("token_offset") + F.col("token_count") - 1) / size)
    part = placed.select("token_offset", "token_count", F.explode(F.sequence(first, last)).alias("chunk_id"))
    low = F.greatest(F.col("token_offset"), F.col("chunk_id") * size)
    high = F.least(F.col("token_offset") + F.col("token_count"), (F.col("chunk_id") + 1) * size)
    return part.groupBy("chunk_id").agg(F.sum(high - low).cast("long").alias("num_tokens"), F.count("*").alias("num_docs"))


def sparse_index(total: DataFrame, interval: int = CHUNK, chunk: int = CHUNK) -> DataFrame:
    """(token_offset, chunk_id, in_chunk_offset) of each seek point, from a row with ``total_tokens``."""
    points = total.where("total_tokens > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_tokens") - 1, F.lit(interval).cast("long"))).alias("token_offset"))
    return points.select("token_offset", F.floor(F.col("token_offset") / chunk).alias("chunk_id"), F.pmod("token_offset", F.lit(chunk)).cast("long").alias("in_chunk_offset"))


def batches(counts: DataFrame, size: int, count: str = "token_count") -> DataFrame:
    """A row for each batch of at most ``size`` tokens; none crosses a document. Adds batch, start and n."""
    some = counts.where(col(count) > 0)
    split = some.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col(count) - 1) / size))))
    return split.withColumn("start", F.col("batch") * size).withColumn("n", F.least(F.lit(size).cast("long"), col(count) - F.col("start")))


def token_batches(view: DataFrame, size: int = 1024) -> DataFrame:
    """``view`` in batches: tokens is the slice of each."""
    return batches(view, size).withColumn("tokens", F.slice("tokens", (F.col("start") + 1).cast("int"), F.col("n").cast("int")))


def all_tokens(view: DataFrame, offset: str = "token_offset") -> DataFrame:
    """(position, token): the whole stream, from a view with offsets."""
    return view.select(col(offset), F.posexplode("tokens").alias("i", "token")).select((col(offset) + F.col("i")).alias("position"), "token")


def _summed(values: np.ndarray, bounds: np.ndarray, offset: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """n, sum and sum weighted by position of the tokens in each chunk, from tokens of documents that lie one after another
    and the documents' offsets; at most ``SLICE`` tokens at a time, however long a document is."""
    for low in range(0, len(values), SLICE):
        high = min(len(values), low + SLICE)
        a, b = int(np.searchsorted(bounds, low, "right")) - 1, int(np.searchsorted(bounds, high, "left"))
        n = np.diff(np.clip(bounds[a : b + 1], low, high))
        token = values[low:high].astype(np.int64)
        position = np.arange(low, high) + np.repeat(offset[a:b] - bounds[a:b], n)
        chunk = position // size
        # stretches of one chunk are summed at once
        cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        sums = [np.add.reduceat(v, cuts) for v in (token, token * (position - chunk * size))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (chunk[cuts], np.diff(np.append(cuts, len(token))), *sums)], ["chunk_id", "n", "token_sum", "weighted"])


def _sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _summed(*list_values(b.column("tokens")), b.column("token_offset").to_numpy(), size)

    return run


def _encoded_sums(size: int, config: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = from_config(config)
        for b in (batch.slice(*x) for batch in batches for x in slices(batch.column("content"), tokenizer.slice_bytes)):
            yield from _summed(*tokenizer.encode_flat(*flat(b.column("content"))), b.column("token_offset").to_numpy(), size)

    return run


def _by_chunk(parts: DataFrame, run) -> DataFrame:
    sums = parts.mapInArrow(run, "chunk_id long, n long, token_sum long, weighted long")
    return sums.groupBy("chunk_id").agg(*(F.sum(c).alias(c) for c in ("n", "token_sum", "weighted")))


def chunk_sums(view: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk_id, n, token_sum, weighted): the whole stream of a view with offsets, read once and summed up where it is;
    weighted takes each token times its place in the chunk."""
    return _by_chunk(view.select("token_offset", "tokens"), _sums(size))


def encoded_chunk_sums(docs: DataFrame, tokenizer: Tokenizer, size: int = CHUNK) -> DataFrame:
    """The same from (token_offset, content): tokens are summed up in the worker that makes them and never leave it."""
    return _by_chunk(docs.select("token_offset", F.col("content").cast("binary").alias("content")), _encoded_sums(size, tokenizer.config()))


def _packed(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, used = None, 0, 0
        for b in batches:
            shard, size = b.column("shard").to_pylist(), b.column("size").to_numpy()
            blocks, offsets = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for k, (s, n) in enumerate(zip(shard, size.tolist(), strict=True)):
                if s != at:
                    at, block, used = s, 0, 0
                blocks[k], offsets[k] = block, used
                used += n
                if used >= target:
                    block, used = block + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks), pa.array(offsets)], [*b.schema.names, "block", "in_block_offset"])

    return run


def block_layout(docs: DataFrame, order: str, size: str, shard: Column | None = None, target: int = 8 << 20, header: int = 40) -> DataFrame:
    """(shard, order, size, block, in_block_offset): documents of a shard in blocks of bytes. Each takes ``header`` bytes and its
    own; a block is closed by the document that brings it to ``target``, and the next begins at 0. That is a fold, not a
    sum, so a shard is one task, over 16 bytes a document that stream by."""
    narrow = docs.select((F.lit(0) if shard is None else shard).alias("shard"), col(order).alias("ord"), (col(size) + header).cast("long").alias("size"))
    kind = narrow.schema["shard"].dataType.simpleString(), narrow.schema["ord"].dataType.simpleString()
    placed = narrow.repartition("shard").sortWithinPartitions("shard", "ord").mapInArrow(_packed(target), f"shard {kind[0]}, ord {kind[1]}, size long, block long, in_block_offset long")
    return placed.select("shard", F.col("ord").alias(order), (F.col("size") - header).alias("size"), "block", "in_block_offset")


def locate(offsets: DataFrame, placed: DataFrame, bucket: int = CHUNK) -> DataFrame:
    """The document that holds each token offset. The range join is an equi-join on buckets of the stream: a document
    is listed in the buckets that it reaches into."""
    first, last = F.floor(F.col("token_offset") / bucket), F.floor((F.col("token_offset") + F.col("token_count") - 1) / bucket)
    listed = placed.withColumn("_bucket", F.explode(F.sequence(first, last)))
    asked = offsets.withColumn("_bucket", F.floor(F.col("wanted") / bucket))
    met = asked.join(listed, "_bucket").where((F.col("wanted") >= F.col("token_offset")) & (F.col("wanted") < F.col("token_offset") + F.col("token_count")))
    return met.drop("_bucket")


def gaps(placed: DataFrame) -> DataFrame:
    """Rows of a source map that begin where none ends (but at 0), or where another begins: joins on offsets, no order."""
    ends = placed.select((F.col("token_offset") + F.col("token_count")).alias("token_offset")).distinct()
    loose = placed.where("token_offset != 0").join(ends, "token_offset", "left_anti")
    twice = placed.groupBy("token_offset").count().where("count > 1").select("token_offset")
    return loose.unionByName(placed.join(twice, "token_offset", "left_semi").select(*(col(c) for c in loose.columns)))


def unsorted(keys: DataFrame, key: str, within: list[str], order: str) -> DataFrame:
    """Rows whose key isn't larger than the one before."""
    w = Window.partitionBy(*(col(c) for c in within)).orderBy(col(order))
    return keys.withColumn("_before", F.lag(col(key)).over(w)).where(F.col("_before") >= col(key)).drop("_before")


def total(counts: DataFrame, count: str = "token_count") -> DataFrame:
    return counts.agg(F.coalesce(F.sum(col(count)), F.lit(0)).cast("long").alias("total_tokens"))


def in_range(tokens: Column, vocab_size: int) -> Column:
    return F.coalesce(F.array_max(tokens) < vocab_size, F.lit(True))
