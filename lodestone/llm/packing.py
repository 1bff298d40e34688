"""Vector best-fit packing of documents into training sequences.

A piece (a document, or one of the equal parts of one longer than any bin can take) asks for three things: tokens, one place among the bin's
documents, and attention cost (the square of its tokens, as attention stays inside a piece). A bin has a capacity of
each. Pieces are placed in descending order of size; among the bins in which a piece fits under every constraint, the
one of the best score takes it:

* ``dot``: the largest weighted dot product of the demand and the residual capacities (both as shares of a capacity);
* ``norm``: the smallest weighted norm of what would be left.

A shard of pieces is packed by itself, so the work spreads over the cluster; shards are made of hashes of the
documents and hold about ``shard_pieces`` pieces however large the table is, which costs at most one badly filled bin in some hundred.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _flat, bpe
from lodestone.llm._common import col, ship, stored, trimmed


@dataclass(frozen=True)
class Packing:
    """tokens, documents, attention: capacities of a bin. weights: of the three in the score. rule: 'dot' or 'norm'. The
    attention of a bin is half of what one piece of all its tokens would cost: a long piece takes a bin's attention
    before its tokens, and shares it with short ones."""

    tokens: int = 4096
    documents: int = 32
    attention: int = 4096 * 4096 // 2
    weights: tuple[float, float, float] = (1.0, 0.25, 0.5)
    rule: str = "norm"
    shard_pieces: int = 8192

    def __post_init__(self) -> None:
        if self.rule not in ("dot", "norm") or min(self.tokens, self.documents, self.attention, self.shard_pieces) < 1:
            raise ValueError("bad capacities or rule")

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that any bin can take."""
        return min(self.tokens, int(np.sqrt(float(self.attention))))


def token_counts(texts: pa.Array) -> np.ndarray:
    """Tokens of each text: words, and each punctuation mark or symbol. Null counts as empty."""
    data, offsets = _flat.flat(texts)
    starts, _, row = _flat.words(data, offsets)
    mark = (data > 32) & (data < 127) & ~_flat._WORD[data]
    marks = np.concatenate([[0], np.cumsum(mark)])
    return np.bincount(row, minlength=len(offsets) - 1) + marks[offsets[1:]] - marks[offsets[:-1]]


def best_fit(sizes: np.ndarray, p: Packing) -> np.ndarray:
    """The bin of each piece; ``sizes`` come in the order in which they are placed, none over ``p.longest``."""
    caps = np.array([p.tokens, p.documents, p.attention], float)
    w = np.array(p.weights, float)
    left = np.empty((1024, 3))
    out = np.empty(len(sizes), np.int64)
    open_bins, n = np.zeros(0, np.int64), 0
    least = float(sizes.min()) if len(sizes) else 0.0
    for k, size in enumerate(sizes.tolist()):
        need = np.array([size, 1.0, float(size) * size])
        rest = left[open_bins] - need
        fits = np.flatnonzero((rest >= 0).all(1))
        if len(fits):
            rest = rest[fits] / caps
            if p.rule == "dot":
                score = (rest + need / caps) @ (w * need / caps)
                best = fits[int(score.argmax())]
            else:
                best = fits[int(((rest * rest) @ w).argmin())]
            b = open_bins[best]
        else:
            if n == len(left):
                left = np.concatenate([left, np.empty_like(left)])
            left[n] = caps
            b, n = n, n + 1
            open_bins = np.append(open_bins, b)
            best = len(open_bins) - 1
        left[b] -= need
        out[k] = b
        if left[b, 0] < least or left[b, 1] < 1 or left[b, 2] < least * least:
            open_bins = np.delete(open_bins, best)  # nothing that is still to come can fit
    return out


def _count(id_name: str, text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _flat.slices(whole, text_name):
                yield pa.RecordBatch.from_arrays([part.column(id_name), part.column("mark"), pa.array(token_counts(part.column(text_name)))], ["doc_id", "mark", "n"])

    return run


def _count_bpe(v: bpe.Vocabulary, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.Counter(v, same)
        for whole in batches:
            for part in _flat.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(counter.counts(part.column("text")))], ["doc_id", "mark", "n"])

    return run


def _pack(p: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches):
            sizes = table.column("n_tokens").to_numpy()
            bins = best_fit(sizes, p)
            full = np.bincount(bins, sizes).astype(np.int64)
            shard = table.column("shard").to_numpy()
            yield from pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "start_token": table.column("start_token"), "n_tokens": table.column("n_tokens"), "shard": table.column("shard"), "bin": pa.array(bins), "bin_tokens": pa.array(full[bins]), "bin_id": pa.array(shard * (1 << 32) + bins)}).combine_chunks().to_batches()

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high == low:
                continue
            if held and held[-1].column("shard")[0].as_py() != shard[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Packing = Packing(), vocabulary: bpe.Vocabulary | None = None) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, shard, bin, bin_tokens, bin_id), one row for each piece of each row.

    Tokens are those of ``vocabulary``, as ``bpe.encode`` gives them; without one, words and marks (``token_counts``). A
    text of more than ``params.longest`` tokens, however long, is cut into equal pieces. A row of no tokens (null or empty
    text; of words, also blank text) has no piece. A null id is packed like any other; repeated rows are packed each. An
    empty table gives no rows. Other columns are ignored, whatever their names. Ids are cast to long, what can't be is an
    error. Equal sizes are placed in the order of a hash of id and text, so the result doesn't depend on how the table is
    stored."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark"))
    counted = stored(rows.mapInArrow(trimmed(_count_bpe(vocabulary, bpe.reachable(vocabulary)) if vocabulary else _count("doc_id", "text")), "doc_id long, mark long, n long").where("n > 0"), "token-counts")
    parts = F.ceil(F.col("n") / params.longest).cast("long")
    pieces = counted.select("doc_id", "mark", "n", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("piece"))
    start, stop = F.expr("(n * piece) div parts"), F.expr("(n * (piece + 1)) div parts")
    pieces = pieces.select("doc_id", "mark", F.col("piece").cast("int").alias("piece"), start.alias("start_token"), (stop - start).alias("n_tokens"))
    total = counted.agg(F.sum(F.ceil(F.col("n") / params.longest))).first()[0] or 0
    shards = max(1, round(total / params.shard_pieces))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("mark", "piece"), F.lit(shards)))
    ordered = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("n_tokens"), "mark", "doc_id", "piece").drop("mark")
    return ordered.mapInArrow(_pack(params), "doc_id long, piece int, start_token long, n_tokens long, shard long, bin long, bin_tokens long, bin_id long")
