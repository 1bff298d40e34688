"""Token batches for training: who of the ranks and workers gets what, in which order.

Batches of a dataset are numbered in order; slot = rank * workers + worker takes every n-th. A slot's batches form a
stream that is cut anew into batches of full size. A shuffled loader permutes the tokens within each batch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.blake3 import blake3
from lodestone.functions.arrow import list_values, slices
from lodestone.functions.columns import col, stored
from lodestone.operators.prefix import row_numbers, running_sum
from lodestone.operators.views import SLICE, batches


def seed(epoch_seed: int, rank: int, worker: int) -> int:
    """The first eight bytes (least first) of the hash of the three numbers."""
    return int.from_bytes(blake3(b"".join(x.to_bytes(8, "little") for x in (epoch_seed, rank, worker)))[:8], "little")


def slots(counts: DataFrame, order: list[str], size: int, world: int, workers: int = 1) -> DataFrame:
    """Batches of at most ``size`` tokens with their number in the dataset (``index``) and the slot that takes them."""
    numbered = row_numbers(batches(counts, size), [*order, "batch"], "index")
    return numbered.withColumn("slot", F.pmod("index", F.lit(world * workers)).cast("int"))


def rebatched(slotted: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """(slot, out_batch, n): sizes of the batches that each slot hands out."""
    total = slotted.groupBy("slot").agg(F.sum("n").alias("total"))
    cut = total.where("total > 0").select("slot", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / size))).alias("out_batch"))
    cut = cut.select("slot", "out_batch", F.least(F.lit(size).cast("long"), F.col("total") - F.col("out_batch") * size).alias("n"))
    return cut.where(F.col("n") == size) if drop_last else cut


def joined(size: int, most: int):
    """Pieces (at, tokens) of a stream to (out_batch, at, whole, tokens): pieces that follow each other become one array,
    which is cut where batches end, when it has ``most`` tokens. Only what lies at the edges of a run isn't whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first = end = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, first
            stop = end if last else end // size * size
            if stop <= first:
                return None
            tokens = np.concatenate(held)
            cuts = np.unique(np.concatenate([[first], np.arange(-(-first // size) * size, stop, size), [stop]]))
            held, tokens = ([tokens[stop - first :]] if stop < end else []), tokens[: stop - first]
            number = cuts[:-1] // size
            lists = pa.ListArray.from_arrays(pa.array((cuts - first).astype(np.int32)), pa.array(tokens.astype(np.int32, copy=False)))
            columns = [pa.array(number), pa.array(cuts[:-1]), pa.array(np.diff(cuts) == size), lists]
            first = stop
            return pa.RecordBatch.from_arrays(columns, ["out_batch", "at", "whole", "tokens"])

        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("at").to_numpy()
            values, bounds = list_values(b.column("tokens"))
            n = np.diff(bounds)
            breaks = (np.flatnonzero(at[1:] != at[:-1] + n[:-1]) + 1).tolist()
            for low, high in zip([0, *breaks], [*breaks, len(at)], strict=True):
                if not held or at[low] != end:
                    if held and (done := flush(True)):
                        yield done
                    held, first, end = [], int(at[low]), int(at[low])
                held.append(values[bounds[low] : bounds[high]])
                end += int(bounds[high] - bounds[low])
                if end - first >= most and (done := flush(False)):
                    yield done
        if held and (done := flush(True)):
            yield done

    return run


def cut(pieces: DataFrame, size: int) -> DataFrame:
    """(out_batch, tokens): a stream, given as pieces (at, tokens), in arrays of ``size`` (the last may be shorter). Where
    pieces come in order only the ends of each task's run are shuffled."""
    made = stored(pieces.select("at", "tokens").mapInArrow(joined(size, 64 * size), "out_batch long, at long, whole boolean, tokens array<int>"), "cut")
    edges = made.where("NOT whole").groupBy("out_batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return made.where("whole").select("out_batch", "tokens").unionByName(edges)


def _own(size: int, slot: int, n_slots: int):
    """What of each document the slot takes: its batches, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(*x) for batch in batches for x in slices(batch.column("tokens"), SLICE)):
            first = b.column("_first").to_numpy()
            values, start = list_values(b.column("tokens"))
            n = np.diff(start)
            place = np.arange(start[-1]) - np.repeat(start[:-1], n)
            mine = (np.repeat(first, n) + place // size) % n_slots == slot
            counts = np.concatenate([[0], np.cumsum(mine)])[start]
            some = np.diff(counts) > 0
            taken = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], counts[1:][some]]).astype(np.int32)), pa.array(values[mine]))
            yield pa.RecordBatch.from_arrays([b.column("at").filter(pa.array(some)), taken], ["at", "tokens"])

    return run


def load(view: DataFrame, order: list[str], size: int = 1024, rank: int = 0, world: int = 1, worker: int = 0, workers: int = 1, shuffle: bool = False, epoch_seed: int = 0, drop_last: bool = False) -> DataFrame:
    """(out_batch, tokens): what one slot hands out. ``view`` (order..., token_count, tokens) is computed once. Two running
    sums over its counts say which batches of each document are the slot's and where they stand in its stream; the stream
    is then cut where the documents are. A shuffled slot uses one random generator over all of its batches in turn; its
    states are computed ahead, so that tasks take blocks of batches."""
    # the filter comes after: it would compute the tokens of a view that isn't stored another time
    view = stored(view.select(*(col(c) for c in order), "token_count", "tokens"), "view").where("token_count > 0")
    n_slots, slot = world * workers, rank * workers + worker
    parts = F.floor((F.col("token_count") + (size - 1)) / size)
    placed = running_sum(view.select(*(col(c) for c in order), "token_count", parts.alias("_parts")), order, "_parts", "_first")
    # the slot's are the batches j of _parts with (_first + j) % n_slots = slot
    skip = F.pmod(F.lit(slot) - F.col("_first"), F.lit(n_slots))
    taken = F.when(F.col("_parts") > skip, F.floor((F.col("_parts") - 1 - skip) / n_slots) + 1).otherwise(0)
    short = F.when(F.pmod(F.col("_first") + F.col("_parts") - 1, F.lit(n_slots)) == slot, F.col("_parts") * size - F.col("token_count")).otherwise(0)
    counted = placed.select(*(col(c) for c in order), "_first", (taken * size - short).cast("long").alias("_mine"))
    at = running_sum(counted, order, "_mine", "at").where("_mine > 0").drop("_mine")
    own = view.join(at, order).sortWithinPartitions("at").select("_first", "at", "tokens").mapInArrow(_own(size, slot, n_slots), "at long, tokens array<int>")
    made = cut(own, size)
    if drop_last:
        made = made.where(F.size("tokens") == size)
    if not shuffle:
        return made
    total = counted.agg(F.coalesce(F.sum("_mine"), F.lit(0))).first()[0]
    return _shuffled(made, size, -(-total // size), seed(epoch_seed, rank, worker))


#: Shuffled batches that follow one state of the generator.
BLOCK = 256
_STATE = "<16sBI"


def _states(size: int, n: int, start: int):
    """The generator's state before each block of batches. What a shuffle draws depends on the length alone, so the pass
    needs no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rng, any_batch = np.random.default_rng(start), np.arange(size)
            for low in range(0, -(-n // BLOCK), BLOCK):
                states = []
                for _ in range(low, min(low + BLOCK, -(-n // BLOCK))):
                    s = rng.bit_generator.state
                    states.append(struct.pack(_STATE, s["state"]["state"].to_bytes(16, "little"), s["has_uint32"], s["uinteger"]))
                    for _ in range(BLOCK):
                        rng.shuffle(any_batch)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(states))), pa.array(states, pa.binary())], ["_block", "_state"])

    return run


def _permute(size: int, start: int):
    """Rows (out_batch, tokens, _state) with their tokens in the order of the generator; it goes on from row to row where
    batches follow each other, and from the state of their block elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, any_batch, ready = np.random.default_rng(start), np.arange(size), -1
        for b in (batch.slice(*x) for batch in batches for x in slices(batch.column("tokens"), SLICE)):
            values, bounds = list_values(b.column("tokens"))
            values, states = values.astype(np.int32), b.column("_state")
            for k, number in enumerate(b.column("out_batch").to_pylist()):
                if number != ready:
                    state, has, spare = struct.unpack(_STATE, states[k].as_py())
                    own = rng.bit_generator.state
                    rng.bit_generator.state = {**own, "state": {**own["state"], "state": int.from_bytes(state, "little")}, "has_uint32": has, "uinteger": spare}
                    for _ in range(number % BLOCK):
                        rng.shuffle(any_batch)
                rng.shuffle(values[bounds[k] : bounds[k + 1]])
                ready = number + 1
            yield pa.RecordBatch.from_arrays([b.column("out_batch"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))], ["out_batch", "tokens"])

    return run


def _shuffled(made: DataFrame, size: int, n: int, start: int) -> DataFrame:
    """``made`` (of n batches) as one generator over all of them in turn would have it, block by block: first the states of
    the generator, by a task that reads nothing, then the batches of each block in a task of many."""
    spark = made.sparkSession
    states = stored(spark.range(1, numPartitions=1).mapInArrow(_states(size, n, start), "_block long, _state binary"), "states")
    placed = made.withColumn("_block", F.floor(F.col("out_batch") / BLOCK)).join(states, "_block")
    return placed.repartition("_block").sortWithinPartitions("out_batch").select("out_batch", "tokens", "_state").mapInArrow(_permute(size, start), "out_batch long, tokens array<int>")


def permutation(n: int, seed: int) -> np.ndarray:
    """Which document comes at each place in an epoch of one generator: the order that a shuffled list of n would have."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return order


def by_document(docs: DataFrame, order: list[str], rank: int = 0, world: int = 1, worker: int = 0, workers: int = 1, shuffle_seed: int | None = None, listed: bool = False) -> DataFrame:
    """The documents of one slot, whole: those whose number in the dataset, modulo the slots, is the slot's. With a seed
    the numbers follow a hash of seed and order, the same for all ranks; ``listed`` takes the order of ``permutation``
    instead, which the driver has to hold (8 bytes a document)."""
    if shuffle_seed is not None and not listed:
        docs = docs.withColumn("_key", F.xxhash64(F.lit(shuffle_seed), *(col(c) for c in order)))
        order = ["_key", *order]
    numbered = row_numbers(docs, order, "number")
    if shuffle_seed is not None and listed:
        spark = docs.sparkSession
        places = permutation(numbered.count(), shuffle_seed)
        mine = np.arange(rank * workers + worker, len(places), world * workers)
        chosen = spark.createDataFrame(pd.DataFrame({"_was": places[mine], "_now": mine}), "_was long, _now long")
        return numbered.join(chosen, numbered["number"] == chosen["_was"]).drop("number", "_was").withColumnRenamed("_now", "number")
    return numbered.where(F.pmod("number", F.lit(world * workers)) == rank * workers + worker).drop("_key")


def iterate(batched: DataFrame) -> Iterator[np.ndarray]:
    """Batches of ``load`` in order, a partition at a time."""
    for row in stored(batched, "batches").orderBy("out_batch").toLocalIterator(prefetchPartitions=True):
        yield np.array(row["tokens"], np.uint32)
