"""Exact duplicates by a log-structured merge index of digests.

Where a table is read, memtables take its (digest, id) and are flushed, when full, as runs sorted by digest, each
digest once with its smallest identifier and its number of rows. The runs are partitioned over the cluster by digest;
each partition is an index of its own, whose runs have Bloom filters. A batch that comes in first asks the runs, by
way of their filters. Digests that are found count as hits of the run's entry and enter the memtable only to bring a
smaller identifier. When ``fanout`` runs of a level exist they are compacted into one of the next level, which keeps
the smallest identifier and adds up the hits. Every hit is then verified by its bytes: each task compares the texts of
a digest that it reads among themselves and hands on one of each, so that a text of any number of copies travels once
a task; texts of one digest that differ are no duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import _flat
from lodestone.llm._common import col, fresh, ship, stored

NO_ID = np.iinfo(np.int64).max  # a missing identifier: larger than any other

#: Digests that are hits are broadcast up to this many rows (about 50 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


class Bloom:
    """A Bloom filter over 128-bit digests, about 10 bits for each."""

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(6, int(np.ceil(np.log2(max(1, len(high)) * 10))))) - 1)
        self.bits = np.zeros((int(self.mask) + 1) >> 3, np.uint8)
        for at in self._at(high, low):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _at(self, high: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(4):
            yield (high + np.uint64(k) * (low | np.uint64(1))) & self.mask

    def maybe(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.ones(len(high), bool)
        for at in self._at(high, low):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


@dataclass
class Run:
    """Sorted by digest, each once: smallest identifier and number of rows."""

    high: np.ndarray
    low: np.ndarray
    ids: np.ndarray
    count: np.ndarray
    level: int = 0
    bloom: Bloom = field(init=False)

    def __post_init__(self) -> None:
        order = np.lexsort((self.ids, self.low, self.high))
        high, low = self.high[order], self.low[order]
        first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, int)
        self.count = np.add.reduceat(self.count[order], first) if len(first) else self.count[:0]
        self.high, self.low, self.ids = high[first], low[first], self.ids[order][first]
        self.bloom = Bloom(self.high, self.low)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The entry of each digest, or -1."""
        out = np.full(len(high), -1)
        some = np.flatnonzero(self.bloom.maybe(high, low))
        if len(some) and len(self.high):
            at = np.searchsorted(self.high, high[some])
            inside = np.minimum(at, len(self.high) - 1)
            while (on := (at < len(self.high)) & (self.high[inside] == high[some]) & (self.low[inside] < low[some])).any():
                at = at + on  # digests of one upper half: hardly ever more than one
                inside = np.minimum(at, len(self.high) - 1)
            ok = (self.high[inside] == high[some]) & (self.low[inside] == low[some])
            out[some[ok]] = inside[ok]
        return out


class LsmIndex:
    """digest -> (smallest identifier, number of rows)."""

    def __init__(self, memtable: int = 65_536, fanout: int = 4) -> None:
        self.limit, self.fanout = memtable, fanout
        self.runs: list[Run] = []
        self.mem: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, count: np.ndarray | None = None) -> None:
        count = np.ones(len(ids), np.int64) if count is None else count.copy()
        for run in self.runs:
            at = run.find(high, low)
            hit = at >= 0
            np.add.at(run.count, at[hit], count[hit])
            count[hit] = 0
            stay = ~hit
            stay[hit] = ids[hit] < run.ids[at[hit]]
            high, low, ids, count = high[stay], low[stay], ids[stay], count[stay]
        if len(ids):
            self.mem.append((high, low, ids, count))
            self.held += len(ids)
            if self.held >= self.limit:
                self.flush()

    def flush(self) -> None:
        if self.mem:
            self.runs.append(Run(*(np.concatenate(x) for x in zip(*self.mem, strict=True))))
            self.mem, self.held = [], 0
        level = 0
        while len(same := [r for r in self.runs if r.level == level]) >= self.fanout:
            self.runs = [r for r in self.runs if r.level != level] + [self.merge(same, level + 1)]
            level += 1

    @staticmethod
    def merge(runs: list[Run], level: int) -> Run:
        return Run(*(np.concatenate([getattr(r, k) for r in runs]) for k in ("high", "low", "ids", "count")), level)

    def compact(self) -> Run:
        self.flush()
        if len(self.runs) != 1:
            empty = np.zeros(0, np.uint64)
            self.runs = [self.merge(self.runs, 99) if self.runs else Run(empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return self.runs[0]


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    pair = _flat.flat(column)[0].view(">u8").reshape(-1, 2).astype(np.uint64)
    return pair[:, 0].copy(), pair[:, 1].copy()


def _entries(run: Run, least: int) -> pa.RecordBatch:
    """(digest, keep_id, copies) of a run's entries of at least so many rows."""
    some = np.flatnonzero(run.count >= least)
    raw = np.stack([run.high[some], run.low[some]], 1).astype(">u8")
    digest = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * 16).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    return pa.RecordBatch.from_arrays([digest, pa.array(run.ids[some], mask=run.ids[some] == NO_ID), pa.array(run.count[some])], ["digest", "keep_id", "copies"])


def _flushed(memtable: int):
    """Sorted runs of the memtables of one task, before anything travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        flush = lambda: _entries(Run(*(np.concatenate(x) for x in zip(*held, strict=True))), 1)
        for batch in batches:
            if batch.num_rows:
                held.append((*_pairs(batch.column("digest")), batch.column("id").fill_null(NO_ID).to_numpy(), np.ones(batch.num_rows, np.int64)))
                size += batch.num_rows
            if size >= memtable:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _index(memtable: int, fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(memtable, fanout)
        for batch in batches:
            if batch.num_rows:
                index.add(*_pairs(batch.column("digest")), batch.column("keep_id").fill_null(NO_ID).to_numpy(), batch.column("copies").to_numpy())
        yield _entries(index.compact(), 2)

    return run


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


_HITS = "digest binary, keep_id long, copies long"


def duplicate_digests(keyed: DataFrame, memtable: int = 65_536, fanout: int = 4) -> DataFrame:
    """(digest, keep_id, copies) of the digests that more than one row of (id, digest) has, from the index."""
    ship(keyed.sparkSession)
    runs = keyed.where("digest IS NOT NULL").select("digest", "id").mapInArrow(_flushed(memtable), _HITS)
    return stored(runs.repartition("digest").mapInArrow(_index(memtable, fanout), _HITS), "hits")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, id, text): each text that the task reads once, with its least id; bytes are compared, not hashes alone."""
    seen: dict[tuple[bytes, bytes], int | None] = {}
    held = 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([d for d, _ in seen], pa.binary()), pa.array(seen.values(), pa.int64()), pa.array([t for _, t in seen], pa.large_binary())], ["digest", "id", "text"])
    for whole in batches:
        for part in _flat.slices(whole, "text"):
            texts = part.column("text").cast(pa.large_string()).cast(pa.large_binary())
            for d, t, i in zip(part.column("digest").to_pylist(), texts.to_pylist(), part.column("id").to_pylist(), strict=True):
                if (d, t) not in seen:
                    held += len(t)
                    seen[d, t] = i
                elif i is not None and (seen[d, t] is None or i < seen[d, t]):
                    seen[d, t] = i
            if held >= 1 << 26:
                yield out()
                seen, held = {}, 0
    if seen:
        yield out()


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests, of rows sorted by them, whose texts aren't all the same bytes."""
    at = first = None
    bad: dict[bytes, None] = {}
    for whole in batches:
        for part in _flat.slices(whole, "text"):
            for d, t in zip(part.column("digest").to_pylist(), part.column("text").to_pylist(), strict=True):
                if d != at:
                    at, first = d, t
                elif t != first:
                    bad[d] = None
    yield pa.RecordBatch.from_arrays([pa.array(list(bad), pa.binary())], ["digest"])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _first(key: str, mark: str | None):
    """The first row that the task reads of each key; with ``mark`` all rows, and which are first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for k in batch.column(key).to_pylist():
                new.append(k not in seen)
                seen.add(k)
            flags = pa.array(new, pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, flags], [*batch.schema.names, mark]) if mark else batch.filter(flags)

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, memtable: int, fanout: int) -> DataFrame:
    """(digest, mark, keep_id) of the texts that more than one row has. ``mark`` is null but where texts of one digest
    differ: there it is the text, and each has its own keep_id."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    hits = duplicate_digests(rows.select("id", digest(F.col("text")).alias("digest")), memtable, fanout)
    asked = rows.withColumn("digest", digest(F.col("text"))).join(_few(hits.select("digest")), "digest", "left_semi")
    texts = asked.select("digest", "id", "text").mapInArrow(_distinct, "digest binary, id long, text binary")
    differ = stored(texts.repartition("digest").sortWithinPartitions("digest").mapInArrow(_differing, "digest binary"), "differing")
    if differ.isEmpty():
        return hits.select("digest", F.lit(None).cast("string").alias("mark"), "keep_id")
    own = asked.join(differ, "digest", "left_semi").groupBy("digest", F.col("text").alias("mark")).agg(F.min("id").alias("keep_id"))
    return stored(hits.join(differ, "digest", "left_anti").select("digest", F.lit(None).cast("string").alias("mark"), "keep_id").unionByName(own), "classes")


def _met(docs: DataFrame, id_col: str, text_col: str, memtable: int, fanout: int) -> tuple[DataFrame, str, str, str]:
    """``docs``, and the names of three columns: what stands for the text (null, if no other row has it), the row's id and
    the least id of the text."""
    key, i, keep, d, mark = fresh(docs, "dup_key", "dup_id", "dup_keep", "dup_digest", "dup_mark")
    classes = _classes(docs, id_col, text_col, memtable, fanout)
    stands = F.coalesce(F.unhex(F.sha2("mark", 256)), F.col("digest"))
    side = _few(classes.select(F.col("digest").alias(d), F.col("mark").alias(mark), F.col("keep_id").alias(keep), stands.alias(key)))
    rows = docs.withColumn(f"{d}_", digest(col(text_col))).withColumn(i, col(id_col).cast("long"))
    same = (F.col(f"{d}_") == F.col(d)) & (F.col(mark).isNull() | (F.col(mark) == col(text_col).cast("string")))
    return rows.join(side, same, "left").drop(d, f"{d}_", mark), key, i, keep


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable: int = 65_536, fanout: int = 4) -> DataFrame:
    """(doc_id, keep_id, is_duplicate) for every row: keep_id is the smallest id of the rows with the same bytes.

    Null texts are no duplicates of each other; the empty text is a text. A null id is larger than any other. Of rows
    with the same id and text one is no duplicate, the rest are. A text of any length counts whole. Other columns are
    ignored, whatever their names. An empty table gives no rows. Ids are cast to long, what can't be is an error."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    met = stored(_met(rows, "doc_id", "text", memtable, fanout)[0].select("doc_id", "dup_keep", "dup_key"), "met")
    mine = F.col("doc_id").eqNullSafe(F.col("dup_keep"))
    alone = met.where("dup_key IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(False).alias("is_duplicate"))
    others = met.where(F.col("dup_key").isNotNull() & ~mine).select("doc_id", F.col("dup_keep").alias("keep_id"), F.lit(True).alias("is_duplicate"))
    # rows of the id to be kept: one as a rule; where there are more, each task keeps one, and one of those stays
    kept = met.where(F.col("dup_key").isNotNull() & mine).mapInArrow(_first("dup_key", "first"), "doc_id long, dup_keep long, dup_key binary, first boolean")
    nth = F.row_number().over(Window.partitionBy("dup_key").orderBy("doc_id"))
    one = kept.where("first").withColumn("nth", nth).select("doc_id", F.col("dup_keep").alias("keep_id"), (F.col("nth") > 1).alias("is_duplicate"))
    more = kept.where("NOT first").select("doc_id", F.col("dup_keep").alias("keep_id"), F.lit(True).alias("is_duplicate"))
    return alone.unionByName(others).unionByName(one).unionByName(more)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable: int = 65_536, fanout: int = 4) -> DataFrame:
    """``docs`` with one row for each distinct text: the one of the smallest id, with all its columns.

    Rows with null text stay; the empty text is a text; a null id is larger than any other; of rows with the same id and
    text one stays. An empty table stays empty."""
    met, key, i, keep = _met(docs, id_col, text_col, memtable, fanout)
    alone = met.where(F.col(key).isNull()).drop(key, i, keep)
    mine = met.where(F.col(key).isNotNull() & F.col(i).eqNullSafe(F.col(keep))).drop(i, keep)
    one = mine.mapInArrow(_first(key, None), mine.schema)
    (nth,) = fresh(one, "nth")
    best = one.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1)
    return alone.unionByName(best.drop(nth, key))
