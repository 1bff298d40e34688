"""Near duplicates by a multi-index Hamming join of b-bit minhash signatures.

A text becomes a set of word pairs, the set a signature of ``slots`` minhashes of ``bits`` bits. The distance
of two signatures is the number of slots in which they differ. The slots are cut into chunks; chunk i allows
r_i errors, with sum(r_i + 1) > ``distance``. By pigeonhole, two signatures within the distance agree in some
chunk up to its r_i errors. Every way to leave out r_i slots of chunk i is enumerated and what remains is a
key, so such a pair shares at least one key: no pair within the distance is missed.

Rows of one key, a bucket, are then compared in full. A breadth-first search measures each signature that it reaches
against those not reached yet: exactly the components of the graph of all pairs within the distance, in edges linear
in the bucket, however many copies it holds. Components over all buckets come from alternating large-star and
small-star steps. Links are counted, not listed: each pair of signatures counts in the bucket of the first key that
it shares, with the number of documents that the other signature stands for. A bucket of more than ``BLOCK``
signatures is cut into blocks, and each pair of blocks is a bucket of its own, wherever there is room. Nothing is
capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _flat
from lodestone.llm._common import col, forget, fresh, ship, stored, trimmed


#: Signatures that one task compares at a time, pairs whose slots are compared at once (some 700 bytes each), and signatures
#: whose keys are made at once.
BLOCK, PAIRS, KEYED = 4096, 1 << 15, 2048


@dataclass(frozen=True)
class NearDedup:
    """slots, bits: of a signature. distance: slots in which near copies may differ. errors: allowed in a chunk.
    shingle: words in a shingle. The defaults find copies in which up to about a tenth of the words differ."""

    slots: int = 64
    bits: int = 16
    distance: int = 25
    errors: int = 1
    shingle: int = 2
    seed: int = 7

    def __post_init__(self) -> None:
        if not (0 <= self.distance < self.slots and 1 <= self.bits <= 16 and self.shingle >= 1 and self.errors >= 0):
            raise ValueError("bad parameters of a signature")

    def chunks(self) -> list[tuple[list[int], int]]:
        """(slots, allowed errors) of each chunk: errors + 1 summed over the chunks is distance + 1."""
        left, allowed = self.distance + 1, []
        while left > 0:
            allowed.append(min(self.errors, left - 1))
            left -= allowed[-1] + 1
        weight = np.array([r + 1 for r in allowed], float)
        bounds = np.round(np.concatenate([[0], np.cumsum(weight)]) / weight.sum() * self.slots).astype(int)
        out = [(list(range(a, b)), r) for a, b, r in zip(bounds[:-1], bounds[1:], allowed, strict=True)]
        return [(s, min(r, len(s))) for s, r in out]

    def masks(self) -> list[tuple[int, tuple[int, ...]]]:
        """(chunk, slots that stay) of each key."""
        return [(k, tuple(x for x in s if x not in gone)) for k, (s, r) in enumerate(self.chunks()) for gone in combinations(s, r)]


def signatures(texts: pa.Array, p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """(n x slots of uint16, whether the row has a text). Letter case and punctuation don't count. A text of fewer
    words than a shingle is one shingle; one without words counts by its bytes; empty texts have no signature."""
    data, offsets = _flat.flat(texts)
    n = len(offsets) - 1
    data = _flat.fold(data)
    starts, ends, row = _flat.words(data, offsets)
    h = _flat.hashes(data, starts, ends)
    bounds = _flat.segments(row, n)
    s = h
    for k in range(1, p.shingle):  # the hash at i covers words i .. i + k
        s = _flat.mix64(s[: max(0, len(h) - k)] * np.uint64(0x9FB21C651E98DF25) + h[k:])
    # the last shingle of a row starts at its last word but shingle - 1; a short row keeps one, of all its words
    count = bounds[1:] - bounds[:-1]
    size = np.where(count >= p.shingle, count - p.shingle + 1, 0)
    keep = np.repeat(bounds[:-1], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    short = np.flatnonzero((count < p.shingle) & (offsets[1:] > offsets[:-1]))
    whole = _flat.hashes(data, offsets[short], offsets[short + 1])
    has = count > 0
    few = has[short]
    if few.any():
        whole[few] = _flat.reduce_rows(np.add, h * np.uint64(0x9FB21C651E98DF25), bounds[: n + 1], 0)[short[few]]
    values = np.concatenate([s[keep], whole])
    owner = np.concatenate([np.repeat(np.arange(n), size), short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    values = (_flat.mix64(values) >> np.uint64(32)).astype(np.uint32)
    cut = _flat.segments(owner, n)
    full = np.flatnonzero(cut[1:] > cut[:-1])
    out = np.zeros((n, p.slots), np.uint32)
    rng = np.random.default_rng(p.seed)
    a = rng.integers(1, 1 << 31, p.slots, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, p.slots, dtype=np.uint32)
    for low in range(0, len(full), 512):  # the shingles of few rows at a time stay in the cache
        rows = full[low : low + 512]
        part = values[cut[rows[0]] : cut[rows[-1] + 1]]
        at = cut[rows] - cut[rows[0]]
        for k in range(p.slots):
            out[rows, k] = np.minimum.reduceat((part ^ (part >> np.uint32(15))) * a[k] + b[k], at)
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    out = (out ^ (out >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    out = ((out ^ (out >> np.uint32(16))) & np.uint32((1 << p.bits) - 1)).astype(np.uint16)
    some = np.zeros(n, bool)
    some[full] = True
    return out, some


def keys(sigs: np.ndarray, p: NearDedup) -> np.ndarray:
    """n x masks of 64-bit keys."""
    masks = p.masks()
    rng = np.random.default_rng(p.seed + 1)
    out = np.empty((len(sigs), len(masks)), np.uint64)
    wide = sigs.astype(np.uint64) + np.uint64(1)
    mult = rng.integers(1, 1 << 63, p.slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, len(masks), dtype=np.uint64)
    wide = _flat.mix64(wide * mult)
    for j, (_, stay) in enumerate(masks):
        out[:, j] = _flat.mix64(wide[:, list(stay)].sum(1, dtype=np.uint64) + salt[j])
    return out


def components(sigs: np.ndarray, distance: int) -> np.ndarray:
    """Of one bucket: for each signature the first of its component in the graph of all pairs within ``distance``."""
    n = len(sigs)
    root, left = np.arange(n), np.arange(n)
    while len(left):
        head, left = left[0], left[1:]
        queue = [head]
        while queue and len(left):
            at = queue.pop()
            near = (sigs[left] != sigs[at]).sum(1) <= distance
            queue.extend(left[near])
            root[left[near]] = head
            left = left[~near]
    return root


def _sign(p: NearDedup, id_name: str, text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _flat.slices(whole, text_name):
                sigs, some = signatures(part.column(text_name), p)
                rows = np.flatnonzero(some)
                raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * p.slots * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sigs[rows]))])
                yield pa.RecordBatch.from_arrays([part.column(id_name).take(pa.array(rows)), raw], ["id", "sig"])

    return run


def _matrix(column: pa.Array, p: NearDedup) -> np.ndarray:
    return _flat.flat(column)[0].view(np.uint16).reshape(len(column), p.slots)


def _enumerate(p: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, KEYED):
                part = whole.slice(at, KEYED)
                k = keys(_matrix(part.column("sig"), p), p)
                nodes = np.repeat(part.column("node").to_numpy(), k.shape[1])
                masks = np.tile(np.arange(k.shape[1], dtype=np.int16), len(k))
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(nodes), pa.array(masks)], ["key", "node", "mask"])

    return run


def _runs(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by ``name``, cut so that no run of equal values crosses a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(name).to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        if held and held[-1].column(name)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key is not theirs alone."""
    for table in _runs("key", batches):
        k = table.column("key").to_numpy()
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        yield from table.filter(pa.array(same[1:] | same[:-1])).combine_chunks().to_batches()


def _links(sigs: np.ndarray, weight: np.ndarray, mask: np.ndarray, side: np.ndarray, cut: np.ndarray, p: NearDedup) -> np.ndarray:
    """For each row the documents within the distance that it meets first in its bucket (``cut`` are the buckets' bounds).
    In a pair of two blocks, rows of one block have met elsewhere."""
    stay = np.zeros((len(p.masks()), p.slots), np.float32)
    for j, (_, slots) in enumerate(p.masks()):
        stay[j, list(slots)] = 1
    out = np.zeros(len(sigs), np.int64)
    stop = np.repeat(cut[1:], np.diff(cut))
    after = stop - np.arange(len(sigs)) - 1
    sums = np.concatenate([[0], np.cumsum(after)])
    two = np.repeat(np.maximum.reduceat(side, cut[:-1]) != np.minimum.reduceat(side, cut[:-1]), np.diff(cut))
    low = 0
    while low < len(sigs):
        high = max(low + 1, int(np.searchsorted(sums, sums[low] + PAIRS, "right")) - 1)
        n = after[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(sums[low:high] - sums[low], n)
        apart = ~two[a] | (side[a] != side[b])
        a, b = a[apart], b[apart]
        differ = sigs[a] != sigs[b]
        near = differ.sum(1) <= p.distance
        a, b, differ = a[near], b[near], differ[near]
        first = (differ.astype(np.float32) @ stay.T == 0).argmax(1) == mask[a] if len(a) else np.zeros(0, bool)
        a, b = a[first], b[first]
        out += np.bincount(a, weight[b], len(out)).astype(np.int64) + np.bincount(b, weight[a], len(out)).astype(np.int64)
        low = high
    return out


def _verify(p: NearDedup):
    """(u, v, links): the edges of each bucket (links null), and what each signature adds to its links (v null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs("key", batches):
            k, node, sigs = table.column("key").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("sig").combine_chunks(), p)
            weight, mask, side = (table.column(c).to_numpy() for c in ("weight", "mask", "side"))
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            size = np.diff(cut)
            links = _links(sigs, weight, mask, side, cut, p)
            two = cut[:-1][size == 2]
            ok = (sigs[two] != sigs[two + 1]).sum(1) <= p.distance
            a, b = [node[two[ok]]], [node[two[ok] + 1]]
            for low, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
                root = components(sigs[low : low + n], p.distance)
                linked = np.flatnonzero(root != np.arange(n))
                a.append(node[low + root[linked]])
                b.append(node[low + linked])
            a, b = np.concatenate(a), np.concatenate(b)
            some = np.flatnonzero(links)
            for frame in (_distinct(np.minimum(a, b), np.maximum(a, b)).assign(links=None), _summed(node[some], links[some])):
                if len(frame):
                    yield from pa.Table.from_pandas(frame, _VERIFIED, preserve_index=False).to_batches()

    return run


_VERIFIED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _summed(node: np.ndarray, links: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"u": node, "links": links}).groupby("u", as_index=False).sum().assign(v=None)


def _blocks(shared: DataFrame) -> DataFrame:
    """Buckets of at most about ``BLOCK`` rows: larger ones become pairs of blocks, each with a key of its own."""
    large = stored(shared.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        return shared.withColumn("side", F.lit(0))
    met = shared.join(large, "key", "left")
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = met.where("blocks IS NOT NULL").withColumn("side", own).withColumn("other", other)
    split = split.withColumn("key", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")))
    return met.where("blocks IS NULL").select("key", "node", "mask", F.lit(0).alias("side")).unionByName(split.select("key", "node", "mask", "side"))


def _distinct(low: np.ndarray, high: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"u": high, "v": low}).drop_duplicates()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for edges (u > v), by alternating large-star and small-star
    steps. Each node's edges are one row after aggregation, so a step's cost follows the number of edges."""
    star = stored(edges.distinct(), "edges")
    seen = None
    while True:
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        before, star = star, stored(small, "edges")
        forget(before)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDedup = NearDedup()) -> DataFrame:
    """(doc_id, keep_id, n_links) for each document with a near copy: the least id of its group (its own, if it stays) and the
    number of other documents whose signatures are within the distance of its own. Of each link both ends are counted.

    Null or empty texts have no near copies; rows without id take no part; rows that repeat an id with the same
    text are one document, rows that repeat it with other texts are several of one id, whose links add up. A text of any
    length counts whole. Other columns are ignored, whatever their names. An empty table gives no rows. Ids are cast to
    long, what can't be is an error."""
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL AND text != ''")
    signed = rows.mapInArrow(trimmed(_sign(params, "id", "text")), "id long, sig binary")
    signed = stored(signed.select("id", F.xxhash64("sig").alias("node"), "sig"), "signatures")
    members = stored(signed.select("id", "node").distinct(), "members")
    nodes = signed.groupBy("node").agg(F.first("sig").alias("sig"))
    sigs = nodes.join(members.groupBy("node").agg(F.count("*").alias("weight")), "node")
    keyed = nodes.mapInArrow(trimmed(_enumerate(params)), "key long, node long, mask short")
    shared = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_shared), "key long, node long, mask short")
    buckets = _blocks(stored(shared, "buckets")).join(sigs, "node").repartition("key").sortWithinPartitions("key")
    verified = stored(buckets.mapInArrow(trimmed(_verify(params)), "u long, v long, links long"), "verified")
    roots = connected(verified.where("v IS NOT NULL").select("u", "v"))
    links = verified.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("others"))
    met = members.join(roots, "node", "left").join(sigs.select("node", "weight"), "node").join(links, "node", "left")
    grouped = met.select("id", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    groups = grouped.groupBy("root").agg(F.min("id").alias("keep_id"), F.max("id").alias("high")).where("keep_id < high").select("root", "keep_id")
    return grouped.join(groups, "root").groupBy(F.col("id").alias("doc_id"), "keep_id").agg(F.sum("n_links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDedup = NearDedup()) -> DataFrame:
    """``docs`` without the documents that are in a group of near copies with one of a smaller id, with all columns. Rows
    without id or text stay, repeated rows of a document that stays do, too; an empty table stays empty."""
    pairs = near_duplicates(docs, id_col, text_col, params)
    (key,) = fresh(docs, "near_key")
    gone = stored(pairs.where("doc_id != keep_id").select(F.col("doc_id").alias(key)).distinct(), "near-gone")
    return docs.join(gone, col(id_col).cast("long") == gone[key], "left_anti")
