"""Sparse Merkle trees of depth 256 over 32-byte keys: roots, proofs, verification.

Keys are grouped by their first byte; a group folds its 248 lower levels in one task, level by level for all its keys
at once, and the driver folds 256 roots through the eight levels above. A proof needs its key's group only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.blake3 import blake3, hash_pairs
from lodestone.functions.columns import col, stored

DEPTH, TOP = 256, 8
ABSENT, PRESENT = blake3(b"\x10\x00"), blake3(b"\x10\x01")
EMPTY = [ABSENT]
for _ in range(DEPTH):
    EMPTY.append(blake3(b"\x11" + EMPTY[-1] * 2))
EMPTY_ROOT = EMPTY[DEPTH]


def bit(key: bytes, i: int) -> int:
    """Bit i, the highest of the first byte first."""
    return key[i >> 3] >> (7 - (i & 7)) & 1


def _node(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return hash_pairs(0x11, left, right)


def _array(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8)


def levels(keys: np.ndarray, down_to: int, asked: np.ndarray | None = None, nodes: np.ndarray | None = None, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Fold sorted distinct keys (n x 32) from ``depth`` up to ``down_to``. Returns the prefixes' bits, their nodes and, for
    keys asked for (m x 32), the siblings on their way: m x (depth - down_to) x 32, the highest first."""
    if nodes is None:
        nodes = np.repeat(_array(PRESENT)[None], len(keys), 0)
    # a prefix is told by its first key; how many bits that has in common with the key before says where prefixes part
    shared, rep = _shared(keys), np.arange(len(keys))
    if asked is not None:
        siblings = np.empty((len(asked), depth - down_to, 32), np.uint8)
    for d in range(depth - 1, down_to - 1, -1):
        if asked is not None:
            found = _lookup(keys, rep, asked, d)
            siblings[:, d - down_to] = np.where((found >= 0)[:, None], nodes[found] if len(nodes) else 0, _array(EMPTY[DEPTH - d - 1]))
        if not len(rep):
            continue
        first = shared[rep] < d
        owner = np.cumsum(first) - 1
        both = np.empty((int(owner[-1]) + 1, 2, 32), np.uint8)
        both[:] = _array(EMPTY[DEPTH - d - 1])
        both[owner, keys[rep, d >> 3] >> (7 - (d & 7)) & 1] = nodes
        nodes = _node(both[:, 0], both[:, 1])
        rep = rep[first]
    return np.unpackbits(keys[rep], axis=1)[:, :down_to], nodes, siblings if asked is not None else None


def _shared(keys: np.ndarray) -> np.ndarray:
    """How many bits each of the sorted keys has in common with the one before; -1 for the first."""
    out = np.full(len(keys), -1)
    if len(keys) > 1:
        other = keys[1:] ^ keys[:-1]
        byte = (other != 0).argmax(1)
        out[1:] = 8 * byte + np.unpackbits(other[np.arange(len(other)), byte][:, None], axis=1).argmax(1)
    return out


def _lookup(keys: np.ndarray, rep: np.ndarray, asked: np.ndarray, d: int) -> np.ndarray:
    """Among the prefixes of d + 1 bits (``rep``: their first keys), that of each asked key with bit d flipped, or -1."""
    if not len(rep):
        return np.full(len(asked), -1)
    mask = np.packbits(np.arange(DEPTH) <= d)
    other = asked & mask
    other[:, d >> 3] ^= 0x80 >> (d & 7)
    at = np.minimum(np.searchsorted(_keys(keys), _keys(other)), len(keys) - 1)
    there = ((keys[at] & mask) == other).all(1)
    return np.where(there, np.searchsorted(rep, at), -1)


def _keys(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as single values that compare as bytes do."""
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1]))).ravel()


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in values), np.uint8).reshape(-1, 32)


def _sorted(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, axis=0) if len(keys) else keys


def _bucket(key: Column) -> Column:
    return F.conv(F.substring(F.hex(key), 1, 2), 16, 10).cast("int")


#: Keys that a task folds together: fewer, and the cost of a level is that of its numpy calls.
TASK_KEYS = 4096


def _parts(keys: DataFrame) -> int:
    """As many ranges of the first byte as the keys are tasks, 256 at most."""
    return max(1, min(1 << TOP, -(-keys.count() // TASK_KEYS)))


def bucket_roots(keys: DataFrame, column: str = "doc_hash", by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(by..., bucket, node): the node at depth eight above each group of keys. A task folds the neighbouring groups of
    one of ``parts`` ranges together: the cost of a level is that of a few large array operations."""
    by = by or []
    rows = stored(keys.select(*(col(c) for c in by), col(column).alias("key")).distinct(), "keys")
    n = min(1 << TOP, parts or _parts(rows))
    # a number of partitions that is given isn't lowered for being of few bytes: folding takes time, not room
    rows = rows.withColumn("part", F.floor(_bucket(F.col("key")) * n / (1 << TOP))).repartition(n, "part")
    schema = T.StructType([*(keys.schema[c] for c in by), T.StructField("bucket", T.IntegerType()), T.StructField("node", T.BinaryType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bits, nodes, _ = levels(_sorted(_matrix(frame["key"])), TOP)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * len(bits) for c in by}, "bucket": np.packbits(bits, axis=1)[:, 0].astype(np.int32), "node": [x.tobytes() for x in nodes]})

    return rows.groupBy(*by, "part").applyInPandas(run, schema)


def top(nodes: dict[int, bytes]) -> list[list[bytes]]:
    """Nodes of depth 8, 7, ..., 0 from those of the groups."""
    row = [nodes.get(b, EMPTY[DEPTH - TOP]) for b in range(1 << TOP)]
    out = [row]
    while len(row) > 1:
        m = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        row = [x.tobytes() for x in _node(m[::2], m[1::2])]
        out.append(row)
    return out


def smt_root(keys: DataFrame, column: str = "doc_hash") -> bytes:
    return top({r.bucket: bytes(r.node) for r in bucket_roots(keys, column).collect()})[-1][0]


def smt_roots(keys: DataFrame, by: str, column: str = "doc_hash") -> dict[object, bytes]:
    """The root of each value of ``by``: 256 nodes each come to the driver."""
    groups: dict[object, dict[int, bytes]] = {}
    for r in bucket_roots(keys, column, [by]).collect():
        groups.setdefault(r[by], {})[r.bucket] = bytes(r.node)
    return {k: top(v)[-1][0] for k, v in groups.items()}


def prove(keys: DataFrame, asked: DataFrame, column: str = "doc_hash") -> DataFrame:
    """(key, present, siblings, root) for many keys at once: presence or absence, with 256 siblings, the highest first."""
    keys = stored(keys.select(col(column)).distinct(), "keys")
    nodes = {r.bucket: bytes(r.node) for r in bucket_roots(keys, column).collect()}
    above = top(nodes)
    root = above[-1][0]
    n = _parts(keys)
    placed = lambda df: df.select(col(column).alias("key")).distinct().withColumn("part", F.floor(_bucket(F.col("key")) * n / (1 << TOP)))
    wanted = placed(asked)
    # only the groups that a key asked for falls into are folded again
    have = placed(keys).withColumn("bucket", _bucket(F.col("key"))).join(F.broadcast(wanted.select(_bucket(F.col("key")).alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")

    def run(there: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        if not len(wants):
            return pd.DataFrame({"key": [], "present": [], "siblings": [], "root": []})
        held, want = _sorted(_matrix(there["key"])), _matrix(wants["key"])
        _, _, below = levels(held, TOP, want)
        known = {k.tobytes() for k in held}
        out = []
        for k, own in zip(want, below, strict=True):
            high = [above[TOP - d][(int(k[0]) >> (TOP - d)) ^ 1] for d in range(1, TOP + 1)]
            out.append((k.tobytes(), k.tobytes() in known, high + [s.tobytes() for s in own], root))
        return pd.DataFrame(out, columns=["key", "present", "siblings", "root"])

    return have.groupBy("part").cogroup(wanted.groupBy("part")).applyInPandas(run, "key binary, present boolean, siblings array<binary>, root binary")


def roots_of(keys: np.ndarray, present: np.ndarray, siblings: np.ndarray) -> np.ndarray:
    """The roots that proofs lead to: keys n x 32, siblings n x 256 x 32."""
    bits = np.unpackbits(keys, axis=1).astype(bool)
    node = np.where(present[:, None], _array(PRESENT), _array(ABSENT))
    for d in range(DEPTH - 1, -1, -1):
        other, right = siblings[:, d], bits[:, d][:, None]
        node = _node(np.where(right, other, node), np.where(right, node, other))
    return node


@dataclass(frozen=True)
class Proof:
    """Of a key's presence, or absence."""

    key: bytes
    present: bool
    siblings: tuple[bytes, ...]

    def root(self) -> bytes:
        if len(self.key) != 32 or len(self.siblings) != DEPTH or any(len(s) != 32 for s in self.siblings):
            raise ValueError("a proof has a key of 32 bytes and 256 siblings of 32")
        return roots_of(_array(self.key)[None], np.array([self.present]), _array(b"".join(self.siblings)).reshape(1, DEPTH, 32))[0].tobytes()

    def verify(self, root: bytes) -> bool:
        return self.root() == root


@F.pandas_udf(T.BooleanType())
def _verified(key: pd.Series, present: pd.Series, siblings: pd.Series, root: pd.Series) -> pd.Series:
    if not len(key):
        return pd.Series([], dtype=bool)
    paths = np.frombuffer(b"".join(bytes(s) for path in siblings for s in path), np.uint8).reshape(len(key), DEPTH, 32)
    got = roots_of(_matrix(key), present.to_numpy(bool), paths)
    return pd.Series((got == _matrix(root)).all(1))


def verified(proofs: DataFrame) -> DataFrame:
    """``proofs`` with ``verified``: whether each leads to its root."""
    return proofs.withColumn("verified", _verified("key", "present", "siblings", "root"))


def proofs_for(keys: DataFrame, asked: list[bytes], column: str = "doc_hash") -> list[Proof]:
    frame = keys.sparkSession.createDataFrame([(bytearray(k),) for k in asked], f"`{column}` binary")
    return [Proof(bytes(r.key), r.present, tuple(bytes(s) for s in r.siblings)) for r in stored(prove(keys, frame, column), "proofs").collect()]
