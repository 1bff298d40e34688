"""Merkle roots: leaves are hashed under 0x00, pairs under 0x01, an odd level repeats its last node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.blake3 import hash_rows
from lodestone.functions.columns import col
from lodestone.operators.prefix import row_numbers

EMPTY = b"\0" * 32


def _tag(tag: int, *parts: np.ndarray, algorithm: str = "blake3") -> np.ndarray:
    rows = np.concatenate([np.full((len(parts[0]), 1), tag, np.uint8), *parts], 1)
    if algorithm == "blake3":
        return hash_rows(rows)
    return np.frombuffer(b"".join(hashlib.new(algorithm, r.tobytes()).digest() for r in rows), np.uint8).reshape(-1, 32)


def fold(nodes: np.ndarray, height: int | None = None, algorithm: str = "blake3") -> np.ndarray:
    """One node from n x 32 nodes: up to a single one, or exactly ``height`` levels."""
    level = 0
    while len(nodes) > 1 or height is not None and level < height:
        if len(nodes) % 2:
            nodes = np.concatenate([nodes, nodes[-1:]])
        nodes = _tag(1, nodes[::2], nodes[1::2], algorithm=algorithm)
        level += 1
    return nodes[0]


def _matrix(items: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in items), np.uint8).reshape(-1, 32)


def root_of(leaves: list[bytes]) -> bytes:
    """The root of leaves in the order given."""
    return fold(_tag(0, _matrix(leaves))).tobytes() if leaves else EMPTY


def merkle_root(hashes: DataFrame, column: str = "doc_hash", height: int = 12, algorithm: str = "blake3") -> bytes:
    """The root over the sorted hashes of a table.

    Ranks come from a two-pass count, blocks of 2**height leaves fold in tasks of their own, the driver folds the
    blocks' roots. All blocks but the last are full; the last is folded as high as they are. Nodes are hashed by
    ``algorithm``: BLAKE3, or SHA-256 where plain SQL is to check them."""
    ranked = row_numbers(hashes.select(col(column).alias("h")), ["h"], "rank").withColumn("block", F.floor(F.col("rank") / (1 << height)))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        leaves = _tag(0, _matrix(frame.sort_values("rank")["h"]), algorithm=algorithm)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "n": [len(frame)], "node": [fold(leaves, height, algorithm).tobytes()], "own": [fold(leaves, algorithm=algorithm).tobytes()]})

    rows = ranked.groupBy("block").applyInPandas(block, "block long, n long, node binary, own binary").orderBy("block").collect()
    if not rows:
        return EMPTY
    return bytes(rows[0].own) if len(rows) == 1 else fold(_matrix(r.node for r in rows), algorithm=algorithm).tobytes()


def merkle_root_frame(hashes: DataFrame, column: str = "doc_hash") -> DataFrame:
    root = merkle_root(hashes, column)
    return hashes.sparkSession.createDataFrame([(root.hex(),)], "root string")
