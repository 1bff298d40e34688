"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import col, forget, shared_dir, ship, stored

__all__ = ["col", "forget", "fresh", "log", "partitions", "shared_dir", "ship", "stored", "text_key", "trimmed"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash (in any letter case) with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text in joins."""
    return [F.xxhash64(text), F.xxhash64(F.lit("lodestone"), text)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back what it freed: workers live on through the stages that follow, and several
    stand beside each other where one step reads from another."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def log(*what: object) -> None:
    if os.environ.get("LODESTONE_VERBOSE"):
        print(*what, file=sys.stderr, flush=True)
