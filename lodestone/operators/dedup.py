"""Exact duplicates by content hash: the first row in order stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import col, stored


#: Keys of several rows are broadcast up to this many; beyond, the joins shuffle.
BROADCAST_ROWS = 1_000_000


def first_of_each(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of the smallest ``order`` of each key. Only keys travel to find those of several rows; rows whose key is
    theirs alone stay where they are, of the others each task hands on the first of a key (a limit on the rank)."""
    several = stored(docs.groupBy(key.alias("_key")).count().where("count > 1 AND _key IS NOT NULL").select("_key"), "several")
    side = F.broadcast(several) if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else several
    keyed = docs.withColumn("_key", key)
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(col(order)))
    first = keyed.join(side, "_key", "left_semi").withColumn("_nth", nth).where("_nth = 1")
    return keyed.join(side, "_key", "left_anti").select(*(col(c) for c in docs.columns)).unionByName(first.select(*(col(c) for c in docs.columns)))


def survivors(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """The orders that stay, and how many rows share their key."""
    return docs.select(key.alias("_key"), col(order).alias(order)).groupBy("_key").agg(F.min(order).alias(order), F.count("*").alias("copies")).drop("_key")


def group_sizes(docs: DataFrame, key: Column) -> DataFrame:
    """(copies, groups): how many contents occur how often."""
    return docs.groupBy(key.alias("_key")).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("groups"))
