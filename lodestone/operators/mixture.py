"""Subsets and weighted, reproducible mixtures of them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.columns import col, stored
from lodestone.operators.prefix import row_numbers
from lodestone.plans.predicate import compile_filter, parse


@dataclass(frozen=True)
class Subset:
    """A predicate with a name and a weight; the predicate is read at once."""

    name: str
    predicate: str
    default_weight: float = 1.0

    def __post_init__(self) -> None:
        parse(self.predicate)


def weights(subsets: list[Subset], override: dict[str, float] | None = None) -> dict[str, float]:
    """Shares that add up to one, in the subsets' order."""
    if not subsets:
        raise ValueError("a mixture has at least one subset")
    raw = {s.name: (override or {}).get(s.name, s.default_weight) for s in subsets}
    total = sum(raw.values())
    if total <= 0:
        raise ValueError("the weights must add up to more than 0")
    return {name: w / total for name, w in raw.items()}


def members(docs: DataFrame, subsets: list[Subset], order: str = "doc_ord") -> DataFrame:
    """(subset, order): one row for each subset that a document belongs to. All predicates are tested in one scan."""
    tests = [F.when(compile_filter(s.predicate, docs.schema), F.lit(s.name)) for s in {s.name: s for s in subsets}.values()]
    return docs.select(col(order), F.explode(F.array_compact(F.array(*tests))).alias("subset"))


def blake2b_draw(seed: int) -> tuple[Column, Column]:
    """(r in [0, 1), pick): halves of the 128-bit blake2b hash of step and seed."""

    @F.pandas_udf(T.StructType([T.StructField("r", T.DoubleType()), T.StructField("pick", T.DecimalType(20, 0))]))
    def draw(steps: pd.Series) -> pd.DataFrame:
        from decimal import Decimal

        tail = seed.to_bytes(8, "little")
        digests = [hashlib.blake2b(int(s).to_bytes(8, "little") + tail, digest_size=16).digest() for s in steps]
        return pd.DataFrame({"r": [int.from_bytes(d[:8], "little") / 2**64 for d in digests], "pick": [Decimal(int.from_bytes(d[8:], "little")) for d in digests]})

    both = draw(F.col("step"))
    return both["r"], both["pick"]


def sha256_draw(seed: int) -> tuple[Column, Column]:
    """The same from SHA-256 of 'step:seed', in the JVM: r has 32 bits, pick 56."""
    digest = F.sha2(F.concat_ws(":", F.col("step").cast("string"), F.lit(str(seed))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0, F.conv(F.substring(digest, 9, 14), 16, 10).cast("decimal(20,0)")


def sample(docs: DataFrame, subsets: list[Subset], n: int, seed: int = 0, override: dict[str, float] | None = None, order: str = "doc_ord", draw: str = "blake2b") -> DataFrame:
    """(step, subset, order): n draws of a subset by weight and of a member of it, with replacement.

    A step whose subset is empty gives no row. The choice of a subset compares with the few cumulative shares, the
    choice of a member is an equi-join on (subset, number), so nothing depends on how the table is partitioned."""
    spark = docs.sparkSession
    share = weights(subsets, override)
    numbered = stored(row_numbers(members(docs, subsets, order), ["subset", order], "_rank"), "members")
    sizes = numbered.groupBy("subset").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    r, pick = blake2b_draw(seed) if draw == "blake2b" else sha256_draw(seed)
    name, total, cumulative = None, 0.0, []
    for s, w in share.items():
        total += w
        cumulative.append((s, total))
    for s, c in reversed(cumulative):
        name = F.lit(s) if name is None else F.when(F.col("_r") <= c, F.lit(s)).otherwise(name)
    steps = spark.range(n).select(F.col("id").alias("step")).withColumn("_r", r).withColumn("_pick", pick).withColumn("subset", name)
    met = steps.join(F.broadcast(sizes), "subset").withColumn("_rank", (F.col("_first") + F.expr("_pick % _n")).cast("long"))
    return met.join(numbered.select("_rank", col(order)), "_rank").select("step", "subset", col(order))
