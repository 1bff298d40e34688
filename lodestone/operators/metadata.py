"""Metadata columns: statistics by zone, distributions, names in exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import col

SAMPLE = 32


def zone_stats(df: DataFrame, order: str, columns: list[str], rows: int = 1024) -> DataFrame:
    """(column, zone, min, max, null_count, sample) of every ``rows`` rows in order: min and max as text, the sample the
    first 32 distinct values."""
    zone = F.floor(col(order) / rows).alias("zone")
    out = None
    for c in columns:
        values = F.sort_array(F.collect_set(col(c)))
        one = df.groupBy(zone).agg(F.min(col(c)).cast("string").alias("min"), F.max(col(c)).cast("string").alias("max"), F.count_if(col(c).isNull()).alias("null_count"), F.transform(F.slice(values, 1, SAMPLE), lambda v: v.cast("string")).alias("sample"))
        one = one.select(F.lit(c).alias("column"), "zone", "min", "max", "null_count", "sample")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no columns")
    return out


def distribution(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """(value, n); nulls aren't counted."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias(name or column)).agg(F.count("*").alias("n"))


def export_names(columns: list[str], reserved: list[str]) -> dict[str, str]:
    """How metadata columns are called beside the reserved ones: in alphabetical order each takes the first free name of
    its own, meta_ and its own, meta_ twice, ..."""
    taken, out = set(reserved), {}
    for c in sorted(columns):
        name = c
        while name in taken:
            name = f"meta_{name}"
        taken.add(name)
        out[c] = name
    return out


def renamed(df: DataFrame, reserved: list[str]) -> DataFrame:
    """``df`` with its columns under their export names."""
    return df.withColumnsRenamed({a: b for a, b in export_names(df.columns, reserved).items() if a != b})
