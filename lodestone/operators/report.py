"""Statistics, comparison and compliance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import col
from lodestone.operators.metadata import distribution


def summary(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(section, value, n): the number of documents, and of each value of some columns; one scan with grouping sets."""
    sets = [[], *([c] for c in columns)]
    total = docs.groupingSets([[col(c) for c in s] for s in sets], *(col(c) for c in columns)).agg(F.count("*").alias("n"), *(F.grouping(col(c)).alias(f"_g{k}") for k, c in enumerate(columns)))
    section, value = F.lit("documents"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        section = F.when(F.col(f"_g{k}") == 0, F.lit(c)).otherwise(section)
        value = F.when(F.col(f"_g{k}") == 0, col(c).cast("string")).otherwise(value)
    return total.select(section.alias("section"), value.alias("value"), "n").where("section = 'documents' OR value IS NOT NULL")


def diff(a: DataFrame, b: DataFrame, key: str = "doc_hash") -> DataFrame:
    """(shared, only_a, only_b): one pass over both sides instead of three set operations."""
    both = a.select(col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


def differing(a: DataFrame, b: DataFrame, key: str = "doc_hash", n: int = 10) -> DataFrame:
    """(key, side): the first n keys that one side only has."""
    left = a.select(col(key)).subtract(b.select(col(key))).withColumn("side", F.lit("a"))
    right = b.select(col(key)).subtract(a.select(col(key))).withColumn("side", F.lit("b"))
    return left.unionByName(right).orderBy(col(key), "side").limit(n)


def sizes(docs: DataFrame, views: DataFrame, content: str = "content") -> DataFrame:
    """(documents, bytes, mean_bytes, tokens, bytes_a_token) over documents and one row of totals for each view."""
    d = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length(col(content))), F.lit(0)).cast("long").alias("bytes"))
    t = views.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"))
    return d.crossJoin(t).select("documents", "bytes", F.try_divide("bytes", "documents").alias("mean_bytes"), "tokens", F.try_divide("bytes", "tokens").alias("bytes_a_token"))


def ratio(stored_bytes: int, source_bytes: int) -> float:
    """Bytes stored for each byte of source."""
    return stored_bytes / source_bytes if source_bytes else 0.0


__all__ = ["diff", "differing", "distribution", "ratio", "sizes", "summary"]
