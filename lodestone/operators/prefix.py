"""Running sums over a total order, in two passes, so that no task sees the whole table.

Rows are partitioned by ranges of the order; the sums of the partitions (one row each) are added up and handed back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.columns import col, stored


def _within(value: str):
    """Sums before each row of the task's part, and the number of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(b.schema.get_field_index(value)).cast(pa.int64()).fill_null(0).to_numpy()
            sums = np.cumsum(v)
            names = [*b.schema.names, "_before", "_value", "_part"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + sums - v), pa.array(v), pa.array(np.full(len(v), part, np.int32))], names)
            base += int(sums[-1]) if len(v) else 0

    return run


def _ranges(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    by = [col(c) for c in order]
    return df.repartitionByRange(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)


def _handed_back(ranged: DataFrame, sums: DataFrame, out: str) -> DataFrame:
    """``ranged`` with the sum (``_sum``) of all ranges before its own added to ``_before``."""
    # one row for each range: a window over them is small
    base = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_base"))
    return ranged.join(F.broadcast(base), "_part").withColumn(out, F.col("_before") + F.col("_base")).drop("_part", "_before", "_value", "_base")


def running_sum(df: DataFrame, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before this one (0 for the first). Nulls count as 0. One
    shuffle by ranges, in which the sums within a range are taken; one row a range is then added up and handed back."""
    schema = T.StructType([*df.schema.fields, T.StructField("_before", T.LongType()), T.StructField("_value", T.LongType()), T.StructField("_part", T.IntegerType())])
    ranged = stored(_ranges(df, order, partitions).mapInArrow(_within(value), schema), "ranges")
    return _handed_back(ranged, ranged.groupBy("_part").agg(F.sum("_value").alias("_sum")), out)


def row_numbers(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... in order. A row's place in its range is the lower 33 bits of Spark's own number, so
    rows, which may hold contents, don't pass through Python."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(_ranges(df, order, partitions).withColumns({"_before": place, "_part": F.spark_partition_id()}), "ranges")
    return _handed_back(ranged, ranged.groupBy("_part").agg(F.count("*").alias("_sum")), out)
