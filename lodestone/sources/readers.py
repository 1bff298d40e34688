"""Sources of documents. Each returns (content, metadata..., source_ord): an order that doesn't depend on partitions."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import MissingDependencyError
from lodestone.functions.canonical import infer_schema
from lodestone.functions.columns import col


def _placed(df: DataFrame) -> DataFrame:
    """Order by file and place in it. Files that are split keep their order, as a split's rows have rising numbers."""
    return df.withColumn("source_ord", F.monotonically_increasing_id())


def jsonl(spark: SparkSession, path: str, content: str = "text", schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object a line (compressed files too); blank lines are skipped, anything else that isn't JSON is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return _placed(reader.json(path).withColumnRenamed(content, "content"))


def parquet(spark: SparkSession, path: str, content: str = "text", metadata: list[str] | None = None) -> DataFrame:
    """The content column and the metadata columns that exist (all others, if none are named)."""
    df = spark.read.parquet(path)
    names = [c for c in (df.columns if metadata is None else metadata) if c in df.columns and c != content]
    return _placed(df.select(col(content).alias("content"), *(col(c) for c in names)))


def records(spark: SparkSession, rows: Iterable[dict], content: str = "text", metadata: list[str] | str | None = None) -> DataFrame:
    """Dictionaries from any iterable. metadata: names, '*' for all, None for none."""
    rows = list(rows)
    for k, r in enumerate(rows):
        if content not in r:
            raise KeyError(f"record {k} has no {content!r}")
        if not isinstance(r[content], str | bytes):
            raise TypeError(f"{content!r} of record {k} is {type(r[content]).__name__}")
    extra = [{n: v for n, v in r.items() if n != content and (metadata == "*" or n in (metadata or ()))} for r in rows]
    schema = infer_schema(extra)
    fields = T.StructType([T.StructField("content", T.BinaryType()), *schema.fields, T.StructField("source_ord", T.LongType())])
    kinds = {T.LongType(): int, T.DoubleType(): float, T.BooleanType(): bool, T.StringType(): str}
    cast = lambda v, f: None if v is None else v if type(v) is kinds[f.dataType] else kinds[f.dataType](v)
    data = [(bytearray(r[content].encode() if isinstance(r[content], str) else r[content]), *(cast(x.get(f.name), f) for f in schema.fields), k) for k, (r, x) in enumerate(zip(rows, extra, strict=True))]
    return spark.createDataFrame(data, fields)


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            groups: dict[str, dict[str, bytes]] = {}
            with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                for m in tar:
                    if m.isfile():
                        stem, dot, kind = m.name.rpartition(".")
                        groups.setdefault(stem if dot else m.name, {})[kind if dot else ""] = tar.extractfile(m).read()
            out = []
            for k, (stem, parts) in enumerate(groups.items()):
                if "txt" not in parts:
                    continue
                extra: dict[str, object] = {"_stem": stem}
                for kind, data in parts.items():
                    if kind == "txt":
                        continue
                    try:
                        text = data.decode()
                        value = json.loads(text) if kind == "json" else text.strip()
                        extra |= value if kind == "json" and isinstance(value, dict) else {kind: value}
                    except ValueError:
                        extra[f"{kind}_bytes"] = len(data)
                out.append((path, k, parts["txt"], stem, json.dumps(extra, sort_keys=True)))
            yield pd.DataFrame(out, columns=["path", "place", "content", "_stem", "metadata"])


def tar(spark: SparkSession, path: str) -> DataFrame:
    """Archives whose members are grouped by name up to the last dot: '.txt' is the content; the keys of '.json' and the text
    of other members are metadata, a JSON object; what can't be decoded is noted by its length. Groups without content are
    left out. An archive is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(_members, "path string, place long, content binary, _stem string, metadata string")
    return rows.withColumn("source_ord", F.struct("path", "place"))


def streaming_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards of the streaming format of the package 'streaming'."""
    try:
        from streaming import LocalDataset
    except ImportError as e:
        raise MissingDependencyError("reading this format needs the package 'streaming', which isn't installed") from e
    return records(spark, ({**x} for x in LocalDataset(path)), metadata="*")
