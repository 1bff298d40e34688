"""Values that are hashed or shown: canonical JSON, types of metadata, sizes."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, ASCII only: the form in which values are hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonicalise(text: pd.Series) -> pd.Series:
    """JSON text in canonical form."""
    return text.map(lambda s: canonical_json(json.loads(s)), na_action="ignore")


_TYPES = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}


def infer_type(value: object) -> T.DataType:
    """bool, then int, then float; anything else (null too) is a string."""
    return _TYPES.get(type(value), T.StringType())


def infer_schema(records: Iterable[dict], declared: dict[str, T.DataType] | None = None) -> T.StructType:
    """A column has the type of the first value seen under its name, unless declared; columns in the order of appearance."""
    kinds: dict[str, T.DataType] = dict(declared or {})
    for record in records:
        for name, value in record.items():
            kinds.setdefault(name, infer_type(value))
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if abs(n) < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TiB"


def hex_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def lossy_text(content: Column) -> Column:
    """Bytes as text, what isn't UTF-8 as U+FFFD; in the JVM."""
    return F.make_valid_utf8(content.cast("string"))


@F.arrow_udf(T.StringType())
def lossy_text_exact(content: pa.Array) -> pa.Array:
    """The same with as many U+FFFD as Python's decoder gives. A column that is UTF-8 is taken as it is."""
    try:
        return content.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.as_buffer().to_pybytes().decode("utf-8", "replace") if b.is_valid else None for b in content], pa.string())
