"""Arrow columns of bytes as flat numpy arrays, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a binary or string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if column.buffers()[2] is None else np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of about ``most`` bytes of a binary or string column, or values of a column of lists; a longer
    row is a slice of its own."""
    kind = column.type
    if pa.types.is_list(kind):
        offsets = column.offsets.to_numpy()
    else:
        wide = pa.types.is_large_binary(kind) or pa.types.is_large_string(kind)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at, n = 0, len(column)
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most, "right")) - 1))
        yield at, end - at
        at = end


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets of n + 1) of a column of lists; null counts as empty."""
    n = np.diff(column.offsets.to_numpy())
    if column.null_count:
        n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, n)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def _missing(column: pa.Array) -> np.ndarray | None:
    return column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None


def lists(values: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    """A column of lists, null where ``like`` is."""
    missing = _missing(like)
    bounds = pa.array(offsets.astype(np.int32), mask=None if missing is None else np.append(missing, False))
    return pa.ListArray.from_arrays(bounds, pa.array(values))


def fixed(rows: np.ndarray, like: pa.Array) -> pa.Array:
    """A binary column of the rows of an n x m matrix of bytes, null where ``like`` is."""
    n, m = rows.shape
    missing = _missing(like)
    valid = None if missing is None else pa.array(~missing).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer((np.arange(n + 1) * m).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
