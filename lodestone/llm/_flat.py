"""Whole Arrow string columns as flat byte arrays: words, hashes and counts without a Python loop per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21  # bytes that are widened to 64 bits at a time
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Lead bytes of scripts written without blanks: each of their characters counts as a word.
_SOLO = np.zeros(256, bool)
_SOLO[0xE3:0xEE] = True


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = powers(BLOCK + 1, _P), powers(BLOCK + 1, _PINV)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = flat(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of two bytes."""
    out = _FOLD[data]
    if len(data) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 32
    return out


def spans(inside: np.ndarray, offsets: np.ndarray, solo: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; none crosses a row, and each ``solo`` byte starts another."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if solo is not None:
        cut[:-1] |= solo
    cut[0] = cut[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = inside & (~before | cut[:-1])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = inside & (~after | cut[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (ascending, not overlapping), by a polynomial over prefix sums."""
    out = np.zeros(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + BLOCK, "right"))
        if to <= at:  # one range is longer than a block: fold it block by block
            total, shift = np.uint64(0), np.uint64(1)
            for k in range(low, int(ends[at]), BLOCK):
                part = data[k : min(k + BLOCK, int(ends[at]))].astype(np.uint64) + np.uint64(1)
                with np.errstate(over="ignore"):
                    total = total + shift * np.sum(part * _UP[: len(part)], dtype=np.uint64)
                    shift = shift * np.uint64(pow(int(_P), len(part), 1 << 64))
            out[at] = total
            at += 1
            continue
        high = int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _UP[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * _DOWN[s]
        at = to
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words: runs of letters, digits and bytes beyond ASCII."""
    starts, ends = spans(_WORD[data], offsets, _SOLO[data])
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def segments(row: np.ndarray, n: int) -> np.ndarray:
    """Bounds (n + 1) of each row's items in an array that is sorted by row."""
    return np.searchsorted(row, np.arange(n + 1))


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: float) -> np.ndarray:
    """``ufunc.reduceat`` for rows some of which have no items."""
    n = len(bounds) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full], axis=0)
    return out
