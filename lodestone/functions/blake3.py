"""BLAKE3 (unkeyed, 256 bits), written from its published specification for many inputs at once.

All 1,024-byte chunks of all inputs are lanes of numpy arrays; the chaining values of each input are then merged
level by level. A batch of documents costs a few thousand numpy calls however many rows it has.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.arrow import fixed, flat

_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_SHUFFLE = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_LANES = 2048
#: Row n keeps the first n bytes of a block.
_KEPT = np.where(np.arange(64) < np.arange(65)[:, None], 255, 0).astype(np.uint8)


#: Message words of the four columns, then the four diagonals, of each round: first and second of each.
_ORDERS = [list(range(16))]
for _ in range(6):
    _ORDERS.append([_ORDERS[-1][k] for k in _SHUFFLE])
_PICKS = [([o[0:8:2], o[1:8:2]], [o[8::2], o[9::2]]) for o in _ORDERS]
_ROLLS = [np.roll(np.arange(4), -k) for k in range(4)]


def _turn(x: np.ndarray, n: int, spare: np.ndarray) -> None:
    np.right_shift(x, np.uint32(n), out=spare)
    np.left_shift(x, np.uint32(32 - n), out=x)
    np.bitwise_or(x, spare, out=x)


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray, spare: np.ndarray) -> None:
    """Four columns (or diagonals) of the state at once, in place."""
    for word, first, second in ((x, 16, 12), (y, 8, 7)):
        a += b
        a += word
        d ^= a
        _turn(d, first, spare)
        c += d
        b ^= c
        _turn(b, second, spare)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8 x n) of n lanes: cv 8 x n, words 16 x n."""
    n = cv.shape[1]
    a, b = cv[:4].copy(), cv[4:].copy()
    c = np.repeat(_IV[:4, None], n, 1)
    d = np.empty((4, n), np.uint32)
    d[0], d[1], d[2], d[3] = counter & 0xFFFFFFFF, counter >> 32, size, flags
    spare = np.empty((4, n), np.uint32)
    for columns, diagonals in _PICKS:
        _mix(a, b, c, d, words[columns[0]], words[columns[1]], spare)
        b, c, d = b[_ROLLS[1]], c[_ROLLS[2]], d[_ROLLS[3]]
        _mix(a, b, c, d, words[diagonals[0]], words[diagonals[1]], spare)
        b, c, d = b[_ROLLS[3]], c[_ROLLS[2]], d[_ROLLS[1]]
    return np.concatenate([a ^ c, b ^ d])


def _straight() -> str:
    """Source of a function that compresses one block of plain numbers, without loops."""
    state, lines = [f"v{k}" for k in range(16)], []
    for o in _ORDERS:
        for k, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            for word, first, second in ((o[2 * k], 16, 12), (o[2 * k + 1], 8, 7)):
                lines += [f"v{a} = v{a} + v{b} + m{word} & M", f"v{d} ^= v{a}", f"v{d} = (v{d} >> {first} | v{d} << {32 - first}) & M", f"v{c} = v{c} + v{d} & M", f"v{b} ^= v{c}", f"v{b} = (v{b} >> {second} | v{b} << {32 - second}) & M"]
    begin = [", ".join(f"m{k}" for k in range(16)) + " = words", "M = 0xFFFFFFFF", ", ".join(state) + f" = {', '.join(str(int(x)) for x in [*_IV, *_IV[:4]])}, 0, 0, 64, {_START | _END | _ROOT}"]
    return "def one_block(words):\n    " + "\n    ".join([*begin, *lines, "return " + ", ".join(f"v{k} ^ v{k + 8}" for k in range(8))])


_made: dict = {}
exec(_straight(), _made)  # noqa: S102
_WORDS = struct.Struct("<16I"), struct.Struct("<8I")


def hash_64(data: bytes) -> bytes:
    """The hash of 64 bytes, for chains: where there is nothing to do beside it, plain numbers take a tenth of numpy's time."""
    return _WORDS[1].pack(*_made["one_block"](_WORDS[0].unpack(data)))


def hash_pairs(tag: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """n x 32: the hash of a byte and two values of 32 bytes, for n of them: a full block and one byte."""
    n = len(left)
    out = np.empty((n, 32), np.uint8)
    for low in range(0, n, _LANES):
        part = slice(low, low + _LANES)
        m = len(left[part])
        block = np.empty((m, 64), np.uint8)
        block[:, 0], block[:, 1:33], block[:, 33:] = tag, left[part], right[part, :31]
        last = np.zeros((16, m), np.uint32)
        last[0] = right[part, 31]
        cv = _compress(np.repeat(_IV[:, None], m, 1), np.ascontiguousarray(block.view("<u4").T), np.int64(0), np.int64(64), np.int64(_START))
        cv = _compress(cv, last, np.int64(0), np.int64(1), np.int64(_END | _ROOT))
        out[part] = np.ascontiguousarray(cv.T.astype("<u4")).view(np.uint8).reshape(m, 32)
    return out


def _chunks(data: np.ndarray, start: np.ndarray, size: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (n x 8) of chunks; those that are all of their input are finished."""
    out = np.empty((len(start), 8), np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(64, np.uint8)]), 64)
    for low in range(0, len(start), _LANES):
        part = slice(low, low + _LANES)
        s, n, c, one = start[part], size[part], counter[part], alone[part]
        blocks = np.maximum(1, -(-n // 64))
        cv = np.repeat(_IV[:, None], len(s), 1)
        for k in range(int(blocks.max())):
            on = np.flatnonzero(blocks > k)
            left = np.minimum(64, n[on] - 64 * k)
            block = windows[s[on] + 64 * k]
            if (left < 64).any():
                block &= _KEPT[left]
            last = blocks[on] == k + 1
            flags = np.where(k == 0, _START, 0) | np.where(last, _END, 0) | np.where(last & one[on], _ROOT, 0)
            words = np.ascontiguousarray(block.view("<u4").T)
            cv[:, on] = _compress(cv[:, on], words, c[on], left, flags)
        out[part] = cv.T
    return out


def hash_flat(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x 32 bytes: the hash of each of n inputs that lie one after another."""
    offsets = np.asarray(offsets, np.int64)
    n = len(offsets) - 1
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // 1024))
    owner = np.repeat(np.arange(n), count)
    counter = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + 1024 * counter
    cv = _chunks(np.asarray(data, np.uint8), start, np.minimum(1024, offsets[owner + 1] - start), counter, count[owner] == 1)
    while len(cv) > n:
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        nodes = np.bincount(owner, minlength=n)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < nodes[owner]))
        words = np.ascontiguousarray(np.concatenate([cv[left], cv[left + 1]], 1).T)
        merged = np.empty((len(left), 8), np.uint32)
        for low in range(0, len(left), _LANES):
            w = words[:, low : low + _LANES]
            lanes = w.shape[1]
            flags = np.where(nodes[owner[left[low : low + _LANES]]] == 2, _PARENT | _ROOT, _PARENT)
            merged[low : low + _LANES] = _compress(np.repeat(_IV[:, None], lanes, 1), w, np.zeros(lanes, np.int64), np.full(lanes, 64), flags).T
        cv[left] = merged
        keep = place % 2 == 0
        cv, owner = cv[keep], owner[keep]
    return np.ascontiguousarray(cv.astype("<u4")).view(np.uint8).reshape(n, 32)


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """n x 32: the hash of each row of an n x m matrix of bytes."""
    n, m = rows.shape
    return hash_flat(np.ascontiguousarray(rows).reshape(-1), np.arange(n + 1) * m)


def hash_many(items: Iterable[bytes]) -> list[bytes]:
    items = list(items)
    if not items:
        return []
    out = hash_flat(np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items])]))
    return [x.tobytes() for x in out]


def blake3(data: bytes) -> bytes:
    return hash_many([data])[0]


def blake3_hex(data: bytes) -> str:
    return blake3(data).hex()


@F.arrow_udf(T.BinaryType())
def _hash_udf(values: pa.Array) -> pa.Array:
    return fixed(hash_flat(*flat(values)), values)


def content_hash(content: Column, algorithm: str = "blake3") -> Column:
    """32 bytes of a binary or string column; null stays null. ``sha256`` stays in the JVM."""
    if algorithm == "blake3":
        return _hash_udf(content.cast("binary"))
    if algorithm == "sha256":
        return F.unhex(F.sha2(content.cast("binary"), 256))
    raise ValueError(f"unknown algorithm {algorithm!r}")
