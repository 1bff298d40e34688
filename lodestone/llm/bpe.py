"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct pre-tokens of a partition are laid out as one array of symbols. An index maps each pair that can merge
to all its positions in the partition. The least active rank is applied to all its positions at once; the neighbours
of what merged enter the lists of their new pairs, stale entries are recognised when their rank comes up. Ranks may
become active in any order (a heap holds them), so the result is that of merging each pre-token by itself.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from lodestone.llm import _flat
from lodestone.llm._common import col, ship

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text whose pre-tokens share one index; a partition of more is encoded in several.
PARTITION = 1 << 25
#: Positions that enter the index at a time.
BLOCK = 1 << 20


@dataclass(eq=False)
class Vocabulary:
    """pairs: sorted codes left * size + right of all pairs that merge; ranks: the token that each becomes."""

    tokens: list[bytes]
    pairs: np.ndarray
    ranks: np.ndarray
    byte_ids: np.ndarray
    pattern: str = PATTERN

    @property
    def size(self) -> int:
        return len(self.tokens)


def vocabulary(lines: Iterator[bytes] | list[bytes], pattern: str = PATTERN) -> Vocabulary:
    """From lines of 'base64 rank'. A pair merges if its bytes together are a token; its rank is the token's."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    found = [(ranks[t[:k]] * len(tokens) + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    codes = np.array(sorted(found), np.int64).reshape(-1, 2)
    byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
    if (byte_ids < 0).any():
        raise ValueError("a byte has no token")
    return Vocabulary(tokens, codes[:, 0].copy(), codes[:, 1].copy(), byte_ids, pattern)


@cache
def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    with open(path, "rb") as f:
        return vocabulary(f.readlines(), pattern)


def _rank(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of each pair, or -1."""
    code = left.astype(np.int64) * v.size + right
    if not len(v.pairs):
        return np.full(len(code), -1)
    at = np.minimum(np.searchsorted(v.pairs, code), len(v.pairs) - 1)
    return np.where(v.pairs[at] == code, v.ranks[at], -1)


def merge(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of byte strings laid out one after another."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    # positions and symbols take four bytes each: the index of a partition is the largest thing in a worker
    at = np.int32 if n < 1 << 31 else np.int64
    sym = v.byte_ids[data].astype(np.int32)
    nxt, prv = np.arange(1, n + 1, dtype=at), np.arange(-1, n - 1, dtype=at)
    full = offsets[:-1] < offsets[1:]
    nxt[offsets[1:][full] - 1] = -1
    prv[offsets[:-1][full]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(where: np.ndarray, ranks: np.ndarray) -> None:
        some = ranks >= 0
        where, ranks = where[some].astype(at, copy=False), ranks[some]
        if not len(where):
            return
        order = np.argsort(ranks, kind="stable")
        where, ranks = where[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        lows = [0, *cuts.tolist()]
        for low, high, r in zip(lows, [*lows[1:], len(ranks)], ranks[lows].tolist(), strict=True):
            if r in index:
                index[r].append(where[low:high])
            else:
                index[r] = [where[low:high]]
                heapq.heappush(heap, r)

    for low in range(0, n, BLOCK):
        first = np.flatnonzero(nxt[low : low + BLOCK] >= 0) + low
        enter(first, _rank(v, sym[first], sym[first + 1]))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        p = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        p = p[alive[p] & (nxt[p] >= 0)]
        if len(p) > 1 and len(lists) > 1:
            p = p[np.concatenate([[True], p[1:] != p[:-1]])]
        q = nxt[p]
        ok = _rank(v, sym[p], sym[q]) == r  # else the pair has changed since it was entered
        p, q = p[ok], q[ok]
        if not len(p):
            continue
        if len(p) > 1:
            chained = np.isin(q, p, assume_unique=True)
            if chained.any():  # runs of one symbol: from the left, no two may overlap
                taken: set[int] = set()
                use = []
                for a, b in zip(p.tolist(), q.tolist(), strict=True):
                    if a not in taken:
                        use.append(a)
                        taken.add(b)
                p = np.array(use, at)
                q = nxt[p]
        sym[p] = r
        alive[q] = False
        after = nxt[q]
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        left = before[before >= 0]
        right = p[has]
        if len(left) or len(right):
            where = np.concatenate([left, right])
            enter(where, _rank(v, sym[where], sym[nxt[where]]))
    counts = np.concatenate([[0], np.cumsum(alive)])
    return sym[alive], counts[offsets]


def decode(tokens: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of token lists laid out one after another."""
    table = np.frombuffer(b"".join(v.tokens), np.uint8)
    ends = np.cumsum([len(t) for t in v.tokens])
    size = np.diff(np.concatenate([[0], ends]))
    n = size[tokens]
    stops = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(ends[tokens] - size[tokens] - stops[:-1], n) + np.arange(stops[-1])
    return table[at], stops[offsets]


def _gather(codes: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of words in sequence, and the bounds of each word in them."""
    n = offsets[codes + 1] - offsets[codes]
    stops = np.concatenate([[0], np.cumsum(n)])
    return tokens[np.repeat(offsets[codes] - stops[:-1], n) + np.arange(stops[-1])], stops


class _Numbers(dict):
    """Numbers of pre-tokens, in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, texts: pa.Array, find) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pre-tokens of all texts, bounds of each text in them): a text at a time."""
        codes = []
        for text in texts.to_pylist():
            found = find(text or "")
            codes.append(np.fromiter(map(self.__getitem__, found), np.int32, len(found)))
        return np.concatenate([np.zeros(0, np.int32), *codes]), np.concatenate([[0], np.cumsum([len(c) for c in codes], dtype=np.int64)])


class _Partition:
    """Pre-tokens of the rows gathered so far."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.find = v, regex.compile(v.pattern).findall
        self.words = _Numbers()
        self.parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append((part, *self.words.of(part.column("text"), self.find)))
        self.size += part.column("text").nbytes

    def encode(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        tokens, offsets = merge(*_flat.flat(pa.array(self.words, pa.large_string())), self.v)
        for part, codes, cuts in self.parts:
            flat, stops = _gather(codes, tokens, offsets)
            yield part, flat, stops[cuts]
        self.words, self.parts, self.size = _Numbers(), [], 0


class Counter:
    """Numbers of tokens without the tokens, from another encoder of the same ranks where it gives the same (``reachable``).
    Its matcher gives up on very long runs of blanks: texts that have one are encoded here."""

    def __init__(self, v: Vocabulary, same: bool) -> None:
        self.v, self.find = v, regex.compile(v.pattern).findall
        self.blanks = regex.compile(r"\s{512}").search
        ranks = {t: r for r, t in enumerate(v.tokens) if t}
        self.other = tiktoken.Encoding("other", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if same else None

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; 0 for null."""
        return np.fromiter((self._count(t) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))

    def _count(self, text: str) -> int:
        if self.other and not self.blanks(text):
            return len(self.other(text))
        words = _Numbers()
        codes, _ = words.of(pa.array([text], pa.large_string()), self.find)
        _, offsets = merge(*_flat.flat(pa.array(words, pa.large_string())), self.v)
        return int(np.diff(offsets)[codes].sum())


@cache
def reachable(v: Vocabulary) -> bool:
    """Whether merges make every token of its own bytes, in the pattern of this module. Other encoders look a pre-token up
    as a whole first, which is the same only then; other patterns may mean different things to them."""
    ranks = {t: r for r, t in enumerate(v.tokens) if t}
    none = len(v.tokens)
    for token in ranks:
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            best = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            k = best.index(min(best))
            if best[k] == none:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return v.pattern == PATTERN


def _encode(v: Vocabulary, partition: int):
    def rows(gathered: _Partition) -> Iterator[pa.RecordBatch]:
        for part, tokens, offsets in gathered.encode():
            data, bounds = decode(tokens, offsets, v)
            there, ends = _flat.flat(part.column("text"))
            same = np.diff(bounds) == np.diff(ends)
            if len(data) == len(there) and same.all():
                wrong = np.flatnonzero(data != there)
                same[np.searchsorted(ends, wrong, "right") - 1] = False
            else:
                same = np.array([data[a:b].tobytes() == there[c:d].tobytes() for a, b, c, d in zip(bounds, bounds[1:], ends, ends[1:], strict=False)])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))
            missing = part.column("text").is_null().to_numpy(zero_copy_only=False)
            if missing.any():
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(missing, False)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(np.diff(offsets)), pa.array(same)], ["doc_id", "tokens", "n_tokens", "round_trip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Partition(v)
        for whole in batches:
            for part in _flat.slices(whole, "text", _flat.BLOCK):
                gathered.add(part)
                if gathered.size >= partition:
                    yield from rows(gathered)
        if gathered.parts:
            yield from rows(gathered)

    return run


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", partition: int = PARTITION) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) for every row; round_trip says that decoding gives back the text's bytes.

    A null text has null tokens, 0 of them; the empty text has none. A null id is passed on, repeated rows are encoded each.
    A text of any length is encoded whole, one longer than ``partition`` by an index of its own. An empty table gives no
    rows. Other columns are ignored, whatever their names. Ids are cast to long, what can't be is an error."""
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(v, partition), "doc_id long, tokens array<int>, n_tokens long, round_trip boolean")


def _decode(v: Vocabulary, id_name: str, tokens_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                lists = part.column(tokens_name)
                missing = lists.is_null()
                flat = lists.fill_null([]) if lists.null_count else lists
                ids = flat.flatten().to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(np.diff(flat.offsets.to_numpy()))])
                data, bounds = decode(ids, offsets, v)
                texts = [None if m else data[a:b].tobytes().decode("utf-8", "replace") for m, a, b in zip(missing.to_pylist(), bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(id_name), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_tokens(encoded: DataFrame, v: Vocabulary, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) of token lists; bytes that aren't UTF-8 become U+FFFD, null tokens a null text."""
    ship(encoded.sparkSession)
    rows = encoded.select(col(id_col).cast("long").alias("doc_id"), col(tokens_col).cast("array<int>").alias("tokens"))
    return rows.mapInArrow(_decode(v, "doc_id", "tokens"), "doc_id long, text string")
