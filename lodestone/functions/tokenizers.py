"""Tokenizers: a registry of kinds, each made of a configuration, each with an Arrow-batched column function.

Counts and pieces that need no hash stay in the JVM; token ids come from vectorised UDFs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import IntegrityError, MissingDependencyError
from lodestone.functions.arrow import flat, lists, slices
from lodestone.functions.blake3 import blake3, hash_flat
from lodestone.functions.canonical import canonical_json

TOKENS = T.ArrayType(T.IntegerType())
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\f\x0b")] = True


class Tokenizer:
    """A tokenizer has an identifier, a vocabulary size and a configuration from which it can be made again."""

    tokenizer_id: str
    vocab_size: int
    #: Whether ``count`` needs no tokens.
    cheap_count = False
    #: Bytes of text that are encoded at a time (a longer document alone): what encoding takes besides is in proportion.
    slice_bytes = 4 << 20

    def config(self) -> dict:
        raise NotImplementedError

    def config_hash(self) -> bytes:
        return blake3(canonical_json(self.config()).encode())

    def encode_batch(self, contents: list[bytes]) -> list[np.ndarray]:
        raise NotImplementedError

    def encode(self, content: bytes) -> np.ndarray:
        return self.encode_batch([content])[0]

    def decode(self, tokens: np.ndarray) -> bytes:
        raise NotImplementedError(f"{self.tokenizer_id} can't be decoded")

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of contents that lie one after another."""
        ids = self.encode_batch([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def tokens(self, content: Column) -> Column:
        """Token ids of a binary column; null for null."""
        config = self.config()

        @F.arrow_udf(TOKENS)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer = from_config(config)
            for values in batches:
                for part in (values.slice(*x) for x in slices(values, tokenizer.slice_bytes)):
                    yield lists(*tokenizer.encode_flat(*flat(part)), part)

        return run(content.cast("binary"))

    def count(self, content: Column) -> Column:
        """How many tokens a binary column has; only the numbers leave the worker."""
        config = self.config()

        @F.arrow_udf(T.LongType())
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer = from_config(config)
            for values in batches:
                for part in (values.slice(*x) for x in slices(values, tokenizer.slice_bytes)):
                    n = np.diff(tokenizer.encode_flat(*flat(part))[1])
                    yield pa.array(n, pa.int64(), mask=part.is_null().to_numpy(zero_copy_only=False))

        return run(content.cast("binary"))


@dataclass(frozen=True)
class ByteTokenizer(Tokenizer):
    """A token for each byte."""

    tokenizer_id: str = "byte-level-v1"
    vocab_size: int = 256
    cheap_count = True

    def config(self) -> dict:
        return {"id": self.tokenizer_id, "kind": "byte", "vocab_size": self.vocab_size}

    def encode_batch(self, contents: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(c, np.uint8).astype(np.uint32) for c in contents]

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data.astype(np.int32), offsets

    def decode(self, tokens: np.ndarray) -> bytes:
        return np.asarray(tokens, np.uint8).tobytes()

    def count(self, content: Column) -> Column:
        return F.octet_length(content).cast("long")


@dataclass(frozen=True)
class WhitespaceTokenizer(Tokenizer):
    """Runs of ASCII white space and runs of anything else, each hashed into the vocabulary; 0 is never used."""

    vocab_size: int = 65_536
    tokenizer_id: str = "whitespace-hashed-v1"

    def __post_init__(self) -> None:
        if self.vocab_size < 2:
            raise ValueError("the vocabulary has two tokens at least")

    def config(self) -> dict:
        return {"id": self.tokenizer_id, "kind": "whitespace-hashed", "vocab_size": self.vocab_size}

    def encode_batch(self, contents: list[bytes]) -> list[np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
        ids, cuts = self.encode_flat(np.frombuffer(b"".join(contents), np.uint8), offsets)
        return [ids[a:b].astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces begin where white space begins or ends, or a content does; each distinct piece is hashed once."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        blank = _BLANK[data]
        first[1:n] |= blank[1:] != blank[:-1]
        starts = np.flatnonzero(first[:n])
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, n)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        heads = np.ascontiguousarray(hash_flat(*flat(pieces.dictionary))[:, :8]).view("<u8").ravel()
        ids = (heads % np.uint64(self.vocab_size - 1) + np.uint64(1)).astype(np.int32)
        return ids[pieces.indices.to_numpy()], np.searchsorted(starts, offsets)

    def count(self, content: Column) -> Column:
        return F.size(whitespace_pieces(content.cast("string"))).cast("long")


class VocabularyTokenizer(Tokenizer):
    """A tokenizer of the ``tokenizers`` package; special tokens are not added. The package keeps some hundred bytes a token
    until a slice is done, so slices are short, and offsets, which nothing asks for, aren't computed. A task has one core:
    the package's threads, as many as the machine's cores with a heap each, are left out unless the environment says so."""

    slice_bytes = 1 << 17

    def __init__(self, tokenizer_id: str, state: str) -> None:
        try:
            from tokenizers import Tokenizer as Backend
        except ImportError as e:
            raise MissingDependencyError("the package 'tokenizers' isn't installed") from e
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer_id, self.state = tokenizer_id, state
        self.backend = Backend.from_str(state)
        self.vocab_size = self.backend.get_vocab_size(with_added_tokens=True)

    @classmethod
    def from_file(cls, tokenizer_id: str, path: str) -> VocabularyTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(tokenizer_id, f.read())

    def config(self) -> dict:
        return {"id": self.tokenizer_id, "kind": "vocabulary", "vocab_size": self.vocab_size, "state": self.state, "state_hash": blake3(self.state.encode()).hex()}

    def config_hash(self) -> bytes:
        return blake3(canonical_json({k: v for k, v in self.config().items() if k != "state"}).encode())

    def encode_batch(self, contents: list[bytes]) -> list[np.ndarray]:
        encode = getattr(self.backend, "encode_batch_fast", self.backend.encode_batch)
        done = encode([c.decode("utf-8", "replace") for c in contents], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in done]

    def decode(self, tokens: np.ndarray) -> bytes:
        return self.backend.decode([int(t) for t in tokens], skip_special_tokens=False).encode()


_KINDS: dict[str, Callable[[dict], Tokenizer]] = {
    "byte": lambda c: ByteTokenizer(),
    "whitespace-hashed": lambda c: WhitespaceTokenizer(int(c["vocab_size"])),
    "vocabulary": lambda c: VocabularyTokenizer(c["id"], c["state"]),
}


def register(kind: str, make: Callable[[dict], Tokenizer]) -> None:
    """Make configurations of another kind known (on the driver; ``make`` travels to workers by name)."""
    _KINDS[kind] = make


def from_config(config: dict | str) -> Tokenizer:
    config = json.loads(config) if isinstance(config, str) else config
    try:
        make = _KINDS[config["kind"]]
    except KeyError as e:
        raise LookupError(f"unknown kind of tokenizer: {config.get('kind')!r}") from e
    return make(config)


def get(tokenizer_id: str, **settings: int) -> Tokenizer:
    made = {"byte-level-v1": ByteTokenizer, "whitespace-hashed-v1": WhitespaceTokenizer}
    if tokenizer_id not in made:
        raise LookupError(f"unknown tokenizer {tokenizer_id!r}")
    return made[tokenizer_id](**settings)


def whitespace_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([ \t\n\r\f\x0B]+|[^ \t\n\r\f\x0B]+)"), F.lit(1))


def byte_histogram(docs: DataFrame, text: Column) -> DataFrame:
    """(token, n) of the byte tokenizer over all rows, counted in the workers before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for value in batch.column(0).drop_null():
                total += np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["token", "n"])

    return docs.select(text.cast("binary").alias("content")).mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_bits(vocab_size: int) -> int:
    return 16 if vocab_size <= 65_536 else 32


def check_range(tokens: Column, vocab_size: int) -> Column:
    """The tokens; a token that isn't in the vocabulary is an error."""
    bad = (F.array_max(tokens) >= vocab_size) | (F.array_min(tokens) < 0)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"a token isn't below {vocab_size}")).cast(TOKENS)).otherwise(tokens)


def first_hashes(docs: DataFrame, n: int = 4) -> DataFrame:
    """The documents of the n smallest hashes, ascending."""
    return docs.select("doc_hash", "content").orderBy("doc_hash").limit(n)


def digest_of(contents: list[bytes], tokenizer: Tokenizer) -> bytes:
    return blake3(b"".join(ids.astype("<u4").tobytes() for ids in tokenizer.encode_batch(contents)))


def test_vector(docs: DataFrame, tokenizer: Tokenizer) -> dict:
    """Hashes of the documents of the (at most four) smallest hashes, and the digest of their tokens."""
    rows = first_hashes(docs).collect()
    return {"doc_hashes": [bytes(r.doc_hash).hex() for r in rows], "digest": digest_of([bytes(r.content) for r in rows], tokenizer).hex()}


def check_test_vector(docs: DataFrame, vector: dict, tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer still gives those tokens; a document that is missing is an error."""
    wanted = vector["doc_hashes"]
    found = {bytes(r.doc_hash).hex(): bytes(r.content) for r in docs.where(F.col("doc_hash").isin([bytes.fromhex(h) for h in wanted])).select("doc_hash", "content").collect()} if wanted else {}
    if missing := [h for h in wanted if h not in found]:
        raise IntegrityError(f"documents of the test vector are missing: {missing}")
    return digest_of([found[h] for h in wanted], tokenizer).hex() == vector["digest"]


test_vector.__test__ = False
