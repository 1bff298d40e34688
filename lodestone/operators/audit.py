"""Hash-chained audit logs.

Appending is a fold by nature and runs once for each scope (a shard); verifying looks at neighbours only and is as
parallel as the table. Entry hashes are of canonical JSON, under BLAKE3 or, for checks by plain SQL, SHA-256.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import ed25519
from lodestone.functions.blake3 import hash_64, hash_many, hash_rows
from lodestone.functions.canonical import canonical_json
from lodestone.functions.columns import col

EVENTS = ("ingestion", "exclusion", "version_snapshot", "tokenizer_added")
SCHEMA = "seq long, timestamp double, event_type string, payload string, prev_root string, entry_hash string, chained_root string, signature string"
_ZERO = b"\0" * 32
#: Chains that grow together; fewer are hashed one by one.
LOCKSTEP = 8


def _hashes(items: list[bytes], algorithm: str) -> list[bytes]:
    return hash_many(items) if algorithm == "blake3" else [hashlib.sha256(x).digest() for x in items]


def entry_bytes(seq: int, timestamp: float, event_type: str, payload: dict) -> bytes:
    return canonical_json({"seq": seq, "timestamp": timestamp, "event_type": event_type, "payload": payload}).encode()


@dataclass(frozen=True)
class Event:
    seq: int
    timestamp: float
    event_type: str
    payload: dict
    prev_root: str
    entry_hash: str
    chained_root: str
    signature: str | None = None


class AuditLog:
    """A log on the driver. With a signing key every entry is signed, and all have to be."""

    def __init__(self, events: list[Event] | None = None, root: str = "", public_key: str | None = None, clock: Callable[[], float] = time.time) -> None:
        self.events, self.root, self.public_key, self.clock = list(events or []), root, public_key, clock

    def append(self, event_type: str, payload: dict, secret: bytes | None = None) -> Event:
        return self.extend([(event_type, payload)], secret)[0]

    def extend(self, entries: list[tuple[str, dict]], secret: bytes | None = None) -> list[Event]:
        """Entry hashes of all new entries are computed at once, then chained."""
        if self.events and bool(self.public_key) != bool(secret):
            raise ValueError("a log is signed as a whole or not at all")
        if secret:
            key = ed25519.public_key(secret).hex()
            if self.public_key not in (None, key):
                raise ValueError("the log was signed with another key")
            self.public_key = key
        made = [(len(self.events) + k, float(self.clock()), kind, payload) for k, (kind, payload) in enumerate(entries)]
        for kind, _ in entries:
            if kind not in EVENTS:
                raise ValueError(f"unknown kind of event {kind!r}")
        for (seq, at, kind, payload), h in zip(made, hash_many([entry_bytes(*m) for m in made]), strict=True):
            chained = hash_many([(bytes.fromhex(self.root) if self.root else _ZERO) + h])[0].hex()
            self.events.append(Event(seq, at, kind, payload, self.root, h.hex(), chained, ed25519.sign(secret, h).hex() if secret else None))
            self.root = chained
        return self.events[len(self.events) - len(made) :]

    def verify(self) -> bool:
        signed = [bool(e.signature) for e in self.events]
        if any(signed) != bool(self.public_key and self.events) or any(signed) and not all(signed):
            return False
        before = ""
        hashes = hash_many([entry_bytes(e.seq, e.timestamp, e.event_type, e.payload) for e in self.events])
        for k, (e, h) in enumerate(zip(self.events, hashes, strict=True)):
            chained = hash_many([(bytes.fromhex(before) if before else _ZERO) + h])[0].hex()
            if (e.seq, e.prev_root, e.entry_hash, e.chained_root) != (k, before, h.hex(), chained):
                return False
            if self.public_key and not ed25519.verify(bytes.fromhex(self.public_key), h, bytes.fromhex(e.signature or "")):
                return False
            before = chained
        return before == self.root

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(e.seq, e.timestamp, e.event_type, canonical_json(e.payload), e.prev_root, e.entry_hash, e.chained_root, e.signature) for e in self.events], SCHEMA)

    @classmethod
    def of(cls, frame: DataFrame, root: str, public_key: str | None = None) -> AuditLog:
        rows = frame.orderBy("seq").collect()
        return cls([Event(r.seq, r.timestamp, r.event_type, json.loads(r.payload), r.prev_root, r.entry_hash, r.chained_root, r.signature) for r in rows], root, public_key)

    def tampered(self, k: int, **changes: object) -> AuditLog:
        """A copy in which event k is another: for tests of verification."""
        events = list(self.events)
        events[k] = replace(events[k], **changes)
        return AuditLog(events, self.root, self.public_key, self.clock)


def chain_sha256(events: DataFrame, scope: str, order: str, entry_hash: Column) -> DataFrame:
    """(scope, n, log_root): the chain over SHA-256 entry hashes (hex) of each scope, folded by a SQL aggregate."""
    ordered = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), entry_hash.alias("h"))))
    root = F.aggregate(ordered, F.lit("00" * 32), lambda acc, x: F.sha2(F.unhex(F.concat(acc, x["h"])), 256))
    return events.groupBy(col(scope)).agg(F.count("*").alias("n"), root.alias("log_root"))


def _links(scope: str, algorithm: str):
    """Rows by scope and seq, chained as they stream by. The chains of a batch grow in lockstep: step k hashes the k-th
    entries of all scopes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = object(), _ZERO
        for b in batches:
            if not b.num_rows:
                continue
            scopes = b.column(b.schema.get_field_index(scope)).to_pylist()
            rows = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("seq", "timestamp", "event_type", "payload")), strict=True)
            entries = np.frombuffer(b"".join(_hashes([entry_bytes(int(s), float(t), k, json.loads(p)) for s, t, k, p in rows], algorithm)), np.uint8).reshape(-1, 32)
            cuts = np.array([0, *(k for k in range(1, len(scopes)) if scopes[k] != scopes[k - 1]), len(scopes)])
            before, after = np.zeros((len(scopes), 32), np.uint8), np.empty((len(scopes), 32), np.uint8)
            begun = np.zeros(len(cuts) - 1, bool)
            if scopes[0] == last:
                before[0], begun[0] = np.frombuffer(carried, np.uint8), True
            size = np.diff(cuts)
            for k in range(int(size.max())):
                at = cuts[:-1][size > k] + k
                if k:
                    before[at] = after[at - 1]
                both = np.concatenate([before[at], entries[at]], 1)
                if algorithm == "blake3" and len(at) > LOCKSTEP:
                    after[at] = hash_rows(both)
                else:
                    after[at] = np.frombuffer(b"".join(hash_64(x.tobytes()) if algorithm == "blake3" else hashlib.new(algorithm, x).digest() for x in both), np.uint8).reshape(-1, 32)
            last, carried = scopes[-1], after[-1].tobytes()
            first = np.zeros(len(scopes), bool)
            first[cuts[:-1][~begun]] = True
            prev = ["" if f else x.tobytes().hex() for f, x in zip(first, before, strict=True)]
            columns = [prev, [x.tobytes().hex() for x in entries], [x.tobytes().hex() for x in after]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in columns)], [*b.schema.names, "prev_root", "entry_hash", "chained_root"])

    return run


def chained(events: DataFrame, scope: str, algorithm: str = "blake3") -> DataFrame:
    """``events`` (scope, seq, timestamp, event_type, payload, ...) with prev_root, entry_hash and chained_root. A scope is
    chained by one task, batch by batch; no scope is ever held as a whole. Tasks are as many as the session's partitions:
    chaining takes time, so none are merged for being of few bytes."""
    schema = T.StructType([*events.schema.fields, *(T.StructField(c, T.StringType()) for c in ("prev_root", "entry_hash", "chained_root"))])
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(n, col(scope)).sortWithinPartitions(col(scope), "seq").mapInArrow(_links(scope, algorithm), schema)


def chain(events: DataFrame, scope: str, algorithm: str = "blake3") -> DataFrame:
    """(scope, seq, prev_root, entry_hash, chained_root) from (scope, seq, timestamp, event_type, payload)."""
    return chained(events, scope, algorithm).select(col(scope), "seq", "prev_root", "entry_hash", "chained_root")


@F.pandas_udf(T.StringType())
def _entry_hash(seq: pd.Series, timestamp: pd.Series, kind: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([h.hex() for h in hash_many([entry_bytes(int(s), float(t), k, json.loads(p)) for s, t, k, p in zip(seq, timestamp, kind, payload, strict=True)])], dtype=object)


@F.pandas_udf(T.StringType())
def _chained(before: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([h.hex() for h in hash_many([(bytes.fromhex(b) if b else _ZERO) + bytes.fromhex(e) for b, e in zip(before, entry, strict=True)])], dtype=object)


def broken_links(log: DataFrame, scope: str) -> DataFrame:
    """Rows of a log table that don't follow from the row before, or whose hashes aren't their own."""
    w = Window.partitionBy(col(scope)).orderBy("seq")
    linked = log.withColumn("_n", F.row_number().over(w) - 1).withColumn("_before", F.coalesce(F.lag("chained_root").over(w), F.lit("")))
    checked = linked.withColumn("_entry", _entry_hash("seq", "timestamp", "event_type", "payload")).withColumn("_chained", _chained("_before", "_entry"))
    return checked.where("seq != _n OR prev_root != _before OR entry_hash != _entry OR chained_root != _chained").drop("_n", "_before", "_entry", "_chained")
