"""Datasets of several shards: composite roots, exclusions, claims of absence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import ExcludedError
from lodestone.functions.blake3 import hash_many
from lodestone.functions.columns import col
from lodestone.operators.merkle import root_of
from lodestone.operators.smt import EMPTY_ROOT, Proof

LEGACY = frozenset(("0.1.0", "0.2.0"))
CURRENT = "0.3.0"
#: An exclusion list up to this many rows is broadcast (32 bytes each); a longer one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Shard:
    """What a dataset knows of a shard."""

    shard_id: str
    relpath: str
    shard_hash: str
    smt_root: str
    doc_count: int
    tokens: dict[str, int] = field(default_factory=dict)


def shard_hash(manifest_hash: bytes, merkle_root: bytes) -> bytes:
    return hash_many([b"\x20" + manifest_hash + merkle_root])[0]


def shards_root(shards: list[Shard]) -> bytes:
    leaves = hash_many([b"\x21" + s.shard_id.encode() + bytes.fromhex(s.shard_hash) + bytes.fromhex(s.smt_root) for s in sorted(shards, key=lambda s: s.shard_id)])
    return root_of(leaves) if leaves else EMPTY_ROOT


def exclusions_root(exclusions: list[bytes]) -> bytes:
    leaves = hash_many([b"\x22" + h for h in sorted(set(exclusions))])
    return root_of(leaves) if leaves else EMPTY_ROOT


def dataset_root(shards: list[Shard], exclusions: list[bytes], version: str | None = CURRENT) -> bytes:
    """Of the shards alone for old versions (and where none is given), else of shards and exclusions."""
    first = shards_root(shards)
    if (version or "0.1.0") in LEGACY:
        return first
    return hash_many([b"\x42" + first + exclusions_root(exclusions)])[0]


def without(rows: DataFrame, exclusions: DataFrame, key: str = "doc_hash") -> DataFrame:
    """Rows that aren't excluded: an anti-join before anything is decoded."""
    gone = exclusions.select(col(key)).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti")


def with_exclusions(old: DataFrame, new: DataFrame, key: str = "doc_hash") -> DataFrame:
    """The list grows only; what is in it twice counts once."""
    return old.select(col(key)).unionByName(new.select(col(key))).distinct()


def locate(docs: DataFrame, asked: DataFrame, key: str = "doc_hash", shard: str = "shard_ord") -> DataFrame:
    """(key, shard): the first shard that holds each document asked for."""
    return docs.join(asked.select(col(key)).distinct(), key, "left_semi").groupBy(col(key)).agg(F.min(col(shard)).alias(shard))


def claims(docs: DataFrame, shards: DataFrame, asked: DataFrame, exclusions: DataFrame, key: str = "doc_hash", shard: str = "shard_id") -> DataFrame:
    """(key, shard, claim) for every shard: absent, present_but_excluded or present."""
    each = asked.select(col(key)).distinct().crossJoin(F.broadcast(shards.select(col(shard)).distinct()))
    have = docs.join(asked.select(col(key)).distinct(), key, "left_semi").select(col(key), col(shard)).distinct().withColumn("_have", F.lit(True))
    out = exclusions.select(col(key)).distinct().withColumn("_out", F.lit(True))
    met = each.join(have, [key, shard], "left").join(out, key, "left")
    claim = F.when(F.col("_have").isNull(), "absent").when(F.col("_out"), "present_but_excluded").otherwise("present")
    return met.select(col(key), col(shard), claim.alias("claim"))


def absence_proof(doc_hash: bytes, shards: list[Shard], proofs: dict[str, Proof], exclusions: list[bytes], version: str | None = CURRENT) -> dict:
    """A bundle that shows, shard by shard, that a document isn't in the dataset or is excluded from it."""
    excluded = doc_hash in set(exclusions)
    parts = []
    for s in shards:
        p = proofs[s.shard_id]
        if p.present and not excluded:
            raise ExcludedError(f"{doc_hash.hex()} is in shard {s.shard_id} and isn't excluded")
        parts.append({"shard": s.shard_id, "smt_root": s.smt_root, "claim": "present_but_excluded" if p.present else "absent", "siblings": [x.hex() for x in p.siblings]})
    return {"doc_hash": doc_hash.hex(), "dataset_root": dataset_root(shards, exclusions, version).hex(), "shards": parts, "excluded": excluded}


def verify_absence(bundle: dict, shards: list[Shard] | None = None, exclusions: list[bytes] | None = None, pinned: str | None = None, version: str | None = CURRENT) -> bool:
    """Whether a bundle's proofs hold. With the shards, the exclusions and a pinned root it is strict: each proof has to be
    against the root that the dataset commits to, every shard must be there, and the exclusion must be real."""
    key = bytes.fromhex(bundle["doc_hash"])
    try:
        for s in bundle["shards"]:
            present = s["claim"] == "present_but_excluded"
            if s["claim"] not in ("absent", "present_but_excluded") or present and not bundle.get("excluded"):
                return False
            if not Proof(key, present, tuple(bytes.fromhex(x) for x in s["siblings"])).verify(bytes.fromhex(s["smt_root"])):
                return False
    except (ValueError, KeyError):
        return False
    if pinned is None:
        return True
    known = {s.shard_id: s.smt_root for s in shards or []}
    if dataset_root(shards or [], exclusions or [], version).hex() != pinned or {s["shard"]: s["smt_root"] for s in bundle["shards"]} != known:
        return False
    return not any(s["claim"] == "present_but_excluded" for s in bundle["shards"]) or key in set(exclusions or [])
