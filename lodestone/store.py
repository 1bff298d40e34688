"""Corpora and datasets as tables: Parquet directories and a manifest that is written last.

A corpus (one shard) has ``documents`` (order, hash, content, metadata), ``tokens`` (a partition for each tokenizer) and
``audit``. A dataset has corpora under ``shards`` and a growing list of exclusions.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import DuplicateViewError, ExcludedError, IntegrityError, ShardChangedError, UnsupportedVersionError
from lodestone.functions.blake3 import blake3, content_hash, hash_flat
from lodestone.functions.canonical import canonical_json, hex_of
from lodestone.functions.arrow import fixed, flat, list_values
from lodestone.functions.columns import bounded, col, scratch, stored, written
from lodestone.functions.tokenizers import TOKENS, Tokenizer, check_range, check_test_vector, from_config, test_vector, token_bits
from lodestone.operators import audit, loader, overlay, report, smt, views
from lodestone.operators.dedup import first_of_each
from lodestone.operators.merkle import merkle_root
from lodestone.operators.mixture import Subset
from lodestone.operators.prefix import row_numbers
from lodestone.plans.predicate import where
from lodestone.sources import files

FORMAT, READABLE = [1, 4], (1, 2, 3, 4)
#: Documents whose log entries make one chain; chains are as many tasks as the cluster has room for.
AUDIT_BLOCK = 1024
_OWN = ("doc_ord", "doc_hash", "content", "content_size")


def ingest(rows: DataFrame, order: str = "source_ord", content: str = "content", algorithm: str = "blake3") -> DataFrame:
    """(doc_ord, doc_hash, content, content_size, metadata...): the first row of each content, numbered in order. The
    metadata of later copies are dropped with them; null contents are an error."""
    hashed = stored(rows.withColumn("_hash", content_hash(col(content), algorithm)).withColumn(content, col(content).cast("binary")), "hashed")
    if not hashed.where("_hash IS NULL").isEmpty():
        raise ValueError("a document has no content")
    first = first_of_each(hashed, F.col("_hash"), order)
    numbered = row_numbers(first, [order], "doc_ord")
    metadata = [c for c in rows.columns if c not in (order, content)]
    if clash := {c.lower() for c in metadata} & {*_OWN}:
        raise ValueError(f"names of metadata that are taken: {sorted(clash)}")
    return numbered.select("doc_ord", F.col("_hash").alias("doc_hash"), col(content).alias("content"), F.octet_length(col(content)).cast("long").alias("content_size"), *(col(c) for c in metadata))


def tokenize(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_ord, doc_hash, token_count, token_offset, tokens): a view, in order within each task; documents without tokens
    are left out."""
    if tokenizer.cheap_count:  # contents go through the running sum, a quarter of their tokens at most; tokens follow in the step that writes
        counted = docs.select("doc_ord", "doc_hash", "content", tokenizer.count(F.col("content")).alias("token_count"))
        placed = views.source_map(counted, ["doc_ord"])
        return placed.select("doc_ord", "doc_hash", "token_count", "token_offset", check_range(tokenizer.tokens(F.col("content")), tokenizer.vocab_size).alias("tokens"))
    # encoded once: ranges are sampled and rows without tokens filtered, each of which would encode again
    tokens = stored(docs.select("doc_ord", "doc_hash", check_range(tokenizer.tokens(F.col("content")), tokenizer.vocab_size).alias("tokens")), "encoded")
    return views.source_map(tokens.withColumn("token_count", F.size("tokens").cast("long")), ["doc_ord"])


def _hashed_chunks(size: int, kind: str):
    """Pieces (at, tokens) of a stream to (chunk_id, at, n, chunk_hash, piece): chunks that a task sees whole are hashed where
    they are, of the others the bytes are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in loader.joined(size, 1 << 20)(batches):
            values, bounds = list_values(b.column("tokens"))
            data, n, bounds = values.astype(kind).view(np.uint8), np.diff(bounds), bounds * np.dtype(kind).itemsize
            whole = np.flatnonzero(b.column("whole").to_numpy(zero_copy_only=False))
            hashes: list[bytes | None] = [None] * b.num_rows
            if len(whole):  # only the first piece and the last may not be
                low, high = whole[0], whole[-1] + 1
                hashes[low:high] = [x.tobytes() for x in hash_flat(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])]
            pieces = [data[bounds[k] : bounds[k + 1]].tobytes() if h is None else None for k, h in enumerate(hashes)]
            columns = [b.column("out_batch"), b.column("at"), pa.array(n), pa.array(hashes, pa.binary()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "at", "n", "chunk_hash", "piece"])

    return run


@F.arrow_udf(T.BinaryType())
def _hash_of_pieces(pieces: pa.Array) -> pa.Array:
    data, offsets = flat(pieces.flatten())
    return fixed(hash_flat(data, offsets[np.concatenate([[0], np.cumsum(np.diff(pieces.offsets.to_numpy()))])]), pieces)


def chunk_records(view: DataFrame, vocab_size: int, size: int = views.CHUNK) -> DataFrame:
    """(chunk_id, num_tokens, bits, chunk_hash) of a view: the stream in chunks of ``size`` tokens, each hashed as unsigned
    numbers of ``bits`` bits, least byte first. Chunks are hashed by the tasks that read them; none is ever a row of tokens.
    Only what lies at the ends of a task's run is shuffled, as bytes."""
    bits = token_bits(vocab_size)
    made = stored(view.select(F.col("token_offset").alias("at"), "tokens").mapInArrow(_hashed_chunks(size, "<u2" if bits == 16 else "<u4"), "chunk_id long, at long, n long, chunk_hash binary, piece binary"), "chunks")
    whole = made.where("piece IS NULL").select("chunk_id", F.col("n").alias("num_tokens"), "chunk_hash")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    edges = made.where("piece IS NOT NULL").groupBy("chunk_id").agg(F.sum("n").alias("num_tokens"), parts.alias("pieces"))
    both = whole.unionByName(edges.select("chunk_id", "num_tokens", _hash_of_pieces("pieces").alias("chunk_hash")))
    return both.select("chunk_id", "num_tokens", F.lit(bits).alias("bits"), "chunk_hash")


class Corpus:
    """One shard. ``create`` makes it, ``Corpus(spark, path)`` opens it."""

    def __init__(self, spark: SparkSession, path: str, verify: str = "fast") -> None:
        """verify: 'none', 'fast' (counts, views' test vectors) or 'full' (everything is hashed again)."""
        bounded(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = files.read_json(spark, f"{self.path}/manifest.json")
        major, minor = self.manifest["format"]
        if major != FORMAT[0] or minor not in READABLE or self.manifest.get("flags", 0):
            raise UnsupportedVersionError(f"format {major}.{minor}")
        if verify != "none" and (bad := [r for r in self.checks(verify == "full") if not r[1]]):
            raise IntegrityError(f"{bad[0][0]}: {bad[0][2]}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, tokenizers: list[Tokenizer] | None = None, subsets: list[Subset] | None = None, order: str = "source_ord", clock: Callable[[], float] | None = None, snapshot_id: str | None = None, secret: bytes | None = None) -> Corpus:
        """``clock`` and ``snapshot_id`` make the result reproducible; where they aren't given, the environment's
        LODESTONE_TIME (seconds) and LODESTONE_SNAPSHOT_ID do."""
        fixed = os.environ.get("LODESTONE_TIME")
        clock = clock or (time.time if fixed is None else lambda: float(fixed))
        snapshot_id = snapshot_id or os.environ.get("LODESTONE_SNAPSHOT_ID")
        path = path.rstrip("/")
        with scratch():
            written(ingest(rows, order), f"{path}/documents")
            docs = spark.read.parquet(f"{path}/documents")
            ids = [t.tokenizer_id for t in tokenizers or []]
            if len(set(ids)) < len(ids):
                raise DuplicateViewError(f"twice the same tokenizer: {ids}")
            made = [cls._write_view(path, docs, t) for t in tokenizers or []]
            count = docs.count()
            roots = {"merkle_root": merkle_root(docs).hex(), "smt_root": smt.smt_root(docs).hex()}
        log = audit.AuditLog(clock=clock)
        # one entry for each document in a table of its own, chained in blocks; the root of their ends is an entry of the log
        at = clock()
        payload = F.to_json(F.struct(hex_of(F.col("doc_hash")).alias("doc_hash"), F.col("content_size").alias("size")))
        events = docs.select(F.floor(F.col("doc_ord") / AUDIT_BLOCK).alias("scope"), F.pmod("doc_ord", F.lit(AUDIT_BLOCK)).alias("seq"), F.lit(float(at)).alias("timestamp"), F.lit("ingestion").alias("event_type"), payload.alias("payload"))
        written(audit.chained(events, "scope"), f"{path}/audit")
        with scratch():
            log_root = cls._log_root(spark.read.parquet(f"{path}/audit"))
        entries = [("ingestion", {"documents": count, "log_root": log_root}), *(("tokenizer_added", {"tokenizer_id": v["tokenizer_id"], "total_tokens": v["total_tokens"]}) for v in made)]
        snapshot = snapshot_id or uuid.uuid4().hex
        log.extend([*entries, ("version_snapshot", {"snapshot_id": snapshot, **roots})], secret)
        manifest = {"format": FORMAT, "flags": 0, "snapshot_id": snapshot, "created_at": at, "documents": count, **roots, "views": made, "subsets": [vars(s) for s in subsets or []]}
        cls._commit(spark, path, manifest, log)
        return cls(spark, path, verify="none")

    @staticmethod
    def _log_root(log: DataFrame) -> str:
        """The Merkle root over the last links of all blocks."""
        ends = log.groupBy("scope").agg(F.max_by("chained_root", "seq").alias("end"))
        return merkle_root(ends.select(F.unhex("end").alias("end")), "end").hex()

    @staticmethod
    def _write_view(path: str, docs: DataFrame, tokenizer: Tokenizer) -> dict:
        target = f"{path}/tokens/tokenizer_id={tokenizer.tokenizer_id}"
        written(tokenize(docs, tokenizer), target)
        view = docs.sparkSession.read.parquet(target)
        written(chunk_records(view, tokenizer.vocab_size), f"{path}/chunks/tokenizer_id={tokenizer.tokenizer_id}")
        total = views.total(docs.sparkSession.read.parquet(target)).first()[0]
        return {"tokenizer_id": tokenizer.tokenizer_id, "vocab_size": tokenizer.vocab_size, "config": canonical_json(tokenizer.config()), "config_hash": tokenizer.config_hash().hex(), "total_tokens": total, "test_vector": test_vector(docs, tokenizer)}

    @staticmethod
    def _commit(spark: SparkSession, path: str, manifest: dict, log: audit.AuditLog) -> None:
        manifest["audit"] = {"root": log.root, "public_key": log.public_key, "events": [vars(e) for e in log.events]}
        files.write_json(spark, f"{path}/manifest.json", manifest)

    # reading

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def metadata(self) -> DataFrame:
        return self.documents().drop("content", "content_size")

    def filter(self, predicate: str | Callable[[dict], bool]) -> DataFrame:
        """The documents for which a predicate holds; the scan takes what it can of it. A function sees the metadata of each
        document as a dictionary."""
        docs = self.documents()
        return where(docs, predicate, [c for c in docs.columns if c not in _OWN] if callable(predicate) else None)

    def get(self, doc_hash: bytes) -> bytes:
        row = self.documents().where(F.col("doc_hash") == F.lit(bytearray(doc_hash))).select("content", "content_size").first()
        if row is None:
            raise KeyError(doc_hash.hex())
        if len(row.content) != row.content_size or blake3(bytes(row.content)) != doc_hash:
            raise IntegrityError(f"the content of {doc_hash.hex()} is another")
        return bytes(row.content)

    def has(self, doc_hash: bytes) -> bool:
        return not self.documents().where(F.col("doc_hash") == F.lit(bytearray(doc_hash))).limit(1).isEmpty()

    def views(self) -> list[str]:
        return sorted(v["tokenizer_id"] for v in self.manifest["views"])

    def view(self, tokenizer_id: str) -> DataFrame:
        if tokenizer_id not in self.views():
            raise KeyError(tokenizer_id)
        return self.spark.read.parquet(f"{self.path}/tokens/tokenizer_id={tokenizer_id}")

    def stream(self, tokenizer_id: str, size: int = 1024) -> DataFrame:
        return views.token_batches(self.view(tokenizer_id), size)

    def subsets(self) -> list[Subset]:
        return [Subset(**s) for s in self.manifest["subsets"]]

    def audit_log(self) -> audit.AuditLog:
        a = self.manifest["audit"]
        return audit.AuditLog([audit.Event(**e) for e in a["events"]], a["root"], a["public_key"])

    def merkle_root(self) -> bytes:
        return bytes.fromhex(self.manifest["merkle_root"])

    def smt_root(self) -> bytes:
        return bytes.fromhex(self.manifest["smt_root"])

    def prove(self, keys: list[bytes]) -> list[smt.Proof]:
        """Of presence or absence, for many keys in one job."""
        return smt.proofs_for(self.documents(), keys)

    # changing

    def add_view(self, tokenizer: Tokenizer, clock: Callable[[], float] = time.time, secret: bytes | None = None) -> Corpus:
        """Documents aren't touched; the new manifest is committed when the view is there."""
        if tokenizer.tokenizer_id in self.views():
            raise DuplicateViewError(tokenizer.tokenizer_id)
        with scratch():
            made = self._write_view(self.path, self.documents(), tokenizer)
        log = self.audit_log()
        log.clock = clock
        log.extend([("tokenizer_added", {"tokenizer_id": tokenizer.tokenizer_id, "total_tokens": made["total_tokens"]})], secret)
        manifest = {**self.manifest, "views": [*self.manifest["views"], made]}
        self._commit(self.spark, self.path, manifest, log)
        return Corpus(self.spark, self.path, verify="none")

    def add_subset(self, subset: Subset) -> Corpus:
        self._commit(self.spark, self.path, {**self.manifest, "subsets": [*self.manifest["subsets"], vars(subset)]}, self.audit_log())
        return Corpus(self.spark, self.path, verify="none")

    # checking

    def checks(self, full: bool = True) -> list[tuple[str, bool, str]]:
        docs, m = self.documents(), self.manifest
        out = [("document_count", docs.count() == m["documents"], str(m["documents"])), ("audit_log", self.audit_log().verify(), m["audit"]["root"])]
        for v in m["views"]:
            name, view = v["tokenizer_id"], self.view(v["tokenizer_id"])
            total = views.total(view).first()[0]
            out.append((f"tokens of {name}", total == v["total_tokens"], f"{total} of {v['total_tokens']}"))
            try:
                tokenizer = from_config(v["config"])
            except LookupError:
                continue  # a tokenizer that isn't known here can't be checked
            out.append((f"configuration of {name}", tokenizer.config_hash().hex() == v["config_hash"], v["config_hash"]))
            out.append((f"test vector of {name}", check_test_vector(docs, v["test_vector"], tokenizer), v["test_vector"]["digest"]))
            if full:
                kept = self.spark.read.parquet(f"{self.path}/chunks/tokenizer_id={name}")
                made = chunk_records(view, v["vocab_size"])
                wrong = kept.exceptAll(made).unionByName(made.exceptAll(kept))
                out.append((f"chunks of {name}", wrong.isEmpty(), "hash, size and width of each"))
                out.append((f"range of {name}", view.where(~views.in_range(F.col("tokens"), v["vocab_size"]) | (F.size("tokens") != F.col("token_count"))).isEmpty(), str(v["vocab_size"])))
                out.append((f"offsets of {name}", views.gaps(view.select("token_offset", "token_count")).isEmpty(), "contiguous"))
        if full:
            out.append(("content hashes", docs.where(content_hash(F.col("content")) != F.col("doc_hash")).isEmpty(), "all"))
            out.append(("distinct documents", docs.select("doc_hash").distinct().count() == m["documents"], "all"))
            out.append(("merkle root", merkle_root(docs).hex() == m["merkle_root"], m["merkle_root"]))
            out.append(("smt root", smt.smt_root(docs).hex() == m["smt_root"], m["smt_root"]))
            log, first = self.spark.read.parquet(f"{self.path}/audit"), next((e for e in self.audit_log().events if e.event_type == "ingestion"), None)
            out.append(("audit chain", audit.broken_links(log, "scope").isEmpty(), "documents"))
            out.append(("audit root", first is not None and self._log_root(log) == first.payload["log_root"], "documents"))
        return out

    def verify(self, full: bool = True) -> DataFrame:
        return self.spark.createDataFrame(self.checks(full), "check string, ok boolean, detail string")

    def inspect(self) -> DataFrame:
        m = self.manifest
        rows = [("format", ".".join(map(str, m["format"]))), ("snapshot_id", m["snapshot_id"]), ("documents", str(m["documents"])), ("merkle_root", m["merkle_root"]), ("smt_root", m["smt_root"]), ("audit_root", m["audit"]["root"]), *((f"view {v['tokenizer_id']}", str(v["total_tokens"])) for v in m["views"]), *((f"subset {s['name']}", s["predicate"]) for s in m["subsets"])]
        return self.spark.createDataFrame(rows, "item string, value string")

    def stats(self) -> DataFrame:
        """(region, bytes): what the parts take on disk, and the whole."""
        parts = [("documents", files.length(self.spark, f"{self.path}/documents")), ("audit", files.length(self.spark, f"{self.path}/audit")), *((f"view {v}", files.length(self.spark, f"{self.path}/tokens/tokenizer_id={v}")) for v in self.views()), ("manifest", files.length(self.spark, f"{self.path}/manifest.json"))]
        return self.spark.createDataFrame([*parts, ("total", sum(n for _, n in parts))], "region string, bytes long")

    def summary(self, columns: list[str]) -> DataFrame:
        """(section, value, n): the documents, the distributions of some columns, the tokens of each view, and the root."""
        m, spark = self.manifest, self.spark
        more = [*(("tokens", v["tokenizer_id"], v["total_tokens"]) for v in m["views"]), ("smt_root", m["smt_root"], None)]
        return report.summary(self.documents(), columns).unionByName(spark.createDataFrame(more, "section string, value string, n long"))

    def manifest_hash(self) -> bytes:
        return blake3(canonical_json(self.manifest).encode())

    def compliance(self, expected_smt_root: str | None = None, present: bytes | None = None, absent: bytes = b"\xab" * 32) -> list[dict]:
        """Receipts: the pinned root, a proof of presence, one of absence, and the log; each says whether it is verified."""
        out = []
        if expected_smt_root is not None:
            out.append({"type": "published_root", "verified": expected_smt_root.lower() == self.smt_root().hex()})
        if present is None:
            first = self.documents().orderBy("doc_ord").select("doc_hash").first()
            present = bytes(first[0]) if first else None
        proofs = self.prove([k for k in (present, absent) if k is not None])
        by = {p.key: p for p in proofs}
        if present is None:
            out.append({"type": "inclusion", "skipped": True, "verified": True})
        else:
            out.append({"type": "inclusion", "doc_hash": present.hex(), "verified": by[present].present and by[present].verify(self.smt_root())})
        out.append({"type": "non_inclusion", "doc_hash": absent.hex(), "verified": not by[absent].present and by[absent].verify(self.smt_root())})
        log = self.audit_log()
        out.append({"type": "audit_log", "entries": len(log.events), "signed": bool(log.public_key), "verified": bool(log.events) and log.verify()})
        return out


class Dataset:
    """Shards and exclusions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if files.exists(spark, f"{self.path}/dataset.json"):
            self.manifest = files.read_json(spark, f"{self.path}/dataset.json")
        elif files.exists(spark, f"{self.path}/manifest.json"):  # a corpus is a dataset of one shard
            self.manifest = {"version": overlay.CURRENT, "shards": [vars(self._entry("shard", "."))], "exclusions": []}
        else:
            raise FileNotFoundError(path)
        bad = [h for h in self.manifest["exclusions"] if len(h) != 64 or any(c not in "0123456789abcdef" for c in h)]
        if bad:
            raise IntegrityError(f"not a hash: {bad[0]!r}")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Dataset:
        """A new dataset, or the one that is there."""
        path = path.rstrip("/")
        if not files.exists(spark, f"{path}/dataset.json"):
            files.write_json(spark, f"{path}/dataset.json", {"version": overlay.CURRENT, "shards": [], "exclusions": []})
        return cls(spark, path)

    def _save(self) -> None:
        files.write_json(self.spark, f"{self.path}/dataset.json", self.manifest)

    def _entry(self, shard_id: str, relpath: str) -> overlay.Shard:
        c = Corpus(self.spark, f"{self.path}/{relpath}", verify="none")
        return overlay.Shard(shard_id, relpath, overlay.shard_hash(c.manifest_hash(), c.merkle_root()).hex(), c.smt_root().hex(), c.manifest["documents"], {v["tokenizer_id"]: v["total_tokens"] for v in c.manifest["views"]})

    def shard_path(self, shard_id: str) -> str:
        return f"{self.path}/shards/{shard_id}"

    def register(self, shard_id: str) -> None:
        """Twice the same is fine; a shard that has changed is an error."""
        entry = vars(self._entry(shard_id, f"shards/{shard_id}"))
        for s in self.manifest["shards"]:
            if s["shard_id"] == shard_id:
                if s != entry:
                    raise ShardChangedError(shard_id)
                return
        self.manifest["shards"].append(entry)
        self._save()

    def exclude(self, doc_hash: bytes, reason: str = "") -> None:
        self.exclude_all([doc_hash], reason)

    def exclude_all(self, doc_hashes: list[bytes], reason: str = "") -> None:
        """Many exclusions are one change of the manifest."""
        if any(len(h) != 32 for h in doc_hashes):
            raise ValueError("a hash has 32 bytes")
        known = set(self.manifest["exclusions"])
        new = {h.hex() for h in doc_hashes} - known
        if new:
            self.manifest["exclusions"] = sorted(known | new)
            self.manifest.setdefault("reasons", {}).update(dict.fromkeys(new, reason))
            self._save()

    def shards(self) -> list[overlay.Shard]:
        return [overlay.Shard(**s) for s in self.manifest["shards"]]

    def exclusions(self) -> list[bytes]:
        return [bytes.fromhex(h) for h in self.manifest["exclusions"]]

    def is_excluded(self, doc_hash: bytes) -> bool:
        return doc_hash.hex() in self.manifest["exclusions"]

    def corpus(self, shard_id: str, verify: str = "none") -> Corpus:
        (entry,) = (s for s in self.shards() if s.shard_id == shard_id)
        return Corpus(self.spark, f"{self.path}/{entry.relpath}", verify)

    def _excluded_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(h),) for h in self.exclusions()], "doc_hash binary")

    def _union(self, frames: list[DataFrame]) -> DataFrame | None:
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    def documents(self, overlay_applied: bool = True) -> DataFrame:
        """The union of the shards (copies in several shards stay), with shard_id and shard_ord."""
        frames = [self.corpus(s.shard_id).documents().withColumn("shard_id", F.lit(s.shard_id)).withColumn("shard_ord", F.lit(k)) for k, s in enumerate(self.shards())]
        all_docs = self._union(frames)
        if all_docs is None:
            raise LookupError("the dataset has no shards")
        return overlay.without(all_docs, self._excluded_frame()) if overlay_applied else all_docs

    def view(self, tokenizer_id: str) -> DataFrame:
        """Shards that have the view; excluded documents are left out before their tokens are read."""
        frames = [self.corpus(s.shard_id).view(tokenizer_id).withColumn("shard_id", F.lit(s.shard_id)).withColumn("shard_ord", F.lit(k)) for k, s in enumerate(self.shards()) if tokenizer_id in s.tokens]
        out = self._union(frames)
        if out is None:
            schema = f"doc_ord long, doc_hash binary, tokens {TOKENS.simpleString()}, token_count long, token_offset long, shard_id string, shard_ord int"
            return self.spark.createDataFrame([], schema)
        return overlay.without(out, self._excluded_frame())

    def stream(self, tokenizer_id: str, size: int = 1024) -> DataFrame:
        return views.token_batches(self.view(tokenizer_id), size)

    def root(self) -> bytes:
        return overlay.dataset_root(self.shards(), self.exclusions(), self.manifest.get("version"))

    def smt_roots(self) -> DataFrame:
        return self.spark.createDataFrame([(s.shard_id, s.smt_root) for s in self.shards()], "shard_id string, smt_root string")

    def prove_inclusion(self, doc_hash: bytes) -> tuple[str, smt.Proof]:
        for s in self.shards():
            (proof,) = self.corpus(s.shard_id).prove([doc_hash])
            if proof.present:
                if self.is_excluded(doc_hash):
                    raise ExcludedError(f"{doc_hash.hex()} is excluded from the dataset")
                return s.shard_id, proof
        raise KeyError(f"{doc_hash.hex()} is in no shard")

    def prove_absence(self, doc_hash: bytes) -> dict:
        proofs = {s.shard_id: self.corpus(s.shard_id).prove([doc_hash])[0] for s in self.shards()}
        return overlay.absence_proof(doc_hash, self.shards(), proofs, self.exclusions(), self.manifest.get("version"))

    def verify_absence(self, bundle: dict, pinned: str | None = None) -> bool:
        return overlay.verify_absence(bundle, self.shards(), self.exclusions(), pinned, self.manifest.get("version"))

    def verify_roots(self) -> DataFrame:
        """(shard_id, ok): whether the shards are still those that were registered."""
        rows = [(s.shard_id, vars(self._entry(s.shard_id, s.relpath)) == vars(s)) for s in self.shards()]
        return self.spark.createDataFrame(rows, "shard_id string, ok boolean")
