import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import blake3 as B
from lodestone.functions import canonical, ed25519
from lodestone.functions.tokenizers import ByteTokenizer, VocabularyTokenizer, WhitespaceTokenizer, check_test_vector, from_config, get, test_vector
from lodestone.operators import merkle, smt

PATTERN = bytes(i % 251 for i in range(102_400))


@pytest.mark.parametrize("n, digest", [(0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"), (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"), (2048, "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"), (3072, "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"), (102_400, "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085")])
def test_known_answers(n, digest):
    assert B.blake3_hex(PATTERN[:n]) == digest


def test_many_at_once_equal_one_by_one():
    rng = np.random.default_rng(0)
    items = [rng.bytes(int(n)) for n in rng.integers(0, 5000, 60)]
    assert B.hash_many(items) == [B.blake3(x) for x in items] and B.hash_many([]) == []


def test_config_hashes():
    assert ByteTokenizer().config_hash().hex() == "af70cbceee873c00b672eca526bbde6cf4f9e49d936178de5d07e715be05108f"
    assert WhitespaceTokenizer(1024).config_hash().hex() == "23fa3a1ca7b09fca6c2f3891c820463ea8a9024fe9ff694d8ac14444d71c5230"


CORPORA = {
    "76c53350d5239fe431e43ba7be2864f5fd1f059aa223bdc1fd89dcfc2ea6dacf": [""],
    "eae739629cf1e18e752c3b1309e0484de575e52c5ba018d179a5170fd39f60bf": ["alpha document text", "beta", "gamma payload here"],
    "c45ddd75e8353b80f6b701c72c158358130947344d7f3fb29f46374be9b78bf1": [f"document-{i:04d}-" + "x" * (i % 32 + 1) for i in range(100)],
}


@pytest.mark.parametrize("root", CORPORA)
@pytest.mark.parametrize("height", [2, 12])
def test_roots_of_known_corpora(spark, root, height):
    hashes = [(bytearray(B.blake3(t.encode())),) for t in CORPORA[root]]
    frame = spark.createDataFrame(hashes, "doc_hash binary")
    assert merkle.merkle_root(frame, height=height).hex() == root
    assert merkle.root_of(sorted(bytes(h) for (h,) in hashes)).hex() == root


def test_counts_of_known_corpora():
    small, big = list(CORPORA.values())[1:]
    assert sum(len(ByteTokenizer().encode(t.encode())) for t in small) == 41
    assert sum(len(x) for x in WhitespaceTokenizer(1024).encode_batch([t.encode() for t in small])) == 11
    assert sum(len(t) for t in big) == 2994


def test_empty_roots(spark):
    none = spark.createDataFrame([], "doc_hash binary")
    assert merkle.merkle_root(none) == merkle.EMPTY and smt.smt_root(none) == smt.EMPTY_ROOT


def test_column_of_hashes(spark):
    frame = spark.createDataFrame([("a",), (None,), ("",)], "t string")
    got = [None if r[0] is None else bytes(r[0]) for r in frame.select(B.content_hash(F.col("t"))).collect()]
    assert got == [B.blake3(b"a"), None, B.blake3(b"")]
    assert bytes(frame.select(B.content_hash(F.col("t"), "sha256")).first()[0]).hex().startswith("ca978112")


def test_tokenizers(spark):
    texts = ["one  two\n", "", None, "é", "x"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for tokenizer in (ByteTokenizer(), WhitespaceTokenizer(50)):
        rows = {r.k: r for r in frame.select("k", tokenizer.tokens(F.col("t")).alias("tokens"), tokenizer.count(F.col("t")).alias("n")).collect()}
        for k, t in enumerate(texts):
            if t is None:
                assert rows[k].tokens is None
            else:
                assert rows[k].tokens == tokenizer.encode(t.encode()).tolist() and rows[k].n == len(rows[k].tokens)
                assert all(0 <= x < tokenizer.vocab_size for x in rows[k].tokens)
        assert from_config(tokenizer.config()) == tokenizer
    assert ByteTokenizer().decode(ByteTokenizer().encode("é".encode())) == "é".encode()
    with pytest.raises(NotImplementedError):
        WhitespaceTokenizer().decode(np.zeros(1))
    with pytest.raises(ValueError):
        WhitespaceTokenizer(1)
    with pytest.raises(LookupError):
        get("nobody")


def test_test_vectors(spark):
    docs = spark.createDataFrame([(bytearray(B.blake3(t)), bytearray(t)) for t in (b"a", b"b c", b"d", b"e", b"f g")], "doc_hash binary, content binary")
    v = test_vector(docs, WhitespaceTokenizer())
    assert len(v["doc_hashes"]) == 4 and v["doc_hashes"] == sorted(v["doc_hashes"])
    assert check_test_vector(docs, v, WhitespaceTokenizer()) and not check_test_vector(docs, v, WhitespaceTokenizer(100))


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary file here")
def test_vocabulary(spark):
    t = VocabularyTokenizer.from_file("bpe", "/opt/tokenizers/byte_bpe_50k.json")
    assert t.decode(t.encode("Hello, wörld".encode())) == "Hello, wörld".encode()
    assert from_config(t.config()).config_hash() == t.config_hash()


def test_signatures():
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = ed25519.public_key(secret)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signed = ed25519.sign(secret, b"")
    assert signed.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert ed25519.verify(public, b"", signed) and not ed25519.verify(public, b"x", signed) and not ed25519.verify(public, b"", signed[:-1] + b"\1")


def test_canonical_values():
    assert canonical.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    assert [f.dataType.simpleString() for f in canonical.infer_schema([{"a": True, "b": 1}, {"b": 1.5, "c": 2.5, "d": None}])] == ["boolean", "bigint", "double", "string"]
    assert [canonical.human_bytes(n) for n in (0, 1023, 1024, 5 << 20)] == ["0 B", "1023 B", "1.00 KiB", "5.00 MiB"]


# sparse trees


def naive_root(keys):
    def node(depth, held):
        if not held:
            return smt.EMPTY[256 - depth]
        if depth == 256:
            return smt.PRESENT
        parts = [[k for k in held if smt.bit(k, depth) == b] for b in (0, 1)]
        return B.blake3(b"\x11" + node(depth + 1, parts[0]) + node(depth + 1, parts[1]))

    return node(0, sorted(set(keys)))


def test_sparse_root_and_proofs(spark):
    keys = [B.blake3(bytes([k])) for k in range(3)]
    frame = spark.createDataFrame([(bytearray(k),) for k in [*keys, keys[0]]], "doc_hash binary")
    root = smt.smt_root(frame)
    assert root == naive_root(keys)
    absent = [B.blake3(b"absent"), bytes(31) + b"\1", keys[0][:-1] + bytes([keys[0][-1] ^ 1])]
    proofs = {p.key: p for p in smt.proofs_for(frame, [keys[0], keys[1], *absent])}
    assert all(proofs[k].present and proofs[k].verify(root) for k in keys[:2])
    assert all(not proofs[k].present and proofs[k].verify(root) for k in absent)
    p = proofs[keys[0]]
    assert not smt.Proof(p.key, False, p.siblings).verify(root)
    assert not smt.Proof(p.key, True, (b"\0" * 32, *p.siblings[1:])).verify(root)
    with pytest.raises(ValueError):
        smt.Proof(p.key, True, p.siblings[:-1]).verify(root)


def test_sparse_trees_fold_as_a_plain_walk_does(spark):
    """Roots and siblings equal those of a tree built node by node; neighbours that part late or early are both there."""
    rng = np.random.default_rng(5)
    keys = [rng.bytes(32) for _ in range(20)]
    keys += [keys[0][:31] + bytes([keys[0][31] ^ 1]), keys[1][:16] + rng.bytes(16), bytes(32), b"\xff" * 32]
    nodes = {int.from_bytes(k): smt.PRESENT for k in keys}
    layers = [nodes]
    for d in range(256):
        up = {p >> 1: B.blake3(b"\x11" + nodes.get(p & ~1, smt.EMPTY[d]) + nodes.get(p | 1, smt.EMPTY[d])) for p in nodes}
        nodes = up
        layers.append(nodes)
    frame = spark.createDataFrame([(bytearray(k),) for k in keys], "doc_hash binary")
    assert smt.smt_root(frame) == nodes[0]
    asked = [keys[0], keys[-3], keys[1][:16] + bytes(16), rng.bytes(32)]
    for p in smt.proofs_for(frame, asked):
        n = int.from_bytes(p.key)
        assert list(p.siblings) == [layers[d].get((n >> d) ^ 1, smt.EMPTY[d]) for d in range(255, -1, -1)]
        assert p.present == (p.key in keys) and p.verify(nodes[0])
    left, right = (np.frombuffer(rng.bytes(32 * 5000), np.uint8).reshape(-1, 32) for _ in range(2))
    assert [x.tobytes() for x in B.hash_pairs(0x11, left, right)] == B.hash_many([b"\x11" + a.tobytes() + b.tobytes() for a, b in zip(left, right, strict=True)])


def test_few_keys_are_few_tasks_and_many_keep_theirs(spark):
    """Partitions follow the number of keys, not the session's setting, and none is merged for being of few bytes."""
    frame = spark.range(3 * smt.TASK_KEYS).selectExpr("unhex(sha2(string(id), 256)) AS doc_hash")
    assert smt.bucket_roots(frame).rdd.getNumPartitions() == 3
    assert smt.bucket_roots(frame.limit(9)).rdd.getNumPartitions() == 1


def test_one_block_of_plain_numbers():
    rng = np.random.default_rng(9)
    items = [rng.bytes(64) for _ in range(50)] + [bytes(64), b"\xff" * 64]
    assert [B.hash_64(x) for x in items] == B.hash_many(items)


def test_one_chain_is_hashed_without_lanes(spark, monkeypatch):
    """A long log of one scope takes no numpy call a step, equals the driver's log, and leaves tasks of few bytes apart."""
    from lodestone.operators import audit

    monkeypatch.setattr(audit, "hash_rows", None)
    log = audit.AuditLog(clock=lambda: 0.0)
    log.extend([("ingestion", {"size": k}) for k in range(300)])
    made = audit._links("s", "blake3")([pa.RecordBatch.from_pydict({"s": ["x"] * n, "seq": list(range(k, k + n)), "timestamp": [0.0] * n, "event_type": ["ingestion"] * n, "payload": [f'{{"size": {j}}}' for j in range(k, k + n)]}) for k, n in ((0, 170), (170, 130))])
    got = [r for b in made for r in b.column("chained_root").to_pylist()]
    assert got == [e.chained_root for e in log.events]
    events = spark.range(40).selectExpr("id % 5 AS s", "id DIV 5 AS seq", "0D AS timestamp", "'ingestion' AS event_type", "'{}' AS payload")
    assert audit.chained(events, "s").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_are_encoded_slice_by_slice(spark, monkeypatch):
    """What a tokenizer is given at once is bounded by bytes, not by the rows of a batch; counts leave the worker as numbers."""
    from lodestone.functions import arrow, canonical

    texts = pa.array([b"ab", None, b"c" * 50, b"", b"d e f"], pa.binary())
    assert list(arrow.slices(texts, 4)) == [(0, 2), (2, 1), (3, 1), (4, 1)]
    assert [x for s in arrow.slices(texts.slice(1), 60) for x in texts.slice(1).slice(*s).to_pylist()] == texts.to_pylist()[1:]
    assert list(arrow.slices(pa.array([[1, 2], [], [3] * 9, None]), 3)) == [(0, 2), (2, 1), (3, 1)]
    assert VocabularyTokenizer.slice_bytes <= 1 << 20
    tokenizer = WhitespaceTokenizer()
    monkeypatch.setattr(WhitespaceTokenizer, "slice_bytes", 4)
    want = [None if t is None else tokenizer.encode(t).tolist() for t in texts.to_pylist()]
    frame = spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in enumerate(texts.to_pylist())], "k int, t binary").coalesce(1)
    generic = super(WhitespaceTokenizer, tokenizer).count(F.col("t"))
    got = frame.select(tokenizer.tokens(F.col("t")).alias("ids"), generic.alias("n"), canonical.lossy_text_exact("t").alias("s")).collect()
    assert [r.ids for r in got] == want and [r.n for r in got] == [None if w is None else len(w) for w in want]
    bad = spark.createDataFrame([(bytearray(b"\xff\xe2\x82a"),), (None,), (bytearray(b"ok"),)], "t binary").coalesce(1)
    assert [r[0] for r in bad.select(canonical.lossy_text_exact("t")).collect()] == [b"\xff\xe2\x82a".decode("utf-8", "replace"), None, "ok"]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary file here")
def test_vocabulary_leaves_out_offsets_and_threads():
    t = VocabularyTokenizer.from_file("bpe", "/opt/tokenizers/byte_bpe_50k.json")
    texts = ["Hello, w\u00f6rld", "", "a  b\n\n c" * 50, "\u65e5\u672c 123"]
    want = [e.ids for e in t.backend.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in t.encode_batch([x.encode() for x in texts])] == want
    assert VocabularyTokenizer.slice_bytes <= 1 << 17 and os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_short_pieces_are_gathered_as_blocks():
    import tracemalloc

    pieces = [bytes([65 + k % 26]) * (k % 90) for k in range(4096)]
    data, offsets = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    tracemalloc.start()
    got = B.hash_flat(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [got[k].tobytes() for k in (0, 1, 63, 64, 65, 89, 4095)] == [B.blake3(pieces[k]) for k in (0, 1, 63, 64, 65, 89, 4095)]
    assert peak < 2_000_000  # positions of single bytes took a megabyte for each 2048 lanes, and as much again at the end of the data
