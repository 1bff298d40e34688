import io
import json
import tarfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.errors import DuplicateViewError, ExcludedError, IntegrityError, MissingDependencyError, OutOfSyncError, ShardChangedError, UnsupportedVersionError
from lodestone.functions import columns, ed25519
from lodestone.functions.blake3 import blake3
from lodestone.functions.tokenizers import ByteTokenizer, WhitespaceTokenizer
from lodestone.operators import audit, loader, metadata, mixture, overlay, prefix, report, views
from lodestone.operators.mixture import Subset
from lodestone.sources import files, readers, sinks
from lodestone.store import Corpus, Dataset, tokenize

RECORDS = [{"text": "hello", "lang": "en", "n": 1}, {"text": "hello", "lang": "fr", "n": 2}, {"text": "", "lang": None, "n": 3}, {"text": "three short words", "lang": "fr", "n": 4}]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = readers.records(spark, RECORDS, metadata="*")
    return Corpus.create(spark, str(tmp_path_factory.mktemp("c") / "corpus"), rows, [ByteTokenizer()], [Subset("fr", "lang = 'fr'", 0.5)], clock=lambda: 1.0, snapshot_id="s", secret=bytes(32))


def test_the_first_copy_stays_with_its_metadata(corpus):
    rows = corpus.documents().orderBy("doc_ord").collect()
    assert [(r.doc_ord, bytes(r.content), r.content_size, r.lang, r.n) for r in rows] == [(0, b"hello", 5, "en", 1), (1, b"", 0, None, 3), (2, b"three short words", 17, "fr", 4)]
    assert corpus.get(blake3(b"hello")) == b"hello" and corpus.has(blake3(b"")) and not corpus.has(blake3(b"no"))
    with pytest.raises(KeyError):
        corpus.get(blake3(b"no"))


def test_views_and_checks(spark, corpus):
    view = corpus.view("byte-level-v1").orderBy("doc_ord").collect()
    assert [(r.doc_ord, r.token_offset, r.token_count) for r in view] == [(0, 0, 5), (2, 5, 17)]
    assert all(r.ok for r in corpus.verify().collect())
    with pytest.raises(DuplicateViewError):
        corpus.add_view(ByteTokenizer())
    more = corpus.add_view(WhitespaceTokenizer(), secret=bytes(32))
    assert more.views() == ["byte-level-v1", "whitespace-hashed-v1"]
    assert [r.token_count for r in more.view("whitespace-hashed-v1").orderBy("doc_ord").collect()] == [1, 5]
    assert Corpus(spark, corpus.path, "full").audit_log().verify()
    with pytest.raises(ValueError):
        more.audit_log().append("exclusion", {})  # unsigned on a signed log
    assert [r.n for r in corpus.filter("lang = 'fr'").collect()] == [4] and more.subsets()[0].name == "fr"
    sizes = [r.n for r in corpus.stream("byte-level-v1", 4).orderBy("doc_ord", "batch").collect()]
    assert sizes == [4, 1, 4, 4, 4, 4, 1]
    assert more.inspect().count() >= 8 and more.stats().where("region = 'total' AND bytes > 0").count() == 1


def test_receipts(corpus):
    assert all(r["verified"] for r in corpus.compliance(corpus.smt_root().hex()))
    assert not corpus.compliance("00" * 32)[0]["verified"]


def test_tampering_is_seen(spark, tmp_path):
    made = Corpus.create(spark, f"{tmp_path}/c", readers.records(spark, RECORDS[2:]), [ByteTokenizer()])
    m = files.read_json(spark, f"{made.path}/manifest.json")
    for change in ({"documents": 9}, {"audit": {**m["audit"], "root": "00" * 32}}, {"views": [{**m["views"][0], "total_tokens": 1}]}, {"views": [{**m["views"][0], "test_vector": {**m["views"][0]["test_vector"], "digest": "00"}}]}):
        files.write_json(spark, f"{made.path}/manifest.json", {**m, **change})
        with pytest.raises(IntegrityError):
            Corpus(spark, made.path)
        Corpus(spark, made.path, "none")
    files.write_json(spark, f"{made.path}/manifest.json", {**m, "smt_root": "00" * 32})
    with pytest.raises(IntegrityError):
        Corpus(spark, made.path, "full")
    files.write_json(spark, f"{made.path}/manifest.json", {**m, "format": [1, 9]})
    with pytest.raises(UnsupportedVersionError):
        Corpus(spark, made.path)


def test_an_empty_corpus(spark, tmp_path):
    made = Corpus.create(spark, f"{tmp_path}/c", spark.createDataFrame([], "content binary, source_ord long"), [ByteTokenizer()])
    assert all(r.ok for r in made.verify().collect()) and all(r["verified"] for r in made.compliance())


def test_datasets(spark, tmp_path):
    data = Dataset.create(spark, f"{tmp_path}/d")
    assert data.root() == overlay.dataset_root([], [])
    for name, texts in (("a", ["one", "two"]), ("b", ["two", "three"])):
        Corpus.create(spark, data.shard_path(name), readers.records(spark, [{"text": t} for t in texts]), [ByteTokenizer()])
        data.register(name)
        data.register(name)  # again: nothing
    assert len(data.shards()) == 2 and Dataset(spark, f"{tmp_path}/d").documents().count() == 4
    shard, proof = data.prove_inclusion(blake3(b"two"))
    assert shard == "a" and proof.verify(data.corpus("a").smt_root())
    before = data.root()
    with pytest.raises(ExcludedError):
        data.prove_absence(blake3(b"two"))
    data.exclude(blake3(b"two"), "asked for")
    data.exclude(blake3(b"two"))
    assert data.root() != before and len(data.exclusions()) == 1
    assert data.view("byte-level-v1").agg(F.sum("token_count")).first()[0] == 8 and data.view("none").count() == 0
    with pytest.raises(ExcludedError):
        data.prove_inclusion(blake3(b"two"))
    pinned = data.root().hex()
    for text, claims in ((b"two", ["present_but_excluded"] * 2), (b"four", ["absent"] * 2)):
        bundle = data.prove_absence(blake3(text))
        assert [s["claim"] for s in bundle["shards"]] == claims
        assert data.verify_absence(bundle) and data.verify_absence(bundle, pinned)
        assert not data.verify_absence({**bundle, "shards": bundle["shards"][:1]}, pinned) and data.verify_absence({**bundle, "shards": []})
        assert not data.verify_absence({**bundle, "doc_hash": blake3(b"three").hex()})
        assert not data.verify_absence(bundle, "00" * 32)
    Corpus(spark, data.shard_path("a"), "none").add_view(WhitespaceTokenizer())
    with pytest.raises(ShardChangedError):
        data.register("a")
    assert sorted((r.shard_id, r.ok) for r in data.verify_roots().collect()) == [("a", False), ("b", True)]
    data.manifest["exclusions"].append("zz")
    data._save()
    with pytest.raises(IntegrityError):
        Dataset(spark, data.path)
    assert Dataset(spark, data.shard_path("b")).documents().count() == 2


def test_old_overlays_commit_to_shards_only():
    shards = [overlay.Shard("b", ".", "11" * 32, "22" * 32, 1), overlay.Shard("a", ".", "33" * 32, "44" * 32, 1)]
    for version in ("0.1.0", "0.2.0", None):
        assert overlay.dataset_root(shards, [blake3(b"x")], version) == overlay.shards_root(shards[::-1])
    assert overlay.dataset_root(shards, []) != overlay.dataset_root(shards, [blake3(b"x")])


def test_logs(spark):
    log = audit.AuditLog(clock=lambda: 5.0)
    for k in range(4):
        log.append("ingestion", {"k": k, "t": "é"})
    assert log.verify() and audit.AuditLog.of(log.frame(spark), log.root).verify()
    assert not log.tampered(1, payload={}).verify() and not log.tampered(2, seq=7).verify() and not log.tampered(3, signature="00").verify()
    with pytest.raises(ValueError):
        log.append("nothing", {})
    secret = ed25519.generate()
    signed = audit.AuditLog(clock=lambda: 5.0)
    signed.extend([("ingestion", {}), ("exclusion", {"h": 1})], secret)
    assert signed.verify() and not signed.tampered(0, signature=None).verify() and not signed.tampered(1, signature=signed.events[0].signature).verify()
    assert not audit.AuditLog(signed.events, signed.root).verify()
    events = spark.createDataFrame([(s, k, 0.0, "ingestion", json.dumps({"k": k})) for s in ("a", "b") for k in range(5)], "scope string, seq long, timestamp double, event_type string, payload string")
    chained = events.join(audit.chain(events, "scope"), ["scope", "seq"])
    assert audit.broken_links(chained, "scope").count() == 0
    bad = chained.withColumn("payload", F.when((F.col("scope") == "a") & (F.col("seq") == 2), F.lit("{}")).otherwise(F.col("payload")))
    assert [(r.scope, r.seq) for r in audit.broken_links(bad, "scope").collect()] == [("a", 2)]


def test_prefix_sums_dont_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    values = [(k, None if k % 11 == 0 else int(v)) for k, v in enumerate(rng.integers(0, 9, 300))]
    frame, total, want = spark.createDataFrame(values, "k int, v long"), 0, []
    for k, v in values:
        want.append((k, total))
        total += v or 0
    for n in (1, 3, 7):
        got = prefix.running_sum(frame.repartition(5), ["k"], "v", "s", n)
        assert sorted((r.k, r.s) for r in got.collect()) == want


def test_views_of_made_up_counts(spark):
    rng = np.random.default_rng(1)
    counts = [int(x) for x in rng.integers(0, 40, 50)]
    placed = views.source_map(spark.createDataFrame(list(enumerate(counts)), "k int, token_count long"), ["k"])
    owner = [k for k, n in enumerate(counts) for _ in range(n)]
    got = {r.chunk_id: (r.num_tokens, r.num_docs) for r in views.chunks(placed, 64).collect()}
    assert got == {c: (len(owner[c * 64 : c * 64 + 64]), len(set(owner[c * 64 : c * 64 + 64]))) for c in range(-(-len(owner) // 64))}
    wanted = spark.createDataFrame([(k,) for k in range(0, len(owner), 7)], "wanted long")
    assert {r.wanted: r.k for r in views.locate(wanted, placed, 32).collect()} == {k: owner[k] for k in range(0, len(owner), 7)}
    assert views.gaps(placed).count() == 0 and views.gaps(placed.where("k != 20")).count() == (counts[20] > 0)


@pytest.mark.parametrize("world, workers", [(1, 1), (2, 2), (3, 1)])
def test_loaders_share_out_everything(spark, world, workers):
    texts = ["abcdefghij" * 5 + f"-{k}" for k in range(40)]
    view = spark.createDataFrame([(k, len(t), list(t.encode())) for k, t in enumerate(texts)], "doc_ord long, token_count long, tokens array<int>")
    streams = {s: [] for s in range(world * workers)}
    index = 0
    for t in texts:
        for at in range(0, len(t), 32):
            streams[index % (world * workers)] += t.encode()[at : at + 32]
            index += 1
    for rank in range(world):
        for worker in range(workers):
            args = dict(order=["doc_ord"], size=32, rank=rank, world=world, worker=worker, workers=workers)
            got = [x.tolist() for x in loader.iterate(loader.load(view, **args))]
            want = streams[rank * workers + worker]
            assert got == [want[k : k + 32] for k in range(0, len(want), 32)]
            full = loader.load(view, **args, drop_last=True)
            assert full.count() == len(want) // 32
            a, b = ([x.tolist() for x in loader.iterate(loader.load(view, **args, shuffle=True, epoch_seed=e))] for e in (1, 1))
            rng = np.random.default_rng(loader.seed(1, rank, worker))
            mixed = []
            for part in got:
                part = np.array(part, np.uint32)
                rng.shuffle(part)
                mixed.append(part.tolist())
            assert a == b == mixed
    docs = [loader.by_document(view.select("doc_ord"), ["doc_ord"], r, world, w, workers, shuffle_seed=3) for r in range(world) for w in range(workers)]
    assert sorted(r.doc_ord for d in docs for r in d.collect()) == list(range(40))


def test_mixtures(spark):
    import hashlib

    rows = [(k, lang) for k, lang in enumerate(["en", "en", "la", "en", "fr"])]
    frame = spark.createDataFrame(rows, "doc_ord long, lang string")
    subsets = [Subset("english", "lang = 'en'", 0.7), Subset("nobody", "lang = 'xx'", 0.1), Subset("other", "lang != 'en'", 0.2)]
    members = {"english": [0, 1, 3], "nobody": [], "other": [2, 4]}
    want, cum = [], []
    for s in subsets:
        cum.append((cum[-1] if cum else 0.0) + s.default_weight)
    for step in range(200):
        d = hashlib.blake2b(step.to_bytes(8, "little") + (42).to_bytes(8, "little"), digest_size=16).digest()
        r, at = int.from_bytes(d[:8], "little") / 2**64, 0
        while at < 2 and r > cum[at]:
            at += 1
        if of := members[subsets[at].name]:
            want.append((step, of[int.from_bytes(d[8:], "little") % len(of)]))
    got = mixture.sample(frame.repartition(3), subsets, 200, 42)
    assert sorted((r.step, r.doc_ord) for r in got.collect()) == want
    assert mixture.weights(subsets, {"english": 0.2}) == pytest.approx({"english": 0.4, "nobody": 0.2, "other": 0.4})
    for bad in ([], [Subset("a", "lang = 'en'", 0.0)]):
        with pytest.raises(ValueError):
            mixture.weights(bad)
    with pytest.raises(ValueError):
        Subset("a", "lang ==")


def test_sources_and_sinks(spark, tmp_path, corpus):
    (tmp_path / "a.jsonl").write_text('{"body": "x", "k": 1}\n\n{"body": "y", "k": null}\n')
    assert [(r.content, r.k) for r in readers.jsonl(spark, f"{tmp_path}/a.jsonl", "body").orderBy("source_ord").collect()] == [("x", 1), ("y", None)]
    (tmp_path / "bad.jsonl").write_text('{"body": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, f"{tmp_path}/bad.jsonl", "body", "body string").collect()
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("x/a.b.txt", b"first"), ("x/a.b.json", b'{"n": 1}'), ("x/a.b.cls", b"3\n"), ("c.json", b"{}"), ("d.txt", b"second"), ("d.bin", b"\xff\xfe")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = readers.tar(spark, f"{tmp_path}/a.tar").orderBy("source_ord").collect()
    assert [(r._stem, bytes(r.content), json.loads(r.metadata)) for r in got] == [("x/a.b", b"first", {"_stem": "x/a.b", "n": 1, "cls": "3"}), ("d", b"second", {"_stem": "d", "bin_bytes": 2})]
    for bad, error in (([{"body": "x"}], KeyError), ([{"text": 3}], TypeError)):
        with pytest.raises(error):
            readers.records(spark, bad)
    with pytest.raises(MissingDependencyError):
        readers.streaming_shards(spark, "x")
    docs = corpus.documents()
    sinks.to_jsonl(docs, f"{tmp_path}/out", content="body")
    back = {r.body: (r.lang, r.doc_hash) for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert back["hello"] == ("en", blake3(b"hello").hex()) and len(back) == 3
    sinks.to_parquet(docs, f"{tmp_path}/pq", hashes=False, metadata=False)
    assert spark.read.parquet(f"{tmp_path}/pq").columns == ["text"]
    sinks.to_token_files(corpus.view("byte-level-v1"), f"{tmp_path}/bin")
    assert sorted(len(r.stream) for r in spark.read.parquet(f"{tmp_path}/bin").collect()) == [20, 68]
    shown = {r.text: r.tokens for r in sinks.table(docs, corpus.view("byte-level-v1")).collect()}
    assert shown["hello"] == list(b"hello") and shown[""] == []
    assert files.read_bytes(spark, f"{tmp_path}/a.jsonl", 2, 4) == b"body"


def test_names_and_reports(spark, corpus):
    assert metadata.export_names(["text", "meta_text", "n"], ["text", "doc_hash"]) == {"meta_text": "meta_text", "n": "n", "text": "meta_meta_text"}
    frame = spark.createDataFrame([(k, q) for k, q in enumerate([0.9, 0.5, 0.3, 0.8, None])], "k long, qs double")
    stats = {r.zone: r for r in metadata.zone_stats(frame, "k", ["qs"], 2).collect()}
    assert (stats[0].max, stats[1].min, stats[2].null_count, stats[2].sample) == ("0.9", "0.3", 1, [])
    a, b = (spark.createDataFrame([(x,) for x in xs], "doc_hash string") for xs in ("abc", "bcde"))
    assert tuple(report.diff(a, b).first()) == (2, 1, 2)
    assert [tuple(r) for r in report.differing(a, b).collect()] == [("a", "a"), ("d", "b"), ("e", "b")]
    assert report.summary(corpus.documents(), ["lang"]).where("section = 'lang'").count() == 2
    assert report.ratio(3, 2) == 1.5 and report.ratio(3, 0) == 0.0


def test_functions_as_filters_and_the_report(corpus):
    assert [r.n for r in corpus.filter(lambda row: row["n"] > 2 and "content" not in row).orderBy("n").collect()] == [3, 4]
    rows = {(r.section, r.value): r.n for r in corpus.summary(["lang"]).collect()}
    assert rows["documents", None] == 3 and rows["lang", "fr"] == 1 and rows["tokens", "byte-level-v1"] == 22 and ("smt_root", corpus.smt_root().hex()) in rows


def test_tokens_of_documents_that_arent_there(corpus):
    with pytest.raises(OutOfSyncError):
        sinks.table(corpus.documents().where("n != 4"), corpus.view("byte-level-v1"))


def test_chunks_are_recorded_and_checked(spark, tmp_path):
    text = "abc" * 50_000
    made = Corpus.create(spark, f"{tmp_path}/c", readers.records(spark, [{"text": text}, {"text": text[1:]}]), [ByteTokenizer()])
    stream = np.frombuffer((text + text[1:]).encode(), np.uint8).astype("<u2")
    got = {r.chunk_id: (r.num_tokens, r.bits, bytes(r.chunk_hash)) for r in spark.read.parquet(f"{made.path}/chunks").collect()}
    assert got == {k: (len(part), 16, blake3(part.tobytes())) for k in range(5) for part in [stream[k * 65_536 : (k + 1) * 65_536]]}
    view = spark.read.parquet(f"{made.path}/tokens/tokenizer_id=byte-level-v1")
    bad = view.withColumn("tokens", F.transform("tokens", lambda x, i: F.when(i == 7, F.lit(1)).otherwise(x)))
    bad.write.parquet(f"{tmp_path}/bad")
    spark.read.parquet(f"{tmp_path}/bad").write.mode("overwrite").parquet(f"{made.path}/tokens/tokenizer_id=byte-level-v1")
    assert "chunks of byte-level-v1" in [r.check for r in made.verify().collect() if not r.ok]


def test_blocks_begin_anew_where_one_is_full(spark):
    sizes = [10, 50, 0, 200, 5, 5, 60, 100]
    frame = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(sizes)], "k long, n long, s int")
    want = []
    for shard in (0, 1):
        block = used = 0
        for k, n in enumerate(sizes):
            if k % 2 == shard:
                want.append((shard, k, n, block, used))
                used += n + 40
                if used >= 120:
                    block, used = block + 1, 0
    assert sorted(map(tuple, views.block_layout(frame, "k", "n", F.col("s"), 120).collect())) == want


def test_the_order_of_a_shuffled_list(spark):
    pieces = list(range(57))
    np.random.default_rng(9).shuffle(pieces)
    assert loader.permutation(57, 9).tolist() == pieces
    frame = spark.createDataFrame([(k,) for k in range(57)], "doc_ord long")
    got = loader.by_document(frame, ["doc_ord"], 1, 2, 0, 2, shuffle_seed=9, listed=True)
    assert [r.doc_ord for r in got.orderBy("number").collect()] == pieces[2::4]


def test_chunks_are_never_rows_of_tokens(spark, tmp_path, monkeypatch):
    """What is stored on the way to chunk records is hashes, and bytes of the chunks at the ends of tasks' runs."""
    import lodestone.store as store

    kept = []
    monkeypatch.setattr(store, "stored", lambda df, name: kept.append(df) or df)
    lengths, rng = [5, 0, 17, 300, 1, 64, 700, 3], np.random.default_rng(3)
    tokens = [rng.integers(0, 256, n).tolist() for n in lengths]
    at = np.cumsum([0, *lengths[:-1]]).tolist()
    view = spark.createDataFrame(list(zip(at, tokens, strict=True)), "token_offset long, tokens array<int>")
    stream = np.concatenate(tokens).astype("<u2")
    want = [(k, len(x), 16, blake3(x.tobytes())) for k, x in enumerate(np.split(stream, range(64, len(stream), 64)))]
    for made in (view.coalesce(1).sortWithinPartitions("token_offset"), view.repartition(3)):
        got = store.chunk_records(made, 256, 64).orderBy("chunk_id").collect()
        assert [(r.chunk_id, r.num_tokens, r.bits, bytes(r.chunk_hash)) for r in got] == want
        assert not any(f.dataType.typeName() == "array" for f in kept[-1].schema)
    assert kept[0].where("piece IS NOT NULL").count() <= 2


def test_views_are_in_order(spark):
    """A view follows the documents, so that a task's chunks are whole."""
    from lodestone.store import tokenize

    docs = spark.range(400).repartition(7).selectExpr("id AS doc_ord", "unhex(lpad(hex(id), 64, '0')) AS doc_hash", "encode(repeat('x', int(id % 9)), 'utf-8') AS content")
    made = tokenize(docs, ByteTokenizer()).withColumn("task", F.spark_partition_id()).collect()
    assert all(a.doc_ord < b.doc_ord for a, b in zip(made, made[1:], strict=False) if a.task == b.task)
    assert {r.doc_ord: r.token_offset for r in made} == {k: sum(j % 9 for j in range(k)) for k in range(400) if k % 9}


def test_scratch_tables_are_deleted(spark, tmp_path):
    from lodestone.functions import columns

    with columns.scratch():
        df = columns.stored(spark.range(3).toDF("a"), "x")
        assert files.exists(spark, df._lodestone_path) and df.count() == 3
    assert not files.exists(spark, df._lodestone_path)


@pytest.mark.parametrize("drop_last", [False, True])
def test_shuffled_batches_are_those_of_one_generator_in_many_tasks(spark, monkeypatch, drop_last):
    monkeypatch.setattr(loader, "BLOCK", 4)
    tokens = np.random.default_rng(1).integers(0, 1000, 601)
    view = spark.createDataFrame([(k, len(x), x.tolist()) for k, x in enumerate(np.split(tokens, [3, 90, 91, 400]))], "doc_id long, token_count long, tokens array<int>")
    args = {"order": ["doc_id"], "size": 16, "rank": 1, "world": 2, "drop_last": drop_last}
    plain = [x.copy() for x in loader.iterate(loader.load(view, **args))]
    made = loader.load(view, **args, shuffle=True, epoch_seed=7)
    rng = np.random.default_rng(loader.seed(7, 1, 0))
    for x in plain:
        rng.shuffle(x)
    assert len(plain) > 16 and [x.tolist() for x in loader.iterate(made)] == [x.tolist() for x in plain]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_block" in plan and "Repartition 1," not in plan
    assert loader.load(view.limit(0), **args, shuffle=True).count() == 0


def test_batches_and_row_groups_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    conf = {"spark.sql.execution.arrow.maxBytesPerBatch": "64m", "spark.sql.parquet.columnarReaderBatchSize": "4096"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(columns, "GROUP_BYTES", 1 << 20)
        rows = spark.range(0, 3000, numPartitions=1).select(F.concat(F.lit("x" * 8000), F.col("id").cast("string")).alias("content"), F.col("id").alias("source_ord"))
        path = str(tmp_path / "c")
        view = Corpus.create(spark, path, rows, [ByteTokenizer()], clock=lambda: 0.0, snapshot_id="0").view("byte-level-v1")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

        seen = view.coalesce(1).select("tokens").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) <= 2 * columns.BATCH_BYTES
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == columns.SCAN_ROWS
        text = spark.range(0, 400, numPartitions=1).select(*(F.sha2((F.col("id") * 1000 + k).cast("string"), 512).alias(f"c{k}") for k in range(80)))
        columns.written(text, str(tmp_path / "t"))
        assert max(pq.ParquetFile(f).num_row_groups for f in (tmp_path / "t").glob("*.parquet")) > 1
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
        columns.bounded(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"  # lower bounds stay
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_documents_are_encoded_once(spark, tmp_path, monkeypatch):
    encoded = spark.sparkContext.accumulator(0)

    def tokens(self, content):
        @F.arrow_udf("array<int>")
        def run(values: pa.Array) -> pa.Array:
            encoded.add(len(values))
            return pa.array([[len(v.as_py())] for v in values], pa.list_(pa.int32()))

        return run(content)

    monkeypatch.setattr(WhitespaceTokenizer, "tokens", tokens)
    docs = spark.range(50).select(F.col("id").alias("doc_ord"), F.encode(F.col("id").cast("string"), "UTF-8").alias("doc_hash"), F.encode(F.repeat(F.lit("a"), F.col("id").cast("int")), "UTF-8").alias("content"))
    rows = tokenize(docs, WhitespaceTokenizer()).orderBy("doc_ord").collect()
    assert [(r.doc_ord, r.token_offset, list(r.tokens)) for r in rows] == [(k, k, [k]) for k in range(50)]
    assert encoded.value == 50


def test_a_loader_computes_its_view_once(spark):
    computed = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<int>")
    def tokens(values: pa.Array) -> pa.Array:
        computed.add(len(values))
        return pa.array([[1] * (v.as_py() % 3) for v in values], pa.list_(pa.int32()))

    view = spark.range(30).select("id", tokens("id").alias("tokens")).withColumn("token_count", F.size("tokens").cast("long"))
    got = loader.load(view, ["id"], 4).collect()
    assert sum(len(r.tokens) for r in got) == 30 and computed.value == 30


def test_numbered_rows_dont_pass_through_python(spark, monkeypatch):
    plans, kept = [], prefix.stored
    monkeypatch.setattr(prefix, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), kept(df, name))[1])
    keys = [int(k) for k in np.random.default_rng(3).permutation(500)]
    frame = spark.createDataFrame([(k, f"text {k}") for k in keys], "k int, text string")
    for n in (1, 3, 7):
        got = prefix.row_numbers(frame.repartition(5), ["k"], "at", n)
        assert got.columns == ["k", "text", "at"] and sorted(map(tuple, got.collect())) == [(k, f"text {k}", k) for k in range(500)]
    assert prefix.row_numbers(frame.limit(0), ["k"], "at", 3).count() == 0
    assert len(plans) == 4 and not any("InArrow" in p or "Python" in p for p in plans)


def test_a_long_document_is_summed_piece_by_piece(monkeypatch):
    monkeypatch.setattr(views, "SLICE", 1000)
    rng = np.random.default_rng(4)
    contents = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 3, 5000, 0, 999, 1001, 1)]
    offset = np.array([7, 7, 100, 5100, 6000, 9000, 20_000])
    want = {}
    for at, x in zip(offset, contents, strict=True):
        for i, v in enumerate(x.tolist()):
            n, total, weighted = want.get(c := (at + i) // 64, (0, 0, 0))
            want[c] = n + 1, total + v, weighted + v * ((at + i) % 64)
    tokens = pa.RecordBatch.from_arrays([pa.array(offset), pa.array([x.astype(np.int32) for x in contents], pa.list_(pa.int32()))], ["token_offset", "tokens"])
    for batch, run in (
        (tokens, views._sums(64)),
        (pa.RecordBatch.from_arrays([pa.array(offset), pa.array([x.tobytes() for x in contents], pa.binary())], ["token_offset", "content"]), views._encoded_sums(64, ByteTokenizer().config())),
    ):
        got, out = {}, list(run(iter([batch.slice(0, 4), batch.slice(4)])))
        for c, *sums in (r.values() for b in out for r in b.to_pylist()):
            got[c] = tuple(x + y for x, y in zip(got.get(c, (0, 0, 0)), sums, strict=True))
        assert got == want and max(sum(b.column("n").to_pylist()) for b in out) <= 1000


def test_the_stream_is_summed_where_it_is_encoded(spark, docs_of, tmp_path):
    import __spark_entry__

    texts = ["abc", "", "é" * 70_000, "abc", "tail"]
    docs_of(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = __spark_entry__.queries()["token_stream"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    data = np.frombuffer("".join([*texts[:3], texts[4]]).encode(), np.uint8).astype(np.int64)
    want = [(k, len(x), int(x.sum()), int((x * np.arange(len(x))).sum())) for k in range(3) for x in [data[k * 65_536 : (k + 1) * 65_536]]]
    assert sorted(map(tuple, got.collect())) == want
