import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestone.llm import bpe, near_dedup, queries, secrets  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(19)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    pairs, labels = [], []
    for k in range(240):
        body = [str(w) for w in rng.choice(words, rng.integers(60, 160))]
        good = k % 4 > 0
        body = body if good else [w + "&&&" for w in body]
        pairs.append((k, ". ".join(" ".join(body[i : i + 9]) for i in range(0, len(body), 9))))
        labels.append((k, int(good), 0))
    pairs += [(300 + k, t) for k, t in pairs[:20]]
    pairs += [(400 + k, t + " One more line at the end.") for k, t in pairs[:20]]
    secret = "".join(rng.choice(list("0123456789abcdef"), 40))
    pairs += [(500, pairs[1][1][::-1] + f' token = "{secret}" end.'), (501, None), (502, "")]
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), secret


def test_stage_by_stage(spark, folder, tmp_path):
    base, secret = folder
    docs, kept = spark.read.parquet(f"{base}/documents.parquet"), {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, base).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count() == before.select("text").distinct().count()
    good = {k for k in range(240) if k % 4}
    assert len(good - kept["quality"]) <= 2 and not any(k % 4 == 0 for k in kept["quality"] if k < 240)
    assert not any(300 <= k < 400 for k in kept["exact_dedup"]) and kept["exact_dedup"] >= good & kept["quality"]
    # near copies: those of brute force over all pairs of signatures
    p = near_dedup.NearDedup()
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/exact_dedup").collect() if r.text)
    sigs, _ = near_dedup.signatures(pa.array([t for _, t in rows]), p)
    left = near_dedup.components(sigs, p.distance)
    assert kept["near_dedup"] - {501, 502} == {rows[k][0] for k in set(left.tolist())}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/secrets").collect()}
    assert kept["secrets"] == kept["near_dedup"]
    assert 500 not in text or secret not in text[500] and "[SECRET]" in text[500]
    assert not any(secrets.scan(t, secrets.SecretScan()) for t in text.values() if t)
    tokens = {}
    for r in docs.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    counted = bpe.encode(spark.read.parquet(f"{tmp_path}/secrets"), bpe.load(queries.VOCABULARY)).collect()
    assert tokens == {r.doc_id: r.n_tokens for r in counted if r.n_tokens}


def test_run_gives_the_same(spark, folder, tmp_path):
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, base).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(map(tuple, corpus_pipeline.run(spark, base).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_and_empty_tables_through_every_stage(spark, odd, empty, folder):
    """Nulls in every column, empty and very long texts, repeated rows, columns of clashing names; and nothing at all."""
    base, _ = folder
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd, empty):
            got = stage(spark, frame, base)
            if name == "packing":
                assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in frame.collect()}
            else:
                assert got.columns == frame.columns
                kept = sorted(map(repr, got.select("doc_id", "text").collect()))
                assert not [r for r in kept if r not in set(map(repr, frame.select("doc_id", "text").collect()))]
