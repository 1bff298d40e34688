import numpy as np
import pytest

from lodestone.llm import ann, queries


def brute(ids, x, k):
    d = ann.distances(x, x)
    d[ids[:, None] == ids[None]] = np.inf
    out = {}
    for i, row in zip(ids.tolist(), d, strict=True):
        order = np.lexsort((ids, np.round(row, 9)))[:k]
        out[i] = [int(ids[j]) for j in order if np.isfinite(row[j])]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "clash") for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, id string")


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
    return out


def vectors(n, seed=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 10)) * 2
    return np.arange(n) * 3, centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 10))


def test_factor_one_is_exact(spark):
    ids, x = vectors(500)
    got = found(ann.nearest(table(spark, ids, x), k=7, factor=1.0, shard_rows=80))
    assert got == brute(ids, x, 7)


def test_recall_of_a_relaxed_search(spark):
    ids, x = vectors(800, 17)
    truth = brute(ids, x, 10)
    got = found(ann.nearest(table(spark, ids, x), factor=4.0, shard_rows=128))
    assert set(got) == set(truth)
    assert np.mean([len(set(got[i]) & set(truth[i])) / 10 for i in truth]) >= 0.9


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (4.0, 0.9)])
def test_recall_without_structure(factor, least):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(len(x))
    truth = brute(ids, x, 10)
    _, names = ann.Tree(x, 64).search(x, ids, ids, 10, factor)
    assert np.mean([len(set(a) & set(truth[i])) / 10 for i, a in enumerate(names.tolist())]) >= least


def test_ties_repeats_and_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [3.0, 4.0]), (None, [1.0, 1.0]), (5, None), (6, []), (7, [1.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [float("inf"), 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.rank): (r.neighbour_id, r.distance) for r in ann.nearest(frame, k=2).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (3, 0.0), (2, 1): (1, 0.0), (2, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0), (4, 1): (1, 5.0), (4, 2): (2, 5.0)}
    assert ann.nearest(frame.where("vec_id < 0")).count() == 0
    assert ann.nearest(frame.where("vec_id = 1")).count() == 0
    with pytest.raises(ValueError):
        ann.nearest(frame, factor=0.5)


def test_more_neighbours_than_vectors(spark):
    ids, x = vectors(6)
    assert found(ann.nearest(table(spark, ids, x), k=10, shard_rows=2)) == brute(ids, x, 10)


@pytest.mark.parametrize("latent", [6, 10, 16])
def test_recall_of_the_query_on_vectors_of_low_intrinsic_dimension(spark, latent):
    rng = np.random.default_rng(20)
    x = rng.normal(size=(8192, latent)) @ rng.normal(size=(latent, 64))
    ids = np.arange(len(x))
    some = rng.choice(ids, 200, replace=False)
    d = ann.distances(x[some], x)
    d[np.arange(len(some)), some] = np.inf
    truth = np.argsort(d, axis=1)[:, :10]
    got = found(ann.nearest(table(spark, ids, x), factor=queries.ANN_FACTOR, shard_rows=1024))
    assert np.mean([len(set(got[i]) & set(t)) / 10 for i, t in zip(some.tolist(), truth.tolist(), strict=True)]) >= 0.9


def test_queries_against_all(spark):
    ids, x = vectors(700, 23)
    frame = table(spark, ids, x)
    got = found(ann.nearest(frame, frame.where("vec_id % 100 = 0"), k=5, shard_rows=64))
    truth = brute(ids, x, 5)
    assert got == {i: truth[i] for i in truth if i % 100 == 0}


@pytest.mark.parametrize("x", [np.eye(1400), np.repeat([[1.0, 2.0]], 3000, 0), np.arange(1500.0)[:, None] // 100], ids=["equidistant", "equal", "steps"])
def test_ties_make_no_deep_or_wrong_tree(x):
    ids = np.arange(len(x)) * 2
    tree = ann.Tree(x, 64)
    some = np.arange(0, len(x), 100)
    best, names = tree.search(x[some], ids[some], ids, 10, 1.0)
    d = ann.distances(x[some], x)
    d[np.arange(len(some)), some] = np.inf
    for row, got, near in zip(d, names.tolist(), best, strict=True):
        order = np.lexsort((ids, np.round(row, 6)))[:10]
        assert got == ids[order].tolist() and np.allclose(near, row[order])
    assert sorted(np.concatenate([leaf.rows for leaf in tree.leaves]).tolist()) == list(range(len(x)))


def test_a_point_of_many_copies(spark):
    ids, x = vectors(900, 24)
    x[300:700] = x[5]  # near half of the rows are one vector
    x[700:720] = x[6]
    frame = table(spark, ids, x)
    got = found(ann.nearest(frame, k=6, shard_rows=100))
    truth = brute(ids, x.round(12), 6)
    assert set(got) == set(truth) and got[900] == truth[900] and all(got[i] == truth[i] for i in truth if 900 <= i < 2160)
    assert sum(got[i] == truth[i] for i in truth) >= 0.99 * len(truth)


def test_single_precision_and_clashing_columns(spark):
    ids, x = vectors(120, 25)
    frame = spark.createDataFrame([(int(i), [float(np.float32(v)) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    for clash in ("id", "vec", "leaf", "shard", "k1", "k2", "tau", "asks", "last", "best", "distance", "neighbour_id", "rank", "chunks", "first"):
        frame = frame.withColumn(clash, frame.vec_id)
    assert found(ann.nearest(frame, k=4, shard_rows=30)) == brute(ids, x.astype(np.float32).astype(float), 4)


def test_the_query_is_that_of_brute_force(spark):
    """Beside the SQL: recall of the registered query, over rows of the same shape."""
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth = brute(ids, x, 10)
    got = found(queries.op4_nearest_neighbours(spark, folder))
    assert got == {i: truth[i] for i in truth if i % 100 == 0}
