import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _gbt, quality


def corpus(rng, n):
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(800)]
    pairs, labels = [], []
    for k in range(n):
        body = [str(w) for w in rng.choice(words, rng.integers(5, 120))]
        good = k % 3 > 0
        if not good:
            body = [w + "###" for w in body] if k % 2 else body[:3] * 20
        pairs.append((k, ". ".join(" ".join(body[i : i + 9]) for i in range(0, len(body), 9))))
        labels.append((k, int(good)))
    return pairs, labels


def test_flattened_trees_equal_a_walk_row_by_row():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    f = _gbt.fit(x, (x[:, 0] * x[:, 1] > 0).astype(int), trees=12, depth=3)

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            at = 0
            for _ in range(f.depth):
                at = 2 * at + (2 if row[f.feature[t, at]] > f.threshold[t, at] else 1)
            total += f.leaf[t, at - (2**f.depth - 1)]
        return total

    assert np.allclose(f.raw(x), [walk(r) for r in x])
    assert (((f.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean()) > 0.85


def test_features_of_a_row_dont_depend_on_its_neighbours():
    texts = ["One two three.\nTwo three!", None, "", "ÄÖ | x | 12 ##", "same same same same", "\n\n", "word"]
    together = quality.features(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], quality.features(pa.array([t], pa.string()))[0])
    assert together.shape == (7, len(quality.FEATURES))
    by = dict(zip(quality.FEATURES, together[4], strict=True))
    assert by["distinct_words"] == 0.25 and by["top_repeat"] == 1.0 and by["word_max"] == 4
    assert (together[1] == together[2]).all()


def test_held_out_accuracy_and_good_ones_stay(spark, docs_of):
    rng = np.random.default_rng(9)
    pairs, labels = corpus(rng, 600)
    frame = docs_of(pairs)
    model = quality.fit_quality(frame, spark.createDataFrame(labels[:400], "doc_id long, quality int"))
    got = {r.doc_id: r.is_good for r in quality.score_quality(frame, model).collect()}
    rest = labels[400:]
    assert np.mean([got[i] == bool(y) for i, y in rest]) > 0.97
    kept = {r.doc_id for r in quality.keep_good(frame, model).collect()}
    assert kept == {i for i, g in got.items() if g}
    assert model.report["accuracy"] > 0.97 and model.report["rows"] == 400


def test_the_sample_is_bounded_and_repeatable(spark, docs_of):
    pairs, labels = corpus(np.random.default_rng(10), 200)
    frame, table = docs_of(pairs + pairs[:20]), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int")
    a, b = (quality.fit_quality(frame.repartition(k), table, max_labelled=90) for k in (1, 5))
    assert a.report["rows"] == 90
    assert (a.forest.threshold == b.forest.threshold).all() and (a.forest.leaf == b.forest.leaf).all()


@pytest.mark.parametrize("labels", [[], [(4, 1), (6, 1)]])
def test_odd_and_empty(spark, odd, empty, labels):
    model = quality.fit_quality(odd, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()  # without both classes nothing is bad
    assert quality.score_quality(odd, model).count() == odd.count()
    assert quality.keep_good(empty, model).count() == 0
