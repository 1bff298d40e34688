import numpy as np

from lodestone.llm import exact_dedup
from lodestone.llm.exact_dedup import LsmIndex


def brute(pairs):
    best = {}
    for i, t in pairs:
        if t is not None:
            best.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in best.items()}
    seen, out = set(), []
    for i, t in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0)):
        if t is None:
            out.append((i, i, False))
        else:
            out.append((i, keep[t], t in seen))
            seen.add(t)
    return sorted(out, key=repr)


def rows(frame):
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def test_against_brute_force(docs_of):
    rng = np.random.default_rng(3)
    pairs = [(int(rng.integers(0, 200)) if rng.random() > 0.1 else None, None if rng.random() < 0.05 else f"text {rng.integers(0, 60)}") for _ in range(400)]
    pairs += [(500, ""), (501, ""), (1, "same row"), (1, "same row")]
    frame = docs_of(pairs)
    assert rows(exact_dedup.exact_duplicates(frame, memtable=16, fanout=2)) == brute(pairs)
    kept = exact_dedup.drop_exact_duplicates(frame)
    assert kept.columns == frame.columns
    assert rows(kept.select("doc_id", "text")) == sorted([(i, t) for (i, t) in _survivors(pairs)], key=repr)


def _survivors(pairs):
    seen = set()
    for i, t in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0)):
        if t is None or t not in seen:
            seen.add(t)
            yield i, t


def test_hits_are_verified_by_their_bytes(docs_of, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.when(text.isNotNull(), F.unhex(F.lit("00" * 16))))
    pairs = [(3, "a"), (1, "b"), (2, "a"), (4, "c"), (5, "b")]
    assert rows(exact_dedup.exact_duplicates(docs_of(pairs))) == brute(pairs)


def test_the_shuffling_join_gives_the_same(docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    pairs = [(k, f"t{k % 7}") for k in range(50)]
    assert rows(exact_dedup.exact_duplicates(docs_of(pairs))) == brute(pairs)


def test_index_against_a_dictionary():
    rng = np.random.default_rng(4)
    index, want = LsmIndex(memtable=32, fanout=3), {}
    for _ in range(60):
        n = int(rng.integers(1, 40))
        high, low, ids = rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 1000, n)
        index.add(high, low, ids)
        for h, lo, i in zip(high.tolist(), low.tolist(), ids.tolist(), strict=True):
            m, c = want.get((h, lo), (i, 0))
            want[h, lo] = (min(m, i), c + 1)
        assert len([r for r in index.runs if r.level == 0]) < 3
    run = index.compact()
    got = {(h, lo): (i, c) for h, lo, i, c in zip(run.high.tolist(), run.low.tolist(), run.ids.tolist(), run.count.tolist(), strict=True)}
    assert got == want
    assert (run.find(run.high, run.low) == np.arange(len(run.high))).all()


def test_odd_and_empty(odd, empty):
    got = exact_dedup.drop_exact_duplicates(odd)
    assert got.columns == odd.columns and got.count() == 9
    assert sorted(r.doc_id for r in got.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 6, 8, 9]
    assert exact_dedup.exact_duplicates(odd).count() == odd.count()
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0 and exact_dedup.exact_duplicates(empty).count() == 0


def test_a_hot_text_and_a_hot_row(docs_of):
    """A third of the rows are one text, and many of them one row, in any number of partitions."""
    pairs = [(k % 400, "hot") for k in range(900)] + [(0, "hot")] * 200 + [(k, f"t{k % 300}") for k in range(900)]
    for frame in (docs_of(pairs), docs_of(pairs).repartition(13)):
        assert rows(exact_dedup.exact_duplicates(frame, memtable=50)) == brute(pairs)
        kept = rows(exact_dedup.drop_exact_duplicates(frame, memtable=50).select("doc_id", "text"))
        assert kept == sorted(_survivors(pairs), key=repr)


def test_a_run_of_many_digests_of_one_upper_half():
    high, low = np.zeros(500, np.uint64), np.random.default_rng(9).permutation(500).astype(np.uint64) * np.uint64(2)
    run = exact_dedup.Run(high, low, np.arange(500), np.ones(500, np.int64))
    assert (run.find(run.high, run.low) == np.arange(500)).all()
    assert (run.find(run.high, run.low + np.uint64(1)) == -1).all()
