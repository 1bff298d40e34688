import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import near_dedup
from lodestone.llm.near_dedup import NearDedup


def prose(rng, n):
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10))) for _ in range(3000)]
    return [str(w) for w in rng.choice(words, n)]


def edited(rng, words, share):
    return [w if rng.random() > share else "edit" + str(rng.integers(0, 10**6)) for w in words]


def brute(pairs, p):
    """Components of the graph of all pairs within the distance; the least id of each."""
    pairs = [(i, t) for i, t in pairs if i is not None and t]
    sigs, _ = near_dedup.signatures(pa.array([t for _, t in pairs], pa.string()), p)
    root = list(range(len(pairs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(pairs)):
        for b in np.flatnonzero((sigs[a + 1 :] != sigs[a]).sum(1) <= p.distance) + a + 1:
            root[find(int(b))] = find(a)
    groups = {}
    for k, (i, _) in enumerate(pairs):
        groups.setdefault(find(k), set()).add(i)
    return sorted({(i, min(g)) for g in groups.values() if len(g) > 1 for i in g})


@pytest.mark.parametrize("p", [NearDedup(), NearDedup(slots=32, bits=8, distance=9, errors=2), NearDedup(slots=16, bits=4, distance=6, errors=0)])
def test_no_pair_within_the_distance_is_missed(docs_of, p):
    rng = np.random.default_rng(5)
    pairs = []
    for g in range(25):
        base = prose(rng, int(rng.integers(20, 200)))
        pairs += [(len(pairs) + k, " ".join(edited(rng, base, share))) for k, share in enumerate(rng.uniform(0, 0.35, 5))]
    pairs += [(900 + k, t) for k, (_, t) in enumerate(pairs[:6])]
    got = sorted((r.doc_id, r.keep_id) for r in near_dedup.near_duplicates(docs_of(pairs), params=p).collect())
    assert got == brute(pairs, p) and len(got) > 20


def test_pigeonhole_holds_for_every_pair_of_signatures():
    p, rng = NearDedup(slots=24, bits=2, distance=9, errors=1), np.random.default_rng(6)
    assert sum(r + 1 for _, r in p.chunks()) == p.distance + 1
    assert sorted(x for s, _ in p.chunks() for x in s) == list(range(24))
    a = rng.integers(0, 4, (400, 24)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(24, rng.integers(0, 10), replace=False)
        row[at] = (row[at] + rng.integers(1, 4, len(at))) % 4
    assert (near_dedup.keys(a, p) == near_dedup.keys(b, p)).any(1).all()


def test_a_bucket_of_many_copies_gives_few_edges():
    sigs = np.repeat(np.arange(3, dtype=np.uint16)[:, None] * 100, 16, 1).repeat(2000, 0)
    sigs[:, 0] = np.arange(len(sigs)) % 5
    root = near_dedup.components(sigs, 2)
    assert len(set(root.tolist())) == 3


def test_near_copies_go_and_others_stay(docs_of):
    rng = np.random.default_rng(7)
    base = [prose(rng, 150) for _ in range(40)]
    pairs = [(k, " ".join(b)) for k, b in enumerate(base)] + [(100 + k, " ".join(edited(rng, b, 0.05))) for k, b in enumerate(base)]
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(docs_of(pairs)).collect()}
    assert set(range(40)) <= kept
    assert len(kept) <= 42  # recall against the copies that were made: 0.95


def test_odd_and_empty(odd, empty):
    got = sorted((r.doc_id, r.keep_id) for r in near_dedup.near_duplicates(odd).collect())
    assert got == [(4, 4), (5, 4), (6, 6), (7, 6)]
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 2
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0


def links(pairs, p):
    """The documents within the distance of each, by brute force over all pairs of documents."""
    pairs = sorted({(i, t) for i, t in pairs if i is not None and t})
    sigs, _ = near_dedup.signatures(pa.array([t for _, t in pairs], pa.string()), p)
    near = (sigs[:, None] != sigs[None]).sum(2) <= p.distance
    return {i: int(n) - 1 for (i, _), n in zip(pairs, near.sum(1), strict=True) if n > 1}


@pytest.mark.parametrize("block", [4096, 7])
def test_links_are_those_of_all_pairs(docs_of, monkeypatch, block):
    """Also where buckets are cut into blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(8)
    p, pairs = NearDedup(slots=32, bits=8, distance=9, errors=1), []
    for _ in range(6):
        base = prose(rng, 120)
        pairs += [(len(pairs) + k, " ".join(edited(rng, base, share))) for k, share in enumerate(rng.uniform(0, 0.2, 40))]
    pairs += [(1000 + k, pairs[k % 3][1]) for k in range(60)] + [(2000, "alone in here"), (1, pairs[1][1]), (None, pairs[0][1])]
    got = {r.doc_id: (r.keep_id, r.n_links) for r in near_dedup.near_duplicates(docs_of(pairs), params=p).collect()}
    assert {i: n for i, (_, n) in got.items()} == links(pairs, p)
    assert sorted((i, k) for i, (k, _) in got.items()) == brute(pairs, p)


def test_a_large_bucket_is_compared_in_little_memory():
    import tracemalloc

    p = near_dedup.NearDedup()
    rng = np.random.default_rng(1)
    sigs = np.repeat(rng.integers(0, 1 << 16, (8, p.slots)).astype(np.uint16), 100, 0)
    n = len(sigs)
    weight, mask, side = np.ones(n, np.int64), np.zeros(n, np.int16), np.zeros(n, np.int32)
    tracemalloc.start()
    links = near_dedup._links(sigs, weight, mask, side, np.array([0, n]), p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == 99).all() and peak < 40e6
