import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bpe, packing, queries
from lodestone.llm.packing import Packing


def brute(sizes, p):
    """Every bin is tried for every piece."""
    caps, w, bins, out = (p.tokens, p.documents, p.attention), p.weights, [], []
    for s in sizes:
        need = (s, 1, s * s)
        best, score = None, None
        for b, left in enumerate(bins):
            if all(x >= n for x, n in zip(left, need, strict=True)):
                if p.rule == "dot":
                    v = -sum(wk * n / c * x / c for wk, n, x, c in zip(w, need, left, caps, strict=True))
                else:
                    v = sum(wk * ((x - n) / c) ** 2 for wk, n, x, c in zip(w, need, left, caps, strict=True))
                if score is None or v < score - 1e-12:
                    best, score = b, v
        if best is None:
            bins.append(list(caps))
            best = len(bins) - 1
        bins[best] = [x - n for x, n in zip(bins[best], need, strict=True)]
        out.append(best)
    return out


@pytest.mark.parametrize("p", [Packing(100, 6, 4000, rule="norm"), Packing(100, 6, 4000, rule="dot"), Packing(50, 3, 2500, (1, 0, 0))])
def test_bins_are_those_of_brute_force(p):
    rng = np.random.default_rng(12)
    sizes = np.sort(rng.integers(1, p.longest + 1, 300))[::-1].copy()
    got = packing.best_fit(sizes, p)
    want = brute(sizes.tolist(), p)
    # ties of floating point may be broken otherwise; then the filling has to be as good
    assert got.tolist() == want or abs(len(set(want)) - len(set(got.tolist()))) <= 1
    assert np.mean(got == np.array(want)) > 0.5


def test_every_constraint_holds_and_every_token_is_there(docs_of):
    rng = np.random.default_rng(13)
    p = Packing(64, 5, 2000, shard_pieces=50)
    pairs = [(k, " ".join(["w"] * int(rng.integers(0, 200)))) for k in range(150)]
    rows = packing.pack(docs_of(pairs), params=p).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r.n_tokens)
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
    for b in bins.values():
        assert sum(b) <= 64 and len(b) <= 5 and sum(n * n for n in b) <= 2000
    for i, t in pairs:
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(t.split())
    assert len({r.shard for r in rows}) > 1
    full = {r.bin_id: r.bin_tokens for r in rows}
    assert all(full[b] == sum(n) for b, n in bins.items())


def test_how_the_table_is_stored_doesnt_matter(docs_of):
    frame = docs_of([(k, "word " * (k % 17)) for k in range(80)])
    a, b = (sorted(tuple(r) for r in packing.pack(f, params=Packing(20, 4, 400)).collect()) for f in (frame, frame.repartition(7)))
    assert a == b


def test_tokens():
    texts = ["One, two!", None, "", "  ", "a-b #3", "漢字 x"]
    loop = [len(re.findall(r"[A-Za-z0-9é]+|漢|字|[^\w\s]", t or "")) for t in texts]
    assert packing.token_counts(pa.array(texts, pa.string())).tolist() == loop


def test_odd_and_empty(odd, empty):
    rows = packing.pack(odd).collect()
    n = Counter(r.doc_id for r in rows)
    assert n[1] == n[2] == n[3] == 0 and n[6] == 2 and n[None] == 1 and n[4] > 5
    assert packing.pack(empty).count() == 0


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file here")
def test_the_query_packs_tokens_of_the_vocabulary(docs_of, spark, tmp_path):
    rng = np.random.default_rng(21)
    run = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 20_000))
    frame = docs_of([(1, "Packing counts subword tokens, not words: antidisestablishmentarianism!"), (2, run), (3, "ภาษาไทย" * 300), (4, None), (5, ""), (6, " \n ")])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got, full = Counter(), Counter()
    for r in queries.op3_best_fit_packing(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.n_tokens
        full[r.bin_id] += r.n_tokens
    want = {r.doc_id: r.n_tokens for r in bpe.encode(frame, bpe.load(queries.VOCABULARY)).collect() if r.n_tokens}
    assert got == want and want[2] > 4096
    assert max(full.values()) <= 4096


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file here")
def test_each_capacity_of_the_query_binds(docs_of, spark, tmp_path):
    """Through the query: some bins have room for a piece by tokens and documents and not by attention, and vice versa."""
    rng = np.random.default_rng(26)
    sizes = [*rng.integers(2000, 9000, 60), *rng.integers(1, 60, 3000), *rng.integers(60, 1500, 200)]
    docs_of([(k, "a " * int(n)) for k, n in enumerate(sizes)]).write.parquet(f"{tmp_path}/documents.parquet")
    bins = defaultdict(list)
    for r in queries.op3_best_fit_packing(spark, str(tmp_path)).collect():
        bins[r.bin_id].append(r.n_tokens)
    p = Packing()
    used = [(sum(b), len(b), sum(n * n for n in b)) for b in bins.values()]
    assert all(t <= p.tokens and d <= p.documents and a <= p.attention for t, d, a in used)
    smallest = min(n for b in bins.values() for n in b)
    closed = [(t + smallest > p.tokens, d + 1 > p.documents, a + smallest**2 > p.attention) for t, d, a in used]
    for k in range(3):
        assert any(c[k] for c in closed)
    # without the capacity for attention the bins would be others
    free = packing.best_fit(np.sort([n for b in bins.values() for n in b])[::-1], Packing(attention=p.tokens**2))
    assert max(np.bincount(free, np.sort([n * n for b in bins.values() for n in b])[::-1])) > p.attention
