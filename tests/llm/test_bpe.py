import base64
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import _flat, bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file here")


def one(v, text):
    part = bpe._Partition(v)

    part.add(pa.RecordBatch.from_pydict({"text": [text]}))
    ((_, tokens, _),) = part.encode()
    return tokens.tolist()


def slow(v, word):
    """The least rank of all neighbours is merged, the leftmost first."""
    ranks = {t: r for r, t in enumerate(v.tokens) if t}
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_words_against_the_slow_way():
    v = bpe.load()
    words = [w.encode() for w in ("aaaaaaaa", "abababababa", "hello", "   ", "indivisibilities", "çañéß", "漢字", "mississippi", "--------", "x", "")]
    data = np.frombuffer(b"".join(words), np.uint8)
    tokens, offsets = bpe.merge(data, np.concatenate([[0], np.cumsum([len(w) for w in words])]), v)
    assert [tokens[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [slow(v, w) for w in words]


@given(st.lists(st.binary(max_size=14).filter(bool), min_size=1, max_size=20))
@settings(max_examples=80, deadline=None)
def test_any_bytes_in_a_small_vocabulary(words):
    tokens = [bytes([b]) for b in range(256)] + [b"\x00\x00", b"\x01\x00", b"\x00\x00\x01", b"\x00\x01", b"\x01\x01", b"\x01\x01\x00\x00"]
    v = bpe.vocabulary([base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)])
    words = [bytes(b % 3 for b in w) for w in words]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    got, cuts = bpe.merge(data, offsets, v)
    back, _ = bpe.decode(got, cuts, v)
    assert back.tobytes() == data.tobytes()


def test_against_another_encoder(docs_of):
    tiktoken = pytest.importorskip("tiktoken")
    v = bpe.load()
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: r for r, t in enumerate(v.tokens) if t}, special_tokens={})
    rng = np.random.default_rng(14)
    letters = list("abcdefghij éüñ.,!'0123\n\t漢🙂")
    pairs = [(k, "".join(rng.choice(letters, rng.integers(0, 300)))) for k in range(200)] + [(900, "it's  we'll 's  \n\n x  ")]
    got = {r.doc_id: r for r in bpe.encode(docs_of(pairs), v, partition=2000).collect()}
    for i, t in pairs:
        assert got[i].tokens == other.encode_ordinary(t) and got[i].round_trip and got[i].n_tokens == len(got[i].tokens)


def test_round_trip_odd_and_empty(odd, empty):
    v = bpe.load()
    encoded = bpe.encode(odd, v)
    rows = encoded.collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].tokens is None and by[1].n_tokens == 0 and by[2].tokens == []
    back = sorted((r.doc_id or 0, r.text or "") for r in bpe.decode_tokens(encoded, v).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd.select("doc_id", "text").collect())
    assert bpe.encode(empty, v).count() == 0


def test_flat_words_of_a_large_column():

    data, offsets = _flat.flat(pa.array(["ab", None, "c"], pa.large_string()))
    assert bytes(data) == b"abc" and offsets.tolist() == [0, 2, 2, 3]


def test_counts_are_those_of_the_index():
    v = bpe.load()
    texts = ["", None, "Hello, world's end", "a" * 300_000, " " * 20_000 + "x", "!" * 50_000, "\n \t" * 2000, "漢字 É́ \x1c\x85 ​٣४ \U0001f600\U0001f468‍\U0001f469" * 50, " " * 511 + "b"]
    texts += [chr(k) + "x" + chr(k) + "1" + chr(k) + "!" for k in range(0, 0x110000, 97) if not 0xD800 <= k < 0xE000]
    assert bpe.reachable(v)
    fast, own = bpe.Counter(v, True), bpe.Counter(v, False)
    assert fast.counts(pa.array(texts)).tolist() == own.counts(pa.array(texts)).tolist()


def test_tokens_out_of_reach_are_found():
    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    reach = bpe.vocabulary([*lines, base64.b64encode(b"ab") + b" 256", base64.b64encode(b"abc") + b" 257"])
    apart = bpe.vocabulary([*lines, base64.b64encode(b"abc") + b" 256"])
    assert bpe.reachable(reach) and not bpe.reachable(apart)
    assert bpe.Counter(apart, bpe.reachable(apart)).counts(pa.array(["abc"])).tolist() == [3]
