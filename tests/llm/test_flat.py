import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import _flat

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab C1é!\n漢", max_size=30)), max_size=12)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_a_loop(texts):
    data, offsets = _flat.flat(pa.array(texts, pa.string()))
    starts, ends, row = _flat.words(data, offsets)
    got = [(int(r), bytes(data[s:e]).decode()) for r, s, e in zip(row, starts, ends, strict=True)]
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall("漢[abC1é]*|[abC1é]+", t or "")]
    assert got == want
    h = _flat.hashes(data, starts, ends)
    by = {}
    for (_, w), x in zip(want, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_a_range_longer_than_a_block_has_one_hash(monkeypatch):
    data = np.frombuffer(b"abc" * 5000, np.uint8)
    whole = _flat.hashes(data, np.array([0]), np.array([len(data)]))
    monkeypatch.setattr(_flat, "BLOCK", 1024)
    assert (_flat.hashes(data, np.array([0]), np.array([len(data)])) == whole).all()


def test_slices_cover_everything():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 100, "c"]})
    parts = list(_flat.slices(batch, "text", 12))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1
