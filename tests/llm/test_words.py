import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import words

TEXT = st.text(alphabet="ab Z\t\n\x0bé\U0001f600.", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_spans_and_hashes(texts):
    data, offs = words.text_bytes(pa.array(texts, pa.string()))
    low = words.LOWER[data]
    starts, ends, doc = words.spans(low, offs)
    fold = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall("[^\x20\x09-\x0d]+", fold(t or ""))]
    got = [(int(d), low[a:b].tobytes().decode()) for a, b, d in zip(starts, ends, doc)]
    assert got == want
    h = words.hashes(low, starts, ends)
    assert len({w for _, w in want}) == len(set(h.tolist())) == len({(w, x) for (_, w), x in zip(want, h.tolist())})
    sh, at = words.shingles(h, doc, len(texts), 3)
    for i in range(len(texts)):
        own = [w for j, w in want if j == i]
        assert len(set(sh[at == i].tolist())) == (len({tuple(own[k : k + 3]) for k in range(len(own) - 2)}) if len(own) >= 3 else int(bool(own)))


def test_hash_is_the_same_in_any_place(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 16)
    text = "short " + "x" * 40 + " short middle short " + "x" * 40
    data, offs = words.text_bytes(pa.array([text]))
    h = words.hashes(data, *words.spans(data, offs)[:2])
    assert h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3


def test_slices_cover_the_batch():
    batch = pa.record_batch([pa.array(["a" * n if n else None for n in (5, 0, 12, 3, 40)])], names=["t"])
    parts = list(words.slices(batch, 0, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1
    assert list(words.slices(batch.slice(0, 0), 0)) == []


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(1 << 16, dtype=np.uint64)
    assert len(np.unique(words.mix(x))) == len(x)
