import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from salesgrid.llm import textops

from .helpers import words

TEXT = st.one_of(st.none(), st.text(st.sampled_from(list("aAbé \t\n\x0b\x0c\r\x1c\xa0日.")), max_size=30))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = textops.words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [w.text(j, j + 1) for j in range(w.first[i], w.first[i + 1])] == words(t)
    known = {}
    for h, j in zip(w.hash.tolist(), range(len(w.hash))):
        assert known.setdefault(h, w.text(j, j + 1)) == w.text(j, j + 1)
    assert len(known) == len({w.text(j, j + 1) for j in range(len(w.hash))})


def test_lower_case_is_ascii_only():
    w = textops.words(pa.array(["ABC abc É é"]), lower=True)
    assert w.hash[0] == w.hash[1] and w.hash[2] != w.hash[3]


def test_chunks_and_slices_do_not_change_hashes(monkeypatch):
    texts = pa.array(["aa bb " * 50, None, "", "x" * 200, "cc aa"])
    whole = textops.words(texts)
    monkeypatch.setattr(textops, "CHUNK_BYTES", 16)
    again = textops.words(texts)
    assert (whole.hash == again.hash).all() and (whole.first == again.first).all()
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [textops.words(p.column(0)).hash.tolist() for p in textops.slices(batch, limit=50)]
    assert sum(parts, []) == whole.hash.tolist()


def test_sums_with_empty_rows():
    import numpy as np
    flags = np.array([True, False, True, True])
    assert textops.sums(flags, np.array([0, 0, 1, 1, 4, 4])).tolist() == [0, 1, 0, 2, 0]
