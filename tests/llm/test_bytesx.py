import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import bytesx as X

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.none() | st.text("aB é\n\t日", max_size=12), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words(texts):
    data, offsets = X.texts(pa.array(texts, pa.string()))
    starts, ends, row = X.words(data, offsets)
    got = [[] for _ in texts]
    for a, b, r in zip(starts, ends, row, strict=True):
        got[r].append(data[a:b].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in texts]
    h = X.span_hash(X.prefix(data), starts, ends)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


@given(st.lists(st.integers(0, 20), max_size=30), st.integers(1, 9))
def test_sliding_min(xs, w):
    x = np.array(xs, np.uint64)
    if len(x) >= w:
        assert X.sliding_min(x, w).tolist() == [min(xs[i : i + w]) for i in range(len(xs) - w + 1)]


def test_pieces_cover_all_texts():
    random.seed(1)
    texts = ["x" * random.choice([0, 1, 50, 500]) for _ in range(60)]
    data, offsets = X.texts(pa.array(texts).slice(3))
    out = []
    for first, end, d, o in X.pieces(data, offsets, 200):
        assert first == len(out) and end > first
        out += [d[a:b].tobytes().decode() for a, b in zip(o[:-1], o[1:], strict=True)]
    assert out == texts[3:]


def test_lower_and_runs():
    assert X.lower(np.frombuffer("AZaz[É".encode(), np.uint8)).tobytes().decode() == "azaz[É"
    assert [x.tolist() for x in X.runs(np.array([True, False, True, True]))] == [[0, 2], [1, 4]]
    assert X.covered(5, np.array([0, 3]), 2).tolist() == [True, True, False, True, True]
