"""Near-duplicate groups around one text that a large part of the rows are edits of, against all pairs."""

import random

import numpy as np
import pytest

from harrow.llm import near


def edited(rng, base, edits, vocabulary):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return " ".join(words)


def brute(texts, k):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    least = list(range(len(texts)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [2_000, 60])
def test_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) + str(i) for i in range(120)]
    texts = [edited(rng, base, rng.randrange(12), vocabulary) for _ in range(330)]
    texts += [" ".join(base[: rng.randrange(80, 121)]) for _ in range(20)]  # no shingle of their own
    texts += [" ".join(rng.choice(vocabulary) for _ in range(100)) for _ in range(30)]
    rng.shuffle(texts)
    want = brute(texts, 4)
    assert len(set(want)) > 100
    assert np.bincount(want).max() > 100
    out = near.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(want))
