"""Shards that are too large for a task give what small ones give."""

import random

import pytest

from harrow.llm import anchors, automaton, suffix


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(9)]
    hot = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for _ in range(60):
        own = [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(2)]
        texts.append(f"{own[0]} {hot} {own[1]}" if rng.random() < 0.8 else own[0])
    texts += [texts[3], texts[3], None, ""]
    return spark.createDataFrame([(i if i % 17 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)


def results(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_bytes(docs, monkeypatch, keep):
    used = []
    of = anchors.spans_by_window
    monkeypatch.setattr(anchors, "spans_by_window", lambda *a: used.append(1) or of(*a))
    run = lambda: results(suffix.drop_repeated_bytes(docs, length=40, keep=keep, earlier=True))
    want = run()
    assert not used
    monkeypatch.setattr(suffix, "SHARD_BYTES", 300)
    assert run() == want and used


def test_words(docs, monkeypatch):
    used = []
    of = anchors.spans_by_window
    monkeypatch.setattr(anchors, "spans_by_window", lambda *a: used.append(1) or of(*a))
    run = lambda: results(automaton.drop_repeated_words(docs, window=8))
    want = run()
    assert not used
    monkeypatch.setattr(automaton, "SHARD_BYTES", 400)
    assert run() == want and used
