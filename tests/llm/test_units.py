"""Units without a cut, and units that do not decode to themselves, in the store's bounds."""

import time
import weakref

import sentencepiece
from public_tokenizers import path

from harrow.llm import pieces


def test_long_unit_takes_time_in_proportion():
    e = pieces.Encoder(open(path("piece_bpe_32k.model"), "rb").read())
    ref = sentencepiece.SentencePieceProcessor(model_file=str(path("piece_bpe_32k.model")))
    unit = "abcdefghijklmnopqrstuvwxyzthequickbrown" * 500
    assert e.encode(unit) == ref.encode(unit)
    seconds = []
    for n in (2_000, 8_000):
        unit = "abcdefghijklmnopqrstuvwxyzthequickbrown" * n
        began = time.process_time()
        e.encode(unit)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * seconds[0]  # 16 if it were quadratic


def test_odd_units_when_the_store_is_full(spark, monkeypatch):
    monkeypatch.setattr(pieces, "STORE_UNITS", 5)
    ref = sentencepiece.SentencePieceProcessor(model_file=str(path("piece_bpe_32k.model")))
    store = pieces._Store(pieces.Encoder(open(path("piece_bpe_32k.model"), "rb").read()))
    for text in ["▁a b ▁▁c", "x \U0001f9ff y", "▁", "plain words", *(f"w{i}▁{i} ▁q" for i in range(20))]:
        units = store.encoder.units(text)
        ids = list(map(int, " ".join(map(store.ids.__getitem__, units)).split()))
        assert ids == ref.encode(text)
        assert store.decoded(units)[1:] == ref.decode(ids)


def test_earlier_bytes_are_those_that_keep_first_removes(spark):
    import random

    from harrow.llm import suffix

    rng = random.Random(3)
    shared = ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(3)]
    texts = ["".join(rng.choice([*shared, "xyz" * 7, "q", "pqr"]) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    none = {r.doc_id: r for r in suffix.drop_repeated_bytes(df, length=30, keep="none", earlier=True).collect()}
    first = {r.doc_id: r for r in suffix.drop_repeated_bytes(df, length=30, keep="first", earlier=True).collect()}
    assert {i: r.n_earlier for i, r in none.items()} == {i: r.n_removed for i, r in first.items()} == {i: r.n_earlier for i, r in first.items()}
    assert any(r.n_removed > r.n_earlier for r in none.values())


def test_tasks_of_other_operators_drop_the_store():
    from harrow.llm import quality
    from harrow.llm.queries import tokenizer_bytes
    from harrow.llm.shared import slim

    def kept_after(task):
        store = pieces._store(tokenizer_bytes())
        store.ids["▁a"]
        held = weakref.ref(store)
        del store
        assert list(task()) == ["x"]
        return held() is not None

    assert kept_after(lambda: slim(iter, pieces.__name__)(["x"]))  # from task to task of its own
    assert not kept_after(lambda: slim(iter)(["x"]))
    assert not kept_after(lambda: quality.first_texts(iter([("x",)]), 1))


def test_encoding_after_the_store_was_dropped(spark):
    from harrow.llm import quality
    from harrow.llm.queries import tokenizer_bytes

    df = spark.createDataFrame([(i, f"a few words and {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    first = sorted(pieces.encode_texts(df, tokenizer_bytes()).collect())
    assert quality.quality(df).count() == 40  # in the same workers, which drop the store
    assert sorted(pieces.encode_texts(df, tokenizer_bytes()).collect()) == first
