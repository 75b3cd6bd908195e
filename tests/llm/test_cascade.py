import random

import numpy as np
import pyarrow as pa

from harrow.llm import bytesx as X
from harrow.llm import quality

COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_lower", "n_lines", "n_dup_lines", "n_stutter", "n_repeat_words")


def texts(values):
    return quality.Texts(*X.texts(pa.array(values, pa.string())))


def test_counts_are_taken_on_what_is_left_only(monkeypatch):
    good, marks, few = "one two three four five six " * 5, "wow! " * 25, "few"
    seen = {}
    for name in ("n_marks", "n_upper", "n_stutter"):
        of = getattr(quality.Texts, "_" + name)
        monkeypatch.setattr(quality.Texts, "_" + name, lambda self, of=of, name=name: seen.setdefault(name, []).append(len(self)) or of(self))
    rules = [quality.BASE_RULES[0], *(r for r in quality.RULES if r.name in ("exclamation", "capitals", "stutter"))]
    verdict = quality.cascade(texts([good] * 7 + [marks] * 2 + [few]), rules, np.ones(10, bool))
    assert verdict.tolist() == [True] * 7 + [False] * 3 and seen == {"n_marks": [9], "n_upper": [7], "n_stutter": [7]}


def test_counts_of_views_and_copies_are_those_of_their_texts():
    random.seed(1)
    values = ["".join(random.choices(["a ", "a ", "B", "é ", "\n", "! ", "#"], k=random.randint(0, 60))) for _ in range(40)] + [None, "", "x\nx\nx"]
    for first in ((), ("n_words",), ("n_stutter", "n_lines")):
        t = texts(values)
        for name in first:
            t.get(name)
        flags = np.array([random.random() < 0.7 for _ in values])
        view = quality._view(t, flags)
        view.get("n_marks")
        again = quality._view(view, np.arange(len(view)) % 3 > 0)
        left = [v for v, f in zip(values, flags, strict=True) if f]
        for got, want in ((view, left), (again, [v for i, v in enumerate(left) if i % 3])):
            assert all((got.get(c) == texts(want).get(c)).all() for c in COUNTS) and len(got) == len(want)


def test_shared_work_is_charged_once(monkeypatch):
    import time

    t = texts(["word " * 30] * 20 + ["few"] * 10 + ["wow! " * 30] * 10)
    words = quality.Texts._words
    monkeypatch.setattr(quality.Texts, "_words", lambda self: (time.sleep(0.2), words(self))[1])
    rules = (*quality.BASE_RULES, *(r for r in quality.RULES if r.name in ("exclamation", "stutter")))
    fresh = quality.Timed(t.data, t.offsets)
    quality._repetition(fresh)
    assert fresh.seconds["words"] > 0.2 > fresh.seconds["n_repeat_words"] and fresh.seconds["n_words"] < 0.2
    # all rest on the words; after the first of them the others cost little, and one that rejects nothing more is last
    order = quality.measured_order(rules, t)
    assert sorted(order) == sorted(r.name for r in rules) and order.index("exclamation") < 3
    nothing = quality.Rule("nothing", lambda x: np.zeros(len(x), bool))
    assert quality.measured_order((nothing, *rules), t).index("nothing") >= 2


def test_sample_is_of_several_partitions(spark):
    df = spark.range(1000).repartitionByRange(40, "id").selectExpr("cast(id as string) as text")
    got = [int(x) for x in quality.sampled_texts(df, "text")]
    assert len(got) == 256 and len({x // 25 for x in got}) >= 14
    assert quality.sampled_texts(df.where("text = ''").coalesce(1), "text") == []
    assert quality.filter_quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []
