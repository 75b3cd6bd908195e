from pyspark.sql import functions as F

from harrow.llm import mixing


def test_permutation_of_more_than_two_to_the_31(spark):
    for n in (2**31 + 11, 300_000_000_000):
        got = [r[0] for r in spark.range(2000).select(mixing.shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"))).collect()]
        assert len(set(got)) == 2000 and min(got) >= 0 and max(got) < n
        assert 0.4 < sum(x < n / 2 for x in got) / 2000 < 0.6
        steps = {b - a for a, b in zip(got, got[1:])}
        assert len(steps) > 1990  # no progression


def test_columns_that_clash_and_white_space(spark):
    texts = ["one\ntwo  three\tfour five\n\nsix seven " * 4, " a b\nc", None, "", "x"]
    data = [(i, t, s, i, i, i, i, i) for i, t in enumerate(texts) for s in ("p", "q", None)]
    names = "doc_id long, text string, source string, size long, taken long, id long, block long, k long"
    df = spark.createDataFrame(data, names)
    out = mixing.mixed(df, block_words=3).collect()
    assert out and out[0].asDict().keys() == {n.split()[0] for n in names.split(", ")}
    plan = {}
    for r in mixing.taken_words(*mixing.mix_plan(df, block_words=3)).collect():
        plan[r.id] = plan.get(r.id, 0) + r.taken
    got = {}
    for r in out:
        assert r.size == r.taken == r.id == r.block == r.k == r.doc_id
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        if r.doc_id == 0:
            assert not r.text.startswith((" ", "\n", "\t"))
            body, at = texts[0], 0
            for w in r.text.split():  # words in order, with the white space that stood before them
                at = body.index(w, at) + len(w)
            for gap in ("\n", "  ", "\t"):
                assert gap not in r.text or gap in body
    assert {i: n for i, n in plan.items() if n} == got
    assert any("\n" in r.text for r in out if r.doc_id == 0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(df).collect() == []
    assert mixing.taken_words(*mixing.mix_plan(df)).collect() == []
