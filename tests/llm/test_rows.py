import random

from harrow.llm import exact, near


def left(df):
    return sorted((tuple(r)[:2] for r in df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, source string").repartition(3)


def test_exact_copies_are_dropped_by_row(spark):
    data = [(5, "unique"), (5, "A"), (7, "A"), (7, "a"), (8, None), (8, ""), (None, "A"), (None, "b"), (None, "b"), (3, "c"), (3, "d")]
    got = left(exact.drop_exact(frame(spark, data)))
    norm = sorted(((i, (t or "").lower()) for i, t in got), key=repr)
    assert norm == sorted([(5, "unique"), (7, "a"), (8, ""), (None, "b"), (3, "c"), (3, "d")], key=repr)


def test_near_copies_are_dropped_by_row(spark):
    random.seed(3)
    a, b, c = (" ".join(f"{x}{random.randrange(99)}" for _ in range(60)) for x in "abc")
    data = [(1, a), (1, b), (1, b), (2, b + " end"), (3, c), (5, c), (5, a + " end"), (6, None), (6, None), (6, "z"), (None, c), (9, c + " x"), (9, c + " y")]
    groups = sorted((tuple(r) for r in near.near_groups(frame(spark, data)).collect()), key=repr)
    assert sorted((r[0], r[2], r[3]) for r in groups if r[0] is not None) == sorted(
        [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (5, 3, False), (5, 1, False), (6, 6, True), (6, 6, True), (6, 6, True), (9, 3, False), (9, 3, False)]
    )
    assert left(near.drop_near(frame(spark, data))) == sorted([(1, a), (1, b), (3, c), (6, None), (6, None), (6, "z"), (None, c)], key=repr)


def test_links_within_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = left(near.drop_near(frame(spark, [(4, text), (4, text + " x"), (4, text.upper())])))
    assert len(got) == 1 and got[0][0] == 4
