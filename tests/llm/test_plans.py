import re

from harrow.llm import ppm


def test_trie_is_priced_in_small_plans(spark, monkeypatch):
    joins, priced = [], []

    def written(df, name, *args, own=ppm.written, **kw):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.append(len(re.findall(r"\bJoin (?:Inner|LeftOuter)", plan)))
        out = own(df, name, *args, **kw)
        if name == "costs":
            priced.append(out.count())
        return out

    monkeypatch.setattr(ppm, "written", written)
    docs = [(i, " ".join(f"word{i % k} {i * k}" for k in range(2, 9))) for i in range(60)]
    assert ppm.score(spark.createDataFrame(docs, "doc_id long, text string")).count() == 60
    assert 0 < max(joins) <= 10
    # strings of training rows are priced first and go no further
    assert len(priced) == 4 and priced == sorted(priced, reverse=True) and priced[1] < priced[0] / 2
