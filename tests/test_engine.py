import json

import pytest
from pyspark.sql import functions as F

from harrow.operators import datasets, metrics, rerank
from harrow.plans import config as C
from harrow.plans import models
from harrow.plans.experiment import Experiment, create_dataset
from harrow.plans.pipelines import RerankerPipeline
from harrow.sources import readers, sinks
from harrow.streaming import evaluate


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_indexed_subset_stride_batches(spark):
    df = datasets.indexed(spark.range(100).repartition(7).withColumnRenamed("id", "k"), F.col("k").desc())
    assert rows(df.select("idx", "k"), "idx") == [(i, 99 - i) for i in range(100)]
    assert rows(datasets.subset(df, [3, 1, 3]).select("pos", "k"), "pos") == [(0, 96), (1, 98), (2, 96)]
    assert [r[0] for r in rows(datasets.stride(df, 30).select("idx"), "idx")] == list(range(0, 100, 3))
    assert rows(datasets.batches(df, 40).groupBy("batch_id").count(), "batch_id") == [(0, 40), (1, 40), (2, 20)]
    a, b = rows(datasets.shuffled(df, 1).select("pos", "idx"), "pos"), rows(datasets.shuffled(df, 1).select("pos", "idx"), "pos")
    assert a == b and sorted(x[1] for x in a) == list(range(100)) and [x[1] for x in a] != list(range(100))
    with pytest.raises(IndexError):
        datasets.get(df, 100)
    with pytest.raises(ValueError):
        datasets.domain(df, "none")


def test_rerank_edges(spark):
    df = spark.createDataFrame([("a", ["x y", "x", "z"]), ("b", []), ("c", None), ("d", ["q"])], "doc_id string, t array<string>")
    from harrow.functions import text as X

    e = rerank.exploded(df.select("doc_id", F.lit("x y").alias("query"), X.chunk_structs("doc_id", "t").alias("chunks")))
    s = rerank.normalised(rerank.scored_chunks(e, rerank.lexical_score(F.col("query"), F.col("chunkcontent"))))
    got = {(r.doc_id, r.pos): r.score_norm for r in s.collect()}
    assert got[("a", 0)] == 1.0 and got[("a", 1)] == 0.5 and got[("a", 2)] == 0.0 and got[("b", None)] is None and got[("d", 0)] != got[("d", 0)]
    out = {r.doc_id: (r.chunks_kept, r.full_content) for r in rerank.regrouped(rerank.above(s), carry=("query",)).collect()}
    assert out == {"a": (["x y", "x"], "x y\nx"), "b": ([], ""), "c": ([], ""), "d": (["q"], "q")}
    assert rows(rerank.top_k(s.where("pos is not null"), 1).select("doc_id", "pos"), "doc_id") == [("a", 0), ("d", 0)]


def test_page_metric(spark):
    data = [("s_1", '{"a": "x", "b": null}', '{"a": "X", "b": null}'), ("s_2", '{"a": "x"}', "{}"), ("t_1", '{"a": "1"}', '{"a": 1}'), ("t_2", '{"a": "y"}', None)]
    df = spark.createDataFrame(data, "id string, ground_truth string, prediction string")
    c = metrics.counters(metrics.field_rows(df))
    assert rows(c, "website", "field") == [("s", "a", 1, 2, 2), ("s", "b", 1, 0, 0), ("t", "a", 1, 1, 2)]
    sf = {(r.website, r.field): (r.precision, r.recall) for r in metrics.by_site_field(c).collect()}
    assert sf == {("s", "a"): (0.5, 0.5), ("s", "b"): (0.0, 0.0), ("t", "a"): (1.0, 0.5)}
    assert metrics.overall(metrics.by_site_field(c)).first().precision == pytest.approx((0.25 + 1.0) / 2)
    assert json.loads(metrics.result_json(metrics.overall(metrics.by_site_field(c))).first()[0])["f1"]["average"] > 0
    with pytest.raises(KeyError):
        metrics.metric("none")


def test_empty_means(spark):
    assert tuple(metrics.means(spark.createDataFrame([], "f1 double, precision double, recall double")).first()) == (0.0, 0.0, 0.0)


def sample_frame(spark, n=10):
    data = [(f"s{i % 2}_{i}", f"<html><h1>Title {i}</h1><p>text {i}</p></html>", '{"title": ""}', json.dumps({"title": f"Title {i}" if i % 3 else "other"})) for i in range(n)]
    return readers.frame(spark, [dict(zip(("id", "content", "query", "ground_truth"), r, strict=True)) for r in data])


def test_pipeline_and_fetch(spark):
    out = RerankerPipeline(C.PipelineConfig()).transform(sample_frame(spark))
    assert {r.id: json.loads(r.prediction)["title"] for r in out.collect()}["s1_3"] == "Title 3"

    def fetch(url):
        if "bad" in url:
            raise OSError("gone")
        return "<h1>Got</h1>"

    urls = readers.frame(spark, [{"id": "a", "content": "http://x", "query": "{t}"}, {"id": "b", "content": "http://bad", "query": "{t}"}, {"id": "c", "content": None, "query": "{t}"}])
    assert rows(readers.fetched(urls, fetch).select("content")) == [("<h1>Got</h1>",), ("[FETCH_ERROR] gone",), (None,)]


def test_experiment_resumes(spark, tmp_path):
    base = indexed = datasets.indexed(sample_frame(spark), "id")
    cfg = C.ExperimentConfig("e", C.DatasetConfig(batch_size=3, metrics=("page_level_f1", "token_f1")), tracker="jsonl", output_dir=str(tmp_path))
    once = Experiment(spark, cfg, indexed).run()
    again = C.ExperimentConfig("r", cfg.dataset, output_dir=str(tmp_path))

    class Failing(models.StubClient):
        pass

    e = Experiment(spark, again, base)
    todo = e.batches()
    sinks.write_predictions(e.pipeline.transform(todo.where("batch_id <= 1")), f"{e.path}/predictions")  # ended after batch 1, checkpoint at 0
    sinks.write_json(spark, {"last_batch": 0}, f"{e.path}/checkpoint.json")
    assert e.run(resume=True, batches_each=1) == once
    assert e.predictions().count() == 10 and e.done() == 3
    assert once["page_level_f1"]["precision"] == pytest.approx(0.6, abs=0.2)
    saved = sinks.read_json(spark, f"{e.path}/experiment_config.json")
    assert "output_dir" not in saved and readers.sample_evaluations(spark, f"{e.path}/metric/token_f1_sample_eval").count() == 10


def test_configs():
    with pytest.raises(ValueError):
        C.ExperimentConfig(" ", C.DatasetConfig())
    with pytest.raises(ValueError):
        C.ExperimentConfig("x", C.DatasetConfig(), seed=-1)
    with pytest.raises(ValueError):
        C.LLMConfig(source="x")
    with pytest.raises(ValueError):
        C.WebsrcConfig(pages_path="a.csv")
    cfg = C.PipelineConfig(disable_method=True)
    assert cfg.effective().extractor.disable_reranker and not cfg.extractor.disable_reranker
    assert C.to_dict(C.LLMConfig(api_key="k"))["api_key"] == "***"
    grid = C.ablation_grid(C.ExperimentConfig("a", C.DatasetConfig()), C.SwdeConfig(), C.WebsrcConfig())
    assert len(grid) == 18 and sum(c.pipeline.disable_method for c, _ in grid) == 9 and grid[0][1] == 35


def test_readers(spark, tmp_path):
    (tmp_path / "book" / "book-site(2)").mkdir(parents=True)
    (tmp_path / "book" / "book-site(2)" / "0001.htm").write_text("<p>é</p>", encoding="utf-8")
    labels = spark.createDataFrame([("site_0001", "site", "{}", "{}"), ("site_0002", "site", "{}", "{}")], "website_id string, website_name string, schema string, gt string")
    labels.coalesce(1).write.parquet(str(tmp_path / "l"))
    import glob
    import os

    os.rename(glob.glob(str(tmp_path / "l" / "*.parquet"))[0], str(tmp_path / "l" / "book-0.parquet"))
    cfg = C.SwdeConfig(labels_path=str(tmp_path / "l"), html_path=str(tmp_path / "book"))
    assert rows(create_dataset(spark, cfg).select("id", "content"), "id") == [("site_0001", "<p>é</p>"), ("site_0002", None)]
    (tmp_path / "p.jsonl").write_text('{"id": "1", "website": "w", "html": "first", "domain": "auto"}\n{"id": "1", "website": "w", "html": "second", "domain": "auto"}\n')
    (tmp_path / "q.jsonl").write_text('{"id": "au000000100", "question": "q", "answer": "a"}\n{"id": "zz000000100", "question": "q", "answer": "a"}\n')
    ws = C.WebsrcConfig(pages_path=str(tmp_path / "p.jsonl"), questions_path=str(tmp_path / "q.jsonl"))
    assert rows(create_dataset(spark, ws).select("id", "content"), "id") == [("au000000100", "first"), ("zz000000100", None)]
    assert readers.prediction_rows("[1, {'id': 2}]") == [{"id": None, "query": None, "ground_truth": None, "prediction": "1", "filtered_html": None}, {"id": "2", "query": None, "ground_truth": None, "prediction": None, "filtered_html": None}]
    assert len(readers.prompts()) == 6


def test_retry():
    waits, n = [], [0]

    def call(p):
        n[0] += 1
        if n[0] < 4:
            raise models.RateLimited
        return p

    assert models.with_retry(call, sleep=waits.append)("x") == "x" and len(waits) == 3 and 0.5 <= waits[0] <= 1.0


def test_streams_agree_with_batches(spark, tmp_path):
    data = [(f"s{i % 2}_{i}", json.dumps({"a": f"word {i}"}), json.dumps({"a": f"word {i if i % 3 else 0}"})) for i in range(20)]
    df = spark.createDataFrame(data, "id string, ground_truth string, prediction string")
    df.repartition(4).write.json(str(tmp_path / "in"))
    e = evaluate.Evaluator("token_f1", "page_level_f1")
    once = {k: v.first().asDict() for k, v in e.evaluate(df).items()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = e.stream(stream, str(tmp_path / "state"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    now = e.current(spark, str(tmp_path / "state"))
    for k in once:
        assert now[k] == pytest.approx(once[k])
    last = list(e.by_batches(datasets.indexed(df, "id"), 8))
    assert [b for b, _ in last] == [1, 2, 3] and last[-1][1]["token_f1"] == pytest.approx(once["token_f1"])
    assert e.samples(df).count() == 40
