"""Clients and scorers by configuration, pages that fail, predictions that are no texts, results by batch."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from harrow.functions import dom, udfs
from harrow.operators import datasets, metrics, rerank
from harrow.plans import models, pipelines
from harrow.plans.config import ExtractorConfig, LLMConfig, PipelineConfig, PreprocessorConfig
from harrow.streaming import evaluate

SAMPLES = "id string, content string, query string, ground_truth string, is_content_url boolean"


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            if len(seen) == 1:  # asked to wait once
                self.send_error(429)
                return
            said = json.dumps({"choices": [{"message": {"content": "said " + body["messages"][0]["content"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1", seen
    s.shutdown()


def test_client_of_a_configuration(server, monkeypatch):
    url, seen = server
    monkeypatch.delenv(models.KEY_VARIABLE, raising=False)
    assert isinstance(models.client_for(LLMConfig()), models.StubClient)
    for bad in (LLMConfig(source="hosted", model="m", base_url=url), LLMConfig(source="local", model="m"), LLMConfig(source="hosted", api_key="k")):
        with pytest.raises(ValueError):
            models.client_for(bad)
        with pytest.raises(ValueError):
            pipelines.RerankerPipeline(PipelineConfig(extractor=ExtractorConfig(llm=bad)))
        with pytest.raises(ValueError):
            pipelines.DirectPipeline(PipelineConfig(name="direct", extractor=ExtractorConfig(llm=bad)))
    call = models.client_for(LLMConfig(source="hosted", model="m", base_url=url, api_key="k", temperature=0.5)).open()
    assert call("hello") == "said hello" and len(seen) == 2
    path, key, body = seen[-1]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["model"] == "m" and body["temperature"] == 0.5
    for shown in (models.client_for(LLMConfig(source="local", model="m", base_url="u", api_key="hidden")), LLMConfig(api_key="hidden")):
        assert "hidden" not in repr(shown)


def test_a_page_that_fails_stays_in_its_row(spark, monkeypatch):
    deep = "<p>fine</p>"
    df = spark.createDataFrame([("a", deep, "{}", "{}", False), ("b", "bad", "{}", "{}", False), ("c", None, "{}", "{}", False)], SAMPLES)
    made = udfs.page_chunks(F.col("content"), {"extra_remove_tags": 5})  # no tuple: every page fails
    got = {r.id: r.m for r in df.select("id", made.alias("m")).collect()}
    assert all(m.texts is None and m.error.startswith("[ERROR TypeError]") for m in got.values())
    fails = PipelineConfig(preprocessor=PreprocessorConfig(extra_remove_tags=5))
    rows = rerank.exploded(pipelines.preprocessed(df, fails)).collect()
    assert sorted(r.chunkid for r in rows) == ["a-err", "b-err", "c-err"] and all(r.chunkcontent.startswith("[ERROR TypeError]") for r in rows)
    rows = {r.id: r for r in rerank.exploded(pipelines.preprocessed(df, PipelineConfig())).collect()}
    assert rows["a"].chunkid == "a-1" and "fine" in rows["a"].chunkcontent and rows["c"].chunkid is None


def test_rag_cleaning():
    page = "<div>a &lt;script&gt;x()&lt;/script&gt;&lt;b&gt;bold&lt;/b&gt; c</div>"
    assert dom.clean_html(page, keep_tags=False) == "a <script>x()</script><b>bold</b> c"
    assert dom.clean_html(page, keep_tags=False, rag=True) == "a bold c"


def test_scorer_of_a_model(spark):
    def load():
        return lambda texts: [(-0.1, -2.0) if "yes" in t.rpartition("<Document>: ")[2] else (None, -0.5) for t in texts]

    df = spark.createDataFrame([("q", "yes it is"), ("q", "other"), ("q", None)], "query string, chunk string")
    got = [r[0] for r in df.select(models.ModelScorer(load).score(F.col("query"), F.col("chunk"))).collect()]
    assert 0.8 < got[0] < 0.9 and got[1] < 0.001


def test_predictions_that_are_no_texts(spark):
    df = spark.createDataFrame([("a b", ["a", "b"], {"k": "a b"}, 3), ("a,b", ["a,b"], {"k": None}, None)], "ground_truth string, l array<string>, m map<string,string>, n int")
    lists = metrics.token_f1_samples(df, pred="l").collect()
    assert [r.f1 for r in lists] == [1.0, 1.0]  # ["a", "b"] is two tokens, ["a,b"] is one
    maps = metrics.token_f1_samples(df, pred="m").collect()
    assert (maps[0].precision, maps[0].recall) == (0.5, 1.0) and maps[1].f1 == 0.0  # k and b against b; a is an article
    assert [r.f1 for r in metrics.token_f1_samples(df, pred="n").collect()] == [0.0, 0.0]


def test_results_by_batch_are_those_of_all_rows_so_far(spark, tmp_path):
    data = [(f"s{i % 3}_{i:02d}", json.dumps({"x": i % 4, "y": "t"}), json.dumps({"x": i % 5, **({"y": "t"} if i % 2 else {})})) for i in range(23)]
    df = datasets.indexed(spark.createDataFrame(data, "id string, ground_truth string, prediction string"), "id")
    e = evaluate.Evaluator("token_f1", "page_level_f1")
    got = list(e.by_batches(df, 5))
    assert [b for b, _ in got] == [1, 2, 3, 4, 5]
    for b, results in got:
        upto = df.where(F.col("idx") < 5 * b)
        for name, values in results.items():
            m = metrics.metric(name)
            want = m.aggregate(m.per_sample(upto)).first().asDict()
            assert {k: pytest.approx(v) for k, v in want.items()} == values
    assert list(e.by_batches(df.where("idx < 0"), 5)) == []
    state = str(tmp_path / "state")
    metrics.counters(metrics.field_rows(df)).write.parquet(f"{state}/page_level_f1/batch=0")
    e.reset(spark, state)
    assert not (tmp_path / "state" / "page_level_f1").exists()
