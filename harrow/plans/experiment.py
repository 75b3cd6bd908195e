"""Experiments: dataset, pipeline, metrics, files; batches can be resumed and written again without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow import schema
from harrow.operators import datasets, metrics
from harrow.plans.config import DatasetConfig, ExperimentConfig, SwdeConfig, WebsrcConfig
from harrow.plans.pipelines import create_pipeline
from harrow.sources import readers, sinks


def create_dataset(spark: SparkSession, config: DatasetConfig) -> DataFrame:
    """Samples with their place idx."""
    if isinstance(config, SwdeConfig):
        labels = datasets.domain(readers.swde_labels(spark, config.labels_path), config.domain)
        samples = datasets.swde_samples(labels, readers.swde_files(spark, config.html_path)).drop("domain")
    elif isinstance(config, WebsrcConfig):
        samples = datasets.websrc_samples(readers.websrc_questions(spark, config.questions_path), readers.websrc_pages(spark, config.pages_path))
    else:
        raise ValueError(f"no dataset {config.name!r}")
    return datasets.indexed(samples, "id")


class Experiment:
    """run() computes what is missing and returns the results.

    Predictions lie in a folder for each batch, so a batch is there or not; metrics are computed from all
    predictions, never from what this run added.
    """

    def __init__(self, spark: SparkSession, config: ExperimentConfig, samples: DataFrame | None = None, **parts):
        self.spark, self.config = spark, config
        self.samples = samples if samples is not None else create_dataset(spark, config.dataset)
        self.pipeline = create_pipeline(config.pipeline, **parts)
        self.path = f"{config.output_dir.rstrip('/')}/{config.name}"

    def done(self) -> int:
        """The last batch that is complete; -1 for none."""
        state = sinks.read_json(self.spark, f"{self.path}/checkpoint.json")
        return state["last_batch"] if state else -1

    def batches(self) -> DataFrame:
        placed = self.samples
        if self.config.dataset.shuffle:
            placed = datasets.shuffled(placed, self.config.seed)
            return datasets.batches(placed, self.config.dataset.batch_size, "pos").drop("pos", "idx")
        return datasets.batches(placed, self.config.dataset.batch_size).drop("idx")

    def run(self, resume: bool = False, batches_each: int | None = None) -> dict:
        """batches_each: batches that are written together before the checkpoint moves on; all by default."""
        log = sinks.tracker(self.config.tracker, f"{self.path}.tracker.jsonl", self.config.to_dict())
        try:
            todo = self.batches()
            last = self.done() if resume else -1
            n = todo.agg(F.max("batch_id")).first()[0]
            step = batches_each or (n + 1 if n is not None else 1)
            at = last + 1
            if not resume:
                sinks.write_json(self.spark, {"last_batch": -1}, f"{self.path}/checkpoint.json")
            while n is not None and at <= n:
                part = todo.where(F.col("batch_id").between(at, at + step - 1))
                sinks.write_predictions(self.pipeline.transform(part), f"{self.path}/predictions")
                at += step
                sinks.write_json(self.spark, {"last_batch": min(at - 1, n)}, f"{self.path}/checkpoint.json")
                log.log({"batches": min(at, n + 1)}, at)
            results = self.results(n)
            sinks.write_json(self.spark, results, f"{self.path}/results.json")
            sinks.write_json(self.spark, self.config.to_dict(), f"{self.path}/experiment_config.json")
            log.log(results)
            return results
        finally:
            log.finish()

    def predictions(self, n: int | None = None) -> DataFrame:
        columns = schema.PREDICTION.add("batch_id", "long") if "batch_id" not in schema.PREDICTION.names else schema.PREDICTION
        df = self.spark.read.schema(columns).json(f"{self.path}/predictions")
        return df if n is None else df.where(F.col("batch_id") <= n)

    def results(self, n: int | None) -> dict:
        out = {}
        if n is None:
            return out
        for name in self.config.dataset.metrics:
            m = metrics.metric(name)
            rows = m.per_sample(self.predictions(n))
            out[name] = m.aggregate(rows).first().asDict()
            if name == "page_level_f1":
                sf = metrics.by_site_field(metrics.counters(rows))
                out[name] |= {"website_aggregated_results": [r.asDict() for r in metrics.by_website(sf).collect()], "field_aggregated_results": [r.asDict() for r in metrics.by_field(sf).collect()]}
                sinks.write_samples(metrics.page_samples(self.predictions(n)), self.path, name)
            else:
                sinks.write_samples(rows.withColumn("evaluation", F.create_map(*(x for c in ("f1", "precision", "recall") for x in (F.lit(c), F.col(c))))), self.path, name)
        return out
