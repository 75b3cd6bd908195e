"""Writers: predictions by batch, per-sample metrics, results, and trackers."""

from __future__ import annotations

import json
import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines in a folder for each batch_id; writing a batch again replaces it."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy("batch_id").json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def sample_rows(df: DataFrame) -> DataFrame:
    """The six named fields of a per-sample row, as one JSON text."""
    fields = ("id", "query", "ground_truth", "prediction", "filtered_html", "evaluation")
    return df.select(F.to_json(F.struct(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))).alias("value"))


def write_samples(df: DataFrame, path: str, name: str, append: bool = False) -> None:
    sample_rows(df).write.mode("append" if append else "overwrite").text(f"{path}/metric/{name}_sample_eval")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small file, complete or not there: written beside and moved into place."""
    jvm, target, fs = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, default=str).encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(beside, target)


def read_json(spark: SparkSession, path: str) -> dict | None:
    _, target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


class Tracker(Protocol):
    def log(self, values: dict, step: int | None = None) -> None: ...

    def finish(self) -> None: ...


class JsonlTracker:
    """Lines in a file on the driver."""

    def __init__(self, path: str, config: dict | None = None):
        self.file = open(path, "a", buffering=1)  # noqa: SIM115 - closed by finish()
        self.log({"config": config or {}})

    def log(self, values: dict, step: int | None = None) -> None:
        self.file.write(json.dumps({"time": time.time(), "step": step, **values}, default=str) + "\n")

    def finish(self) -> None:
        self.file.close()


class NoTracker:
    def log(self, values: dict, step: int | None = None) -> None:
        pass

    def finish(self) -> None:
        pass


class _Wandb:
    def __init__(self, project: str, config: dict | None):
        import wandb

        self.run = wandb.init(project=project, config=config)

    def log(self, values, step=None):
        self.run.log(values, step=step)

    def finish(self):
        self.run.finish()


class _Mlflow:
    def __init__(self, project: str, config: dict | None):
        import mlflow

        self.m = mlflow
        mlflow.set_experiment(project)
        mlflow.start_run()
        mlflow.log_params(config or {})

    def log(self, values, step=None):
        self.m.log_metrics({k: v for k, v in values.items() if isinstance(v, int | float)}, step=step)

    def finish(self):
        self.m.end_run()


def tracker(name: str | None, where: str = "", config: dict | None = None) -> Tracker:
    """jsonl, wandb, mlflow (where installed) or None; ValueError for others."""
    makers = {"jsonl": JsonlTracker, "wandb": _Wandb, "mlflow": _Mlflow}
    if name is None:
        return NoTracker()
    if name not in makers:
        raise ValueError(f"no tracker {name!r}; there are {', '.join(makers)}")
    return makers[name](where, config)
