"""Incremental evaluation: sums by batch, on bounded tables and on streams.

A batch's part of the state is one row (token F1) or one row for each website and field (page level).  A stream
writes the part of each micro-batch in a folder of its own, so a batch that is run again replaces its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.operators import datasets, metrics

SUMS = "n long, f1 double, precision double, recall double"


def partial_sums(samples: DataFrame, *by: str) -> DataFrame:
    """n and sums of f1, precision, recall of per-sample rows."""
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("f1", "precision", "recall")]
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def merged(parts: DataFrame) -> DataFrame:
    """Averages from partial sums."""
    n = F.sum("n")
    return parts.agg(*(F.coalesce(F.try_divide(F.sum(c), n), F.lit(0.0)).alias(c) for c in ("f1", "precision", "recall")))


def running(samples: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, f1, precision, recall of all batches up to each: a sum by batch, then a running one over the batches."""
    so_far = W.orderBy(batch).rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = partial_sums(samples, batch)
    return parts.select(batch, *(F.try_divide(F.sum(c).over(so_far), F.sum("n").over(so_far)).alias(c) for c in ("f1", "precision", "recall")))


class Evaluator:
    """Metrics by name over predictions: at once, by batches, or on a stream."""

    def __init__(self, *names: str):
        self.metrics = [metrics.metric(n) for n in names]

    def evaluate(self, predictions: DataFrame) -> dict[str, DataFrame]:
        return {m.name: m.aggregate(m.per_sample(predictions)) for m in self.metrics}

    def samples(self, predictions: DataFrame) -> DataFrame:
        """Per-sample rows of all metrics, as JSON, with the metric's name; each once."""
        out = None
        for m in self.metrics:
            rows = m.per_sample(predictions)
            part = rows.select(F.lit(m.name).alias("metric"), F.col("id"), F.to_json(F.struct(*rows.columns)).alias("row"))
            out = part if out is None else out.union(part)
        return out

    def by_batches(self, predictions: DataFrame, size: int = 256, place: str = "idx"):
        """(batch number from 1, {metric: results so far}), the last batch may be short.

        Rows are scored once; what comes to the driver is each batch's part of the state.
        """
        placed = datasets.batches(predictions, size, place)
        parts = []
        for m in self.metrics:
            if m.name == "token_f1":
                rows = running(m.per_sample(placed)).orderBy("batch_id")
                parts.append(({k: r[k] for k in ("f1", "precision", "recall")} for r in rows.toLocalIterator()))
            else:
                parts.append(_page_level(metrics.counters(metrics.field_rows(placed, carry=("batch_id",)), "batch_id"), placed))
        for b, results in enumerate(zip(*parts, strict=True), 1):
            yield b, {m.name: r for m, r in zip(self.metrics, results, strict=True)}

    def stream(self, predictions: DataFrame, state: str, checkpoint: str):
        """Starts a query that adds each micro-batch of a streaming DataFrame to the state; current() reads it."""

        def add(batch: DataFrame, number: int) -> None:
            for m in self.metrics:
                rows = m.per_sample(batch)
                part = partial_sums(rows) if m.name == "token_f1" else metrics.counters(rows)
                part.coalesce(1).write.mode("overwrite").parquet(f"{state}/{m.name}/batch={number}")

        return predictions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()

    def current(self, spark: SparkSession, state: str) -> dict[str, dict]:
        """Results of all micro-batches in the state."""
        out = {}
        for m in self.metrics:
            parts = spark.read.parquet(f"{state}/{m.name}")
            if m.name == "token_f1":
                out[m.name] = merged(parts).first().asDict()
            else:
                total = parts.groupBy("website", "field").agg(*(F.sum(c).alias(c) for c in ("page_hits", "extracted_pages", "ground_truth_pages")))
                out[m.name] = metrics.overall(metrics.by_site_field(total)).first().asDict()
        return out


    def reset(self, spark: SparkSession, state: str) -> None:
        """Forgets all micro-batches in the state."""
        for m in self.metrics:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/{m.name}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _page_level(parts: DataFrame, placed: DataFrame):
    """The page-level results of all batches up to each, from the counters (batch_id, website, field) of each."""
    names = ("page_hits", "extracted_pages", "ground_truth_pages")
    last = placed.agg(F.max("batch_id")).first()[0]
    rows = parts.orderBy("batch_id").toLocalIterator()
    row = next(rows, None)
    total: dict[tuple, list[int]] = {}  # one entry for each website and field
    for b in range(0, (last if last is not None else -1) + 1):
        while row is not None and row.batch_id <= b:
            have = total.setdefault((row.website, row.field), [0, 0, 0])
            for i, n in enumerate(names):
                have[i] += row[n]
            row = next(rows, None)
        sites: dict[str, list[tuple[float, float, float]]] = {}
        for (site, _), (hits, extracted, gold) in total.items():
            none = not extracted or not gold
            p, r = (0.0, 0.0) if none else (hits / extracted, hits / gold)
            sites.setdefault(site, []).append((2 * p * r / (p + r) if p + r else 0.0, p, r))
        means = [[sum(x) / len(fields) for x in zip(*fields, strict=True)] for fields in sites.values()]
        yield dict(zip(("f1", "precision", "recall"), (sum(x) / len(means) for x in zip(*means, strict=True)), strict=True)) if means else dict.fromkeys(("f1", "precision", "recall"), 0.0)


def stop_on_signal(query) -> None:
    """SIGINT and SIGTERM stop a streaming query after its batch."""
    import signal

    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: query.stop())
