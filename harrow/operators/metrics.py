"""Metrics as pairs of functions: per_sample(predictions) and aggregate(per-sample rows).

All state is sums and counts, so partial results add up: batches, streams and one-shot runs agree.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from harrow.functions import text as X
from harrow.functions import udfs


@dataclass(frozen=True)
class Metric:
    name: str
    per_sample: Callable[[DataFrame], DataFrame]
    aggregate: Callable[[DataFrame], DataFrame]


METRICS: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    METRICS[metric.name] = metric
    return metric


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise KeyError(f"no metric {name!r}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name]


# token_f1


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text: lists, objects and maps as JSON, other values as they are spelt."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return F.col(name)
    return udfs.json_text(F.to_json(name, {"ignoreNullFields": "false"})) if isinstance(kind, (ArrayType, MapType, StructType)) else F.col(name).cast("string")


def token_f1_samples(df: DataFrame, gold: str = "ground_truth", pred: str = "prediction") -> DataFrame:
    """Adds f1, precision, recall: multiset overlap of normalised tokens.  A null text has no tokens."""
    s = X.token_scores(F.col("gold__"), F.col("pred__"))
    out = df.withColumn("gold__", X.squad_tokens(as_text(df, gold))).withColumn("pred__", X.squad_tokens(as_text(df, pred))).withColumn("s__", s)
    return out.select(*df.columns, "s__.f1", "s__.precision", "s__.recall")


def token_f1_long(df: DataFrame, key: str, gold: str = "ground_truth", pred: str = "prediction") -> DataFrame:
    """key, f1, precision, recall for long texts: tokens are counted by group instead of within the row."""

    def counted(c: str, name: str) -> DataFrame:
        return df.select(key, F.explode(X.squad_tokens(c)).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias(name))

    shared = counted(gold, "g").join(counted(pred, "p"), [key, "t"], "full").groupBy(key).agg(
        F.sum(F.least(F.coalesce("g", F.lit(0)), F.coalesce("p", F.lit(0)))).alias("n"), F.sum(F.coalesce("g", F.lit(0))).alias("g"), F.sum(F.coalesce("p", F.lit(0))).alias("p")
    )
    out = df.select(key).join(shared, key, "left").na.fill(0, ["n", "g", "p"])
    both, none = (F.col("g") == 0) & (F.col("p") == 0), (F.col("n") == 0)
    precision, recall = F.try_divide(F.col("n").cast("double"), "p"), F.try_divide(F.col("n").cast("double"), "g")

    def score(x):
        return F.when(both, 1.0).when(none, 0.0).otherwise(x)

    return out.select(key, score(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), score(precision).alias("precision"), score(recall).alias("recall"))


def means(df: DataFrame) -> DataFrame:
    """f1, precision, recall averaged over rows; failures count as 0, no rows give 0."""
    return df.agg(*(F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).alias(c) for c in ("f1", "precision", "recall")))


# page_level_f1


def field_rows(df: DataFrame, fuzzy: float | None = None, strict: bool = False, carry: tuple[str, ...] = (), unescape: Callable[[str], str] = html.unescape) -> DataFrame:
    """id, website, field, hit, extracted, in_gold and the columns in carry: one row for each field of the gold object.

    A field that the prediction lacks counts as extracted, an explicit null does not; null in both is a hit.
    strict: that is no hit.  unescape: reads the character references of gold texts.
    """
    marks = df.select("id", *carry, X.website_of("id").alias("website"), udfs.fields(F.col("ground_truth"), F.col("prediction"), fuzzy, strict, unescape).alias("m"))
    return marks.select("id", *carry, "website", F.explode("m").alias("m")).select("id", *carry, "website", "m.*")


def page_samples(df: DataFrame, unescape: Callable[[str], str] = html.unescape) -> DataFrame:
    """Adds evaluation: field -> 1.0 for a hit, else 0.0.  unescape: reads the character references of gold texts."""
    m = udfs.fields(F.col("ground_truth"), F.col("prediction"), unescape=unescape)
    return df.withColumn("m__", m).withColumn("evaluation", F.map_from_entries(F.transform("m__", lambda x: F.struct(x["field"], x["hit"].cast("double"))))).drop("m__")


def counters(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*more, "website", "field").agg(F.count_if("hit").alias("page_hits"), F.count_if("extracted").alias("extracted_pages"), F.count_if("in_gold").alias("ground_truth_pages"))


def by_site_field(c: DataFrame) -> DataFrame:
    none = (F.col("extracted_pages") == 0) | (F.col("ground_truth_pages") == 0)
    hits = F.col("page_hits").cast("double")
    precision, recall = F.when(none, 0.0).otherwise(F.try_divide(hits, "extracted_pages")), F.when(none, 0.0).otherwise(F.try_divide(hits, "ground_truth_pages"))
    out = c.select("*", precision.alias("precision"), recall.alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def _average(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("f1", "precision", "recall")))


def by_website(site_field: DataFrame) -> DataFrame:
    return _average(site_field, "website")


def by_field(site_field: DataFrame) -> DataFrame:
    return _average(site_field, "field")


def overall(site_field: DataFrame) -> DataFrame:
    """Mean over websites of their means over fields."""
    return means(by_website(site_field))


def result_json(df: DataFrame) -> DataFrame:
    """One row: {"f1": {"average": ...}, ...}."""
    return df.select(F.to_json(F.struct(*(F.struct(F.col(c).alias("average")).alias(c) for c in ("f1", "precision", "recall")))).alias("result"))


register(Metric("token_f1", token_f1_samples, means))
register(Metric("page_level_f1", field_rows, lambda rows: overall(by_site_field(counters(rows)))))
