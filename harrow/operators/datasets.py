"""Datasets as DataFrames with an explicit place `idx`; positional operators as joins and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.scratch import stored

#: SWDE's verticals (fixed values).
DOMAINS = ("auto", "university", "camera", "book", "job", "nbaplayer", "movie", "restaurant")


def indexed(df: DataFrame, *order_by: str | Column) -> DataFrame:
    """Adds idx, 0 from on, in a stable order; runs df.

    Rows are sorted in parallel by range and written once with the number of their range and their place in it, so
    that both are of one execution: range bounds are sampled, and a plan that is run again may cut them elsewhere.
    What is summed in one task is one number for each range.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(ranged.select("*", F.monotonically_increasing_id().alias("place__")))  # range << 33 | place in it
    in_range, place = F.shiftright("place__", 33), F.col("place__").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(in_range.alias("r__")).agg(F.count(F.lit(1)).alias("n__"))
    earlier = F.sum("n__").over(W.orderBy("r__").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("r__", F.coalesce(earlier, F.lit(0)).alias("before__"))
    out = placed.join(F.broadcast(before), in_range == F.col("r__"), "left")  # as many rows as ranges
    return out.withColumn("idx", (F.col("before__") + place).cast("long")).drop("r__", "place__", "before__")


def length(df: DataFrame) -> int:
    return df.count()


def get(df: DataFrame, i: int) -> DataFrame:
    """The row at place i; IndexError outside the dataset."""
    if i < 0 or i >= df.count():
        raise IndexError(i)
    return df.where(F.col("idx") == i)


def subset(df: DataFrame, indices: DataFrame | Sequence[int]) -> DataFrame:
    """Rows at the given places, in their order, repeats kept; pos is the place in the subset.

    indices: a list, or a table (pos, idx)."""
    if not isinstance(indices, DataFrame):
        indices = df.sparkSession.createDataFrame(list(enumerate(indices)), "pos long, idx long")
    return indices.join(df, "idx").select("pos", *df.columns)


def stride(df: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """Every step-th row, step = n / k rounded down, at least 1."""
    step = max(1, (df.count() if n is None else n) // k)
    return df.where(F.col("idx") % step == 0)


def batches(df: DataFrame, size: int, place: str = "idx") -> DataFrame:
    """Adds batch_id; the last batch may be short."""
    if size < 1:
        raise ValueError("size is at least 1")
    return df.withColumn("batch_id", F.floor(F.col(place) / size).cast("long"))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Adds pos in a pseudorandom order that seed picks; df is left as it is."""
    keyed = df.withColumnRenamed("idx", "old__").withColumn("key__", F.xxhash64(F.lit(seed), F.col("old__")))
    return indexed(keyed, "key__", "old__").withColumnRenamed("idx", "pos").withColumnRenamed("old__", "idx").drop("key__")


def domain(df: DataFrame, name: str) -> DataFrame:
    if name not in DOMAINS:
        raise ValueError(f"no domain {name!r}; there are {', '.join(DOMAINS)}")
    return df.where(F.col("domain") == name)


def domains(df: DataFrame) -> DataFrame:
    return df.select("domain").distinct()


def website_name(df: DataFrame, i: int) -> DataFrame:
    return get(df, i).select("website_name")


def first_of(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the first by order: a minimum, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def domain_abbreviations(pages: DataFrame, order: str) -> DataFrame:
    """abbreviation, domain: first two characters; the last row wins where two domains share them."""
    return pages.groupBy(X.websrc_domain_key("domain").alias("abbreviation")).agg(F.max_by("domain", order).alias("domain"))


def websrc_samples(questions: DataFrame, pages: DataFrame, order: str = "place") -> DataFrame:
    """Questions with their page: domain by abbreviation, page by number; the first match, none gives null content.

    pages needs a column with the file order.
    """
    names = domain_abbreviations(pages, order)
    first = first_of(pages.select(F.col("domain").alias("page_domain"), F.col("id").cast("int").alias("page"), "html", "website", order), ["page_domain", "page"], order).drop(order)
    q = questions.withColumn("abbreviation", X.websrc_domain_key("id")).withColumn("number", X.websrc_page("id")).join(names, "abbreviation", "left")
    out = q.join(first, (q["domain"] == first["page_domain"]) & (q["number"] == first["page"]), "left")
    return out.select("id", F.col("html").alias("content"), F.col("question").alias("query"), F.col("answer").alias("ground_truth"), X.is_url("html").alias("is_content_url"))


def swde_samples(labels: DataFrame, files: DataFrame) -> DataFrame:
    """Labels with their page: domain, site and page number are equal; no file gives null content."""
    site, page = F.split_part("website_id", F.lit("_"), F.lit(1)), F.split_part("website_id", F.lit("_"), F.lit(2))
    out = labels.withColumn("site", site).withColumn("page", page).join(files.select("domain", "site", "page", "html"), ["domain", "site", "page"], "left")
    return out.select(F.col("website_id").alias("id"), F.col("html").alias("content"), F.col("schema").alias("query"), F.col("gt").alias("ground_truth"), X.is_url("html").alias("is_content_url"), "domain")
