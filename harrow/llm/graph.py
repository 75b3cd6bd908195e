"""Connected components of an edge table, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import discard, written


def _star(both: DataFrame) -> DataFrame:
    """u, v, m for both directions of each edge; m: least of u and its neighbours."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least reachable node) for every node that is not itself the least of its component.

    Neighbour lists are never gathered: a step is a minimum by node (combined before the shuffle) and a join, and has no
    more edges than the step before.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges", narrow=True)
    n = e.count()
    state = None
    while True:
        old = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(least.select("u", F.col("m").alias("v")).union(linked).distinct(), "edges", rows=n)
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        state = now


def with_edges(components_: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """components_ (node, component) with further edges: only the components that these join are gone through again."""
    first, second = (components_.select(F.col("node").alias(x), F.col("component").alias(x + "__")) for x in (a, b))
    ends = edges.select(a, b).join(first, a, "left").join(second, b, "left").select(F.coalesce(a + "__", a).alias(a), F.coalesce(b + "__", b).alias(b))
    over = written(components(ends, a, b), "over", narrow=True)
    moved = components_.join(over.select(F.col("node").alias("component"), F.col("component").alias("now__")), "component", "left")
    return moved.select("node", F.coalesce("now__", "component").alias("component")).union(over)
