"""The relational stage between chunking and generation: score, normalise, keep, put together again.

Chunks are dealt by document once; the window and the reassembly share that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.functions import text as X

DEFAULT_THRESHOLD = 0.5


def exploded(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row for each chunk with its place pos; a document without chunks keeps one row, with nulls."""
    rest = [c for c in df.columns if c != chunks]
    return df.select(*rest, F.posexplode_outer(chunks).alias("pos", "chunk")).select(*rest, "pos", "chunk.*")


def lexical_tokens(text: Column) -> Column:
    """Distinct normalised tokens."""
    return F.array_distinct(F.filter(F.split(X.normalize_text(text), " "), lambda t: t != ""))


def lexical_share(tokens: Column, content: Column) -> Column:
    """Share of distinct tokens that the content has; no tokens: 0."""
    # the content's tokens need not be distinct: an intersection holds each once
    words = F.split(X.normalize_text(content), " ")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, words)).cast("double"), F.size(tokens)), F.lit(0.0))


def lexical_score(query: Column, content: Column) -> Column:
    """lexical_share of a query's tokens; where many contents have one query, its tokens are better taken before."""
    return X.once(lexical_tokens(query), lambda tokens: lexical_share(tokens, content))


def normalised(df: DataFrame, doc: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds score_norm, the score over the document's largest; where that is 0 the result is NaN, which passes any threshold."""
    most = F.max(score).over(W.partitionBy(doc))
    ratio = F.try_divide(F.col(score), most)
    return df.withColumn("score_norm", F.when(F.col(score).isNotNull(), F.coalesce(ratio, F.lit(float("nan")))))


def above(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, keep_empty: bool = True) -> DataFrame:
    """Chunks with score_norm at the threshold or more; keep_empty: also documents without chunks."""
    ok = F.col("score_norm") >= threshold
    return df.where(ok | F.col("pos").isNull() if keep_empty and "pos" in df.columns else ok)


def top_k(df: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """The k best chunks of each document, earlier ones first among equals."""
    order = W.partitionBy(doc).orderBy(F.desc("score"), "pos")
    return df.withColumn("rank__", F.row_number().over(order)).where(F.col("rank__") <= k).drop("rank__")


def regrouped(df: DataFrame, doc: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: carried columns as in its first chunk, chunks_kept in order, full_content joined by newlines."""
    first = [F.min_by(c, "pos").alias(c) for c in carry]
    kept = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "chunkcontent"))))
    out = df.groupBy(doc).agg(*first, kept.alias("kept"))
    texts = F.transform("kept", lambda x: x["chunkcontent"])
    return out.withColumn("chunks_kept", texts).withColumn("full_content", F.array_join("chunks_kept", "\n")).drop("kept")


def scored_chunks(df: DataFrame, score: Column) -> DataFrame:
    return df.withColumn("score", F.when(F.col("pos").isNotNull(), score))
