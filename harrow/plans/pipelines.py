"""Pipelines: transform(samples) -> predictions, each one lazy plan."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.functions import udfs
from harrow.operators import rerank
from harrow.plans import models
from harrow.plans.config import PipelineConfig
from harrow.sources.readers import prompts


class Pipeline(Protocol):
    def transform(self, samples: DataFrame) -> DataFrame: ...


def preprocessed(samples: DataFrame, config: PipelineConfig) -> DataFrame:
    """samples and doc_id, chunks.  The key is the sample's own id, so it is the same in any batch; a page that cannot
    be cut has one chunk, which says why."""
    p = config.effective().preprocessor
    clean = {"extra_remove_tags": p.extra_remove_tags, "strip_attrs": p.strip_attrs, "strip_links": p.strip_links, "keep_tags": p.keep_tags, "rag": p.use_clean_rag}
    made = udfs.page_chunks(F.col("content"), clean, p.chunk_size, p.strip_attrs, p.attr_cutoff_len, p.disable_chunking)
    out = samples.withColumn("doc_id", F.col("id")).withColumn("made__", made)
    chunks = F.when(F.col("made__.error").isNotNull(), X.error_chunk("doc_id", "made__.error")).otherwise(X.chunk_structs("doc_id", "made__.texts"))
    return out.withColumn("chunks", chunks).drop("made__")


class RerankerPipeline:
    """Clean, chunk, score, keep, put together, prompt, generate, read the answer."""

    def __init__(self, config: PipelineConfig | None = None, scorer: models.Scorer | None = None, client: models.Client | None = None, fetch=None):
        self.config = (config or PipelineConfig()).effective()
        off = self.config.extractor.disable_reranker
        self.scorer = models.ConstantScorer() if off else scorer or models.LexicalScorer()
        self.client, self.fetch = client or models.client_for(self.config.extractor.llm), fetch

    def transform(self, samples: DataFrame) -> DataFrame:
        from harrow.sources.readers import fetched

        e = self.config.extractor
        carry = tuple(c for c in samples.columns if c != "doc_id")
        docs = fetched(samples, self.fetch) if self.fetch else samples
        # Python makes the chunks once, before the exchange; what follows is one shuffle by document
        prepares = hasattr(self.scorer, "prepare")
        whole = preprocessed(docs, self.config)
        chunks = rerank.exploded(whole.withColumn("prepared__", self.scorer.prepare(F.col("query"))) if prepares else whole)
        score = self.scorer.score_prepared(F.col("prepared__"), F.col("chunkcontent")) if prepares else self.scorer.score(F.col("query"), F.col("chunkcontent"))
        scored = rerank.scored_chunks(chunks, score).drop("prepared__")
        kept = rerank.above(rerank.normalised(scored), e.rerank_threshold)
        if e.rerank_top_k:
            kept = rerank.top_k(kept, e.rerank_top_k)
        whole = rerank.regrouped(kept, carry=carry)
        template = prompts()[e.template]
        asked = whole.withColumn("prompt", X.prompt(template, schema="query", chunk="full_content", page="full_content"))
        answered = models.generate(asked, self.client, threads=e.llm.threads)
        return postprocessed(answered, self.config.postprocessor.exact_extraction, carry)


def postprocessed(df: DataFrame, exact: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    prediction = udfs.postprocess(F.col("response"), F.col("query"), F.col("content"), exact)
    shown = F.col("content") if exact else F.lit("")
    rest = [c for c in carry if c not in ("id", "query", "ground_truth", "content", "is_content_url")]
    return df.withColumn("p__", prediction).select("id", "query", "ground_truth", F.col("p__").alias("prediction"), F.col("full_content").alias("filtered_html"), shown.alias("content"), *rest)


class DirectPipeline:
    """Without reranking: the pruned page goes into the prompt."""

    def __init__(self, config: PipelineConfig | None = None, client: models.Client | None = None, fetch=None):
        self.config, self.fetch = config or PipelineConfig(name="direct"), fetch
        self.client = client or models.client_for(self.config.extractor.llm)

    def transform(self, samples: DataFrame) -> DataFrame:
        from harrow.sources.readers import fetched

        docs = fetched(samples, self.fetch) if self.fetch else samples
        cleaned = docs.withColumn("full_content", udfs.direct_clean(F.col("content")))
        asked = cleaned.withColumn("prompt", X.prompt(prompts()[self.config.extractor.template], schema="query", chunk="full_content", page="full_content"))
        answered = models.generate(asked, self.client, threads=self.config.extractor.llm.threads)
        return postprocessed(answered, self.config.postprocessor.exact_extraction, tuple(samples.columns))


def create_pipeline(config: PipelineConfig, **parts) -> Pipeline:
    makers = {"reranker": RerankerPipeline, "direct": DirectPipeline}
    if config.name not in makers:
        raise ValueError(f"no pipeline {config.name!r}")
    return makers[config.name](config, **parts)
