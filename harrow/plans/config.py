"""Frozen configurations; copies are derived, never changed in place."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

SECRETS = frozenset(("api_key",))


def to_dict(config) -> dict:
    """As plain values, secrets left out."""

    def clean(x):
        if isinstance(x, dict):
            return {k: "***" if k in SECRETS and v else clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list | tuple) else x

    return clean(asdict(config))


@dataclass(frozen=True)
class DatasetConfig:
    name: str = "base"
    batch_size: int = 1
    shuffle: bool = False
    metrics: tuple[str, ...] = ()


@dataclass(frozen=True)
class SwdeConfig(DatasetConfig):
    name: str = "swde"
    labels_path: str = ""
    html_path: str = ""
    domain: str = "book"
    metrics: tuple[str, ...] = ("page_level_f1",)


@dataclass(frozen=True)
class WebsrcConfig(DatasetConfig):
    name: str = "websrc"
    pages_path: str = ""
    questions_path: str = ""
    metrics: tuple[str, ...] = ("token_f1",)

    def __post_init__(self):
        for p in (self.pages_path, self.questions_path):
            if p and not p.rstrip("/").endswith(".jsonl"):
                raise ValueError(f"{p} is no .jsonl file")


@dataclass(frozen=True)
class LLMConfig:
    source: str = "stub"
    model: str = ""
    api_key: str | None = field(default=None, repr=False)
    temperature: float = 0.0
    top_p: float = 0.7
    max_tokens: int = 8192
    threads: int = 8
    #: Of the server of a hosted or local model: what comes before /chat/completions, and seconds that an answer may take.
    base_url: str = ""
    timeout: float = 120.0

    def __post_init__(self):
        if self.source not in ("stub", "hosted", "local"):
            raise ValueError(f"no source {self.source!r}")


@dataclass(frozen=True)
class PreprocessorConfig:
    extra_remove_tags: tuple[str, ...] = ("header", "footer")
    strip_attrs: bool = True
    strip_links: bool = True
    keep_tags: bool = True
    #: Pages without tags are read once more as pages, so that markup that was spelt as text goes too.
    use_clean_rag: bool = False
    chunk_size: int = 500
    attr_cutoff_len: int = 5
    disable_chunking: bool = False


@dataclass(frozen=True)
class ExtractorConfig:
    llm: LLMConfig = LLMConfig()
    template: str = "page_schema"
    rerank_threshold: float = 0.5
    rerank_top_k: int | None = None
    max_prompt_tokens: int = 8192
    disable_reranker: bool = False


@dataclass(frozen=True)
class PostprocessorConfig:
    exact_extraction: bool = False


@dataclass(frozen=True)
class PipelineConfig:
    name: str = "reranker"
    preprocessor: PreprocessorConfig = PreprocessorConfig()
    extractor: ExtractorConfig = ExtractorConfig()
    postprocessor: PostprocessorConfig = PostprocessorConfig()
    disable_method: bool = False

    def effective(self) -> PipelineConfig:
        """With the method switched off, chunking and reranking are off; the given configurations stay as they are."""
        if not self.disable_method:
            return self
        return replace(self, preprocessor=replace(self.preprocessor, disable_chunking=True), extractor=replace(self.extractor, disable_reranker=True))


@dataclass(frozen=True)
class ExperimentConfig:
    name: str
    dataset: DatasetConfig
    pipeline: PipelineConfig = PipelineConfig()
    seed: int = 0
    tracker: str | None = None
    output_dir: str = "."

    def __post_init__(self):
        if not isinstance(self.name, str) or not self.name.strip():
            raise ValueError("an experiment has a name")
        if not isinstance(self.seed, int) or isinstance(self.seed, bool) or self.seed < 0:
            raise ValueError("the seed is an integer, 0 or more")
        if not isinstance(self.dataset, DatasetConfig) or not isinstance(self.pipeline, PipelineConfig):
            raise TypeError("dataset and pipeline are configurations")

    def to_dict(self) -> dict:
        out = to_dict(self)
        del out["output_dir"]
        return out


#: Pages of each vertical (fixed values).
VERTICAL_PAGES = {"auto": 17900, "university": 16700, "camera": 5260, "book": 20000, "job": 20000, "nbaplayer": 4410, "movie": 20000, "restaurant": 20000}
VERTICAL_SAMPLES, WEBSRC_QUESTIONS, WEBSRC_SAMPLES, ABLATION_BATCH = 500, 50000, 5000, 5


def ablation_grid(base: ExperimentConfig, swde: SwdeConfig, websrc: WebsrcConfig) -> list[tuple[ExperimentConfig, int]]:
    """18 runs: nine datasets with the method on and off, each with the step of its stride subset."""
    out = []
    sets = [(replace(swde, domain=d, batch_size=ABLATION_BATCH), max(1, n // VERTICAL_SAMPLES), d) for d, n in VERTICAL_PAGES.items()]
    sets.append((replace(websrc, batch_size=ABLATION_BATCH), max(1, WEBSRC_QUESTIONS // WEBSRC_SAMPLES), "websrc"))
    for dataset, step, name in sets:
        for off in (False, True):
            pipeline = replace(base.pipeline, disable_method=off)
            out.append((replace(base, name=f"{base.name}-{name}-{'off' if off else 'on'}", dataset=dataset, pipeline=pipeline), step))
    return out
