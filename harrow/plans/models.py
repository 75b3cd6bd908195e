"""Model protocols, and deterministic stand-ins that need no weights."""

from __future__ import annotations

import json
import os
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.operators import rerank
from harrow.plans.config import LLMConfig


class Scorer(Protocol):
    """Relevance of a chunk for a query, as a column.  A scorer may also have prepare(query) and score_prepared(prepared, chunk)."""

    def score(self, query: Column, chunk: Column) -> Column: ...


class LexicalScorer:
    """Scores from what prepare() makes of a query, once for all its chunks."""

    def prepare(self, query: Column) -> Column:
        return rerank.lexical_tokens(query)

    def score_prepared(self, prepared: Column, chunk: Column) -> Column:
        return rerank.lexical_share(prepared, chunk)

    def score(self, query: Column, chunk: Column) -> Column:
        return rerank.lexical_score(query, chunk)


class ModelScorer:
    """Scores by a model that says yes or no.

    load(), which is called once in each worker, gives a function from texts to pairs of log probabilities (yes, no),
    None for one that is not among the likeliest.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[tuple[float | None, float | None]]]], instruction: str = X.INSTRUCTION):
        self.load, self.instruction = load, instruction

    def score(self, query: Column, chunk: Column) -> Column:
        load, held = self.load, []

        @F.pandas_udf("yes double, no double")
        def run(texts: pd.Series) -> pd.DataFrame:
            if not held:
                held.append(load())
            return pd.DataFrame(held[0](texts.fillna("").tolist()), columns=["yes", "no"], dtype="float64")

        # a missing value comes back as NaN
        said = run(X.chat_messages(query, chunk, self.instruction)[1]["content"])
        return X.once(said, lambda s: X.yes_no_probability(F.nanvl(s["yes"], F.lit(None)), F.nanvl(s["no"], F.lit(None))))


class ConstantScorer:
    """For a reranker that is switched off: every chunk 1."""

    def score(self, query: Column, chunk: Column) -> Column:
        return F.lit(1.0)


class RateLimited(Exception):
    """What a client raises when it is asked to wait."""


def with_retry(call: Callable[[str], str], tries: int = 20, delay: float = 0.5, longest: float = 5.0, sleep=time.sleep, rng: random.Random | None = None) -> Callable[[str], str]:
    """Repeats a call while it is rate limited: waits min(longest, d) and up to d more, d doubles."""
    rng = rng or random.Random()

    def run(prompt: str) -> str:
        d = delay
        for n in range(tries):
            try:
                return call(prompt)
            except RateLimited:
                if n == tries - 1:
                    raise
                sleep(min(longest, d) + rng.uniform(0, d))
                d *= 2
        raise RateLimited

    return run


class Client(Protocol):
    """A language model: made once for each task from this description."""

    def open(self) -> Callable[[str], str]: ...


@dataclass(frozen=True)
class HttpClient:
    """A model behind a server that answers POST <base_url>/chat/completions; asked again while it is rate limited."""

    base_url: str
    model: str
    api_key: str | None = field(default=None, repr=False)
    temperature: float = 0.0
    top_p: float = 0.7
    max_tokens: int = 8192
    timeout: float = 120.0

    def open(self) -> Callable[[str], str]:
        return with_retry(self.ask)

    def ask(self, prompt: str) -> str:
        import urllib.error
        import urllib.request

        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "top_p": self.top_p, "max_tokens": self.max_tokens}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(str(e)) from e
            raise


#: Where the key of a hosted model is looked for on the driver if the configuration has none.
KEY_VARIABLE = "LLM_API_KEY"


def client_for(config: LLMConfig) -> Client:
    """The client that a configuration names; an error where it does not say enough, never another client."""
    if config.source == "stub":
        return StubClient()
    key = config.api_key or os.environ.get(KEY_VARIABLE)
    if config.source == "hosted" and not key:
        raise ValueError(f"a hosted model needs api_key or {KEY_VARIABLE}")
    if not config.base_url or not config.model:
        raise ValueError(f"a {config.source} model needs base_url and model")
    return HttpClient(config.base_url, config.model, key, config.temperature, config.top_p, config.max_tokens, config.timeout)


class StubClient:
    """Answers a schema's fields with the page's heading, language or first text, by rules."""

    def open(self) -> Callable[[str], str]:
        return stub_answer


def stub_answer(prompt: str) -> str:
    schema = re.search(r"^(?:Schema|Question): (.*)$", prompt, re.M)
    wanted = schema[1] if schema else "{}"
    page = prompt.split("\n", 3)[-1]
    title = re.search(r"<h1[^>]*>(.*?)</h1>", page, re.S) or re.search(r"<title[^>]*>(.*?)</title>", page, re.S)
    first = title[1] if title else re.sub(r"<[^>]*>", " ", page).strip()[:60]
    try:
        fields = list(json.loads(wanted))
    except (ValueError, TypeError):
        fields = ["answer"]
    return json.dumps({f: first for f in fields}, ensure_ascii=False)


def generate(df: DataFrame, client: Client, prompt: str = "prompt", out: str = "response", threads: int = 8, fail: bool = False) -> DataFrame:
    """Adds the client's answers, several at a time in each task, order and rows kept; a failed call gives null, or raises."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        call = client.open()

        def one(p):
            try:
                return None if p is None else call(p)
            except Exception:
                if fail:
                    raise
                return None

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pdf.assign(**{out: list(pool.map(one, pdf[prompt]))})

    return df.mapInPandas(run, schema)
