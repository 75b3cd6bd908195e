"""Readers.  All go through Spark's own, so any store that Spark reads will do."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow import schema
from harrow.functions import text as X


def swde_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with their domain: a file's name up to the first -."""
    name = F.regexp_extract(F.col("_metadata.file_name"), "^([^-]+)-", 1)
    return spark.read.schema(schema.SWDE_LABELS).parquet(path).withColumn("domain", name)


def swde_files(spark: SparkSession, path: str) -> DataFrame:
    """domain, site, page, html of <path>/<domain>/<domain>-<site>.../<page>.htm.

    The site is matched as a whole: its name may be followed by a bracketed count, not by more letters.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm").option("recursiveFileLookup", "true").load(path)
    parts = r"([^/]+)/([^/-]+)-([^/(]+)(?:\([^/]*\))?/([^/]+)\.htm$"
    return raw.select(*(F.regexp_extract("path", parts, i).alias(n) for i, n in ((2, "domain"), (3, "site"), (4, "page"))), F.decode("content", "UTF-8").alias("html"))


def _jsonl(spark: SparkSession, path: str, columns) -> DataFrame:
    """With place, the order of the lines: by file, then by where a part of it begins, however files are cut into parts."""
    meta = F.col("_metadata")
    place = F.struct(meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id())
    return spark.read.schema(columns).json(path).withColumn("place", place)


def websrc_pages(spark: SparkSession, path: str) -> DataFrame:
    return _jsonl(spark, path, schema.WEBSRC_PAGES)


def websrc_questions(spark: SparkSession, path: str) -> DataFrame:
    return _jsonl(spark, path, schema.WEBSRC_QUESTIONS)


FETCH_ERROR = "[FETCH_ERROR]"


def fetched(df: DataFrame, fetch: Callable[[str], str], column: str = "content") -> DataFrame:
    """content replaced by what fetch(url) returns where is_content_url; a failure becomes a text, not an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            def one(url: str) -> str:
                try:
                    return fetch(url)
                except Exception as e:
                    return f"{FETCH_ERROR} {e}"

            wanted = pdf["is_content_url"].fillna(False).astype(bool)
            pdf.loc[wanted, column] = pdf.loc[wanted, column].map(one)
            yield pdf

    return df.mapInPandas(run, df.schema)


def http_fetch(url: str, timeout: float = 15.0) -> str:
    """A page by HTTP, with headers like a browser's."""
    import urllib.request

    headers = {"User-Agent": "Mozilla/5.0", "Accept": "text/html,application/xhtml+xml", "Accept-Language": "en"}
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetched_by_lookup(df: DataFrame, store: DataFrame) -> DataFrame:
    """As fetched(), from a table (url, html): a left join; unknown addresses become error texts."""
    out = df.join(store.select(F.col("url").alias("u__"), F.col("html").alias("h__")), (df["content"] == F.col("u__")) & df["is_content_url"], "left")
    new = F.when(F.col("is_content_url"), F.coalesce("h__", F.concat(F.lit(f"{FETCH_ERROR} no page for "), "content"))).otherwise(F.col("content"))
    return out.withColumn("content", new).drop("u__", "h__")


def prediction_rows(line: str) -> list[dict]:
    """The predictions of a line: an object, an array of them, or a value; [] where it cannot be read."""
    if not line or not line.strip():
        return []
    try:
        value = json.loads(line)
    except ValueError:
        try:
            value = ast.literal_eval(line)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
    out = []
    for x in value if isinstance(value, list) else [value]:
        x = x if isinstance(x, dict) else {"prediction": x}
        row = {k: x.get(k) for k in ("id", "query", "ground_truth", "prediction", "filtered_html")}
        row["id"] = None if row["id"] is None else str(row["id"])
        out.append({k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in row.items()})
    return out


def predictions(lines: DataFrame, value: str = "value") -> DataFrame:
    """Predictions from lines of text (spark.read.text): JSON or Python literals, arrays flattened, blanks and others skipped."""

    @F.pandas_udf("array<struct<id:string,query:string,ground_truth:string,prediction:string,filtered_html:string>>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(prediction_rows)

    return lines.select(F.explode(read(value)).alias("x")).select("x.*")


def sample_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Saved per-sample rows; a line that is no JSON is kept in raw."""
    columns = "id string, query string, ground_truth string, prediction string, filtered_html string, evaluation map<string,double>, raw string"
    return spark.read.schema(columns).option("columnNameOfCorruptRecord", "raw").json(path)


def frame(spark: SparkSession, rows) -> DataFrame:
    """A sample, a list of samples, or a DataFrame, as samples."""
    if isinstance(rows, DataFrame):
        return rows
    rows = [rows] if isinstance(rows, dict) else list(rows)
    data = [(r.get("id"), r.get("content"), r.get("query"), r.get("ground_truth")) for r in rows]
    df = spark.createDataFrame(data, "id string, content string, query string, ground_truth string")
    return df.withColumn("is_content_url", X.is_url("content"))


#: Our own templates; {schema} or {question}, and {chunk} or {page}.
PROMPTS = {
    "chunk_schema": "Fill the schema from this part of a page. Answer with one JSON object.\nSchema: {schema}\nPart:\n{chunk}\n",
    "page_schema": "Fill the schema from this page. Answer with one JSON object.\nSchema: {schema}\nPage:\n{page}\n",
    "chunk_question": "Answer the question from this part of a page, as {{\"answer\": ...}}.\nQuestion: {schema}\nPart:\n{chunk}\n",
    "page_question": "Answer the question from this page, as {{\"answer\": ...}}.\nQuestion: {schema}\nPage:\n{page}\n",
    "chunk_exact": "Copy the values of the schema's fields out of this part, word for word, as a JSON object.\nSchema: {schema}\nPart:\n{chunk}\n",
    "page_exact": "Copy the values of the schema's fields out of this page, word for word, as a JSON object.\nSchema: {schema}\nPage:\n{page}\n",
}


def prompts(path: str | None = None) -> dict[str, str]:
    """The templates, or those of a YAML file on the driver."""
    if path is None:
        return dict(PROMPTS)
    import yaml

    with open(path) as f:
        return {k: str(v) for k, v in yaml.safe_load(f).items()}
