"""Arrow UDFs over the Python functions, for what has no built-in equivalent."""

from __future__ import annotations

import html
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import dom, tolerant


def clean_html(page: Column, **options) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: dom.clean_html(x, **options))

    return run(page)


def chunk_html(page: Column, max_tokens: int = 500, is_clean: bool = True, attr_cutoff_len: int = 5, whole: bool = False) -> Column:
    """whole: one chunk a page (chunking switched off)."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: ([x] if x else []) if whole else dom.chunk_html(x, max_tokens, is_clean, attr_cutoff_len))

    return run(page)


def page_chunks(page: Column, clean: dict, max_tokens: int = 500, is_clean: bool = True, attr_cutoff_len: int = 5, whole: bool = False) -> Column:
    """struct(texts, error): the chunks of a cleaned page; a page that cannot be cleaned or cut has an error and no texts."""

    def one(x: str | None) -> tuple[list[str] | None, str | None]:
        try:
            cleaned = dom.clean_html(x, **clean)
            return ([cleaned] if cleaned else []) if whole else dom.chunk_html(cleaned, max_tokens, is_clean, attr_cutoff_len), None
        except Exception as e:
            return None, f"[ERROR {type(e).__name__}] {e}"

    @F.pandas_udf("texts array<string>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in s], columns=["texts", "error"])

    return run(page)


def json_text(value: Column) -> Column:
    """JSON text spelt with a space after commas and colons."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False))

    return run(value)


def closest_node(page: Column, search: Column) -> Column:
    @F.pandas_udf("text string, xpath string, sub_index int, score double, found boolean")
    def run(p: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dom.closest_node(a, b) for a, b in zip(p, s, strict=True)], columns=["text", "xpath", "sub_index", "score", "found"])

    return run(page, search)


def direct_clean(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(dom.direct_clean)

    return run(page)


def unescape(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return run(text)


def extract_json(response: Column) -> Column:
    """The object in a response, as JSON text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(tolerant.extract(x), ensure_ascii=False))

    return run(response)


def parsed(value: Column) -> Column:
    """JSON text of what a value reads as."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(tolerant.parse(x), ensure_ascii=False, default=str))

    return run(value)


def similar(gold: Column, pred: Column, threshold: float = 90) -> Column:
    @F.pandas_udf("boolean")
    def run(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([tolerant.similar(a, b, threshold) for a, b in zip(g, p, strict=True)], dtype="boolean")

    return run(gold, pred)


def ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else tolerant.ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


FIELDS = "array<struct<field:string,hit:boolean,extracted:boolean,in_gold:boolean>>"


def field_marks(gold: str | None, pred: str | None, fuzzy: float | None = None, strict: bool = False, unescape: Callable[[str], str] = html.unescape) -> list[dict]:
    """For each field of the gold object: whether it is hit, counts as extracted, is in the gold data."""
    g = tolerant.parse(gold)
    p = tolerant.parse(pred) if pred is not None else None
    if not isinstance(g, dict):
        return []
    out = []
    for field, value in g.items():
        there = p.get(field) if isinstance(p, dict) else None
        try:
            hit = isinstance(p, dict) and (tolerant.same(value, there, unescape) if fuzzy is None else tolerant.similar(value, there, fuzzy, unescape))
        except Exception:
            hit = False
        in_gold = tolerant.not_null(value)
        extracted = tolerant.not_null(p) and (not isinstance(p, dict) or field not in p or tolerant.not_null(there))
        out.append({"field": field, "hit": hit and (in_gold or not strict), "extracted": extracted, "in_gold": in_gold})
    return out


def fields(gold: Column, pred: Column, fuzzy: float | None = None, strict: bool = False, unescape: Callable[[str], str] = html.unescape) -> Column:
    @F.pandas_udf(FIELDS)
    def run(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([field_marks(a, b, fuzzy, strict, unescape) for a, b in zip(g, p, strict=True)], dtype=object)

    return run(gold, pred)


def postprocessed(response: str | None, query: str | None, content: str | None, exact: bool) -> str:
    """A response as the prediction: the object, or its texts spread; with exact, values snapped to the page."""
    try:
        from harrow.functions.normal import normalize_html_text

        value = tolerant.extract(response)
        if not is_schema(query):
            return tolerant.spread(value)
        if exact:
            if content is None:
                raise ValueError("exact extraction needs the content")
            snapped = {}
            for k, v in value.items():
                try:
                    snapped[k] = v if v is None else normalize_html_text(dom.closest_node(content, str(v))["text"])
                except Exception as e:
                    snapped[k] = f"[MATCH_ERROR] {e}"
            value = snapped
        return json.dumps(value, ensure_ascii=False)
    except Exception as e:
        return f"[PARSE_ERROR] {e}"


def is_schema(text: str | None) -> bool:
    x = (text or "").strip()
    return x.startswith("dict_keys(") or x.startswith("{") and x.endswith("}") or x.startswith("[") and x.endswith("]") or x.count(":") >= 2


def postprocess(response: Column, query: Column, content: Column, exact: bool) -> Column:
    @F.pandas_udf("string")
    def run(r: pd.Series, q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([postprocessed(a, b, d, exact) for a, b, d in zip(r, q, c, strict=True)], dtype=object)

    return run(response, query, content)
