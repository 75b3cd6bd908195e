"""Tolerant reading of JSON and of Python literals, and comparison of values.

``repair`` reads what language models write: text around the object, code fences, single quotes, names without
quotes, Python constants, trailing commas, comments and brackets left open.  Its grammar is bounded to these.
"""

from __future__ import annotations

import ast
import html
import json
import math
import re
from collections.abc import Callable
from typing import Any

from harrow.functions.normal import normalize_text

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])")
_BARE = re.compile(r"[^\s,:\[\]{}\"']+")
_CONSTANTS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "NaN": math.nan}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class _Reader:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def skip(self) -> None:
        while self.i < len(self.s):
            if self.s[self.i].isspace():
                self.i += 1
            elif self.s.startswith("//", self.i):
                end = self.s.find("\n", self.i)
                self.i = len(self.s) if end < 0 else end
            elif self.s.startswith("/*", self.i):
                end = self.s.find("*/", self.i)
                self.i = len(self.s) if end < 0 else end + 2
            else:
                return

    def peek(self) -> str:
        self.skip()
        return self.s[self.i] if self.i < len(self.s) else ""

    def value(self, stops: str = ",]}") -> Any:
        c = self.peek()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in "\"'“":
            return self.string()
        if m := _NUMBER.match(self.s, self.i):
            self.i = m.end()
            return json.loads(m[0])
        end = self.i
        while end < len(self.s) and self.s[end] not in stops + "\n":
            end += 1
        word = self.s[self.i : end].strip()
        self.i = end
        if word in _CONSTANTS:
            return _CONSTANTS[word]
        if not word:
            raise ValueError("no value")
        return word

    def string(self) -> str:
        quote = self.s[self.i]
        close = "”" if quote == "“" else quote
        self.i += 1
        out = []
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == "\\" and self.i < len(self.s):
                e = self.s[self.i]
                self.i += 1
                if e == "u" and re.match(r"[0-9a-fA-F]{4}", self.s[self.i :]):
                    out.append(chr(int(self.s[self.i : self.i + 4], 16)))
                    self.i += 4
                else:
                    out.append(_ESCAPES.get(e, e))
            elif c == close:
                rest = self.s[self.i :].lstrip()
                if not rest or rest[0] in ",:]}" or c == '"' and quote == '"':
                    break
                out.append(c)  # an apostrophe inside
            else:
                out.append(c)
        return "".join(out)

    def object(self) -> dict:
        out: dict = {}
        self.i += 1
        while (c := self.peek()) and c != "}":
            if c == ",":
                self.i += 1
                continue
            if c in "\"'“":
                key = self.string()
            elif m := _BARE.match(self.s, self.i):
                key, self.i = m[0], m.end()
            else:
                raise ValueError("no key")
            if self.peek() == ":":
                self.i += 1
                out[key] = None if self.peek() in (",", "}", "") else self.value()
            else:
                out[key] = None
        self.i += 1
        return out

    def array(self) -> list:
        out: list = []
        self.i += 1
        while (c := self.peek()) and c != "]":
            if c == ",":
                self.i += 1
            elif c == "}":
                break
            else:
                out.append(self.value())
        self.i += 1
        return out


def repair(text: str) -> Any:
    """The value in text; ValueError where there is none."""
    r = _Reader(text)
    if r.peek() not in "{[\"'":
        raise ValueError("no JSON")
    return r.value()


def extract(response: Any) -> dict:
    """The object in a response: in a code fence, from the first { to the last }, repaired; {} where there is none."""
    if response is None:
        return {}
    if isinstance(response, dict):
        return response
    try:
        text = str(response)
        if m := _FENCE.search(text):
            text = m[1]
        a, b = text.find("{"), text.rfind("}")
        if a < 0:
            return {}
        text = text[a : b + 1] if b > a else text[a:]
        try:
            value = json.loads(text)
        except ValueError:
            value = repair(text)
        return value if isinstance(value, dict) else {}
    except Exception:
        return {}


def spread(value: dict) -> str:
    """The texts among an object's values, one after the other; other values are left out."""
    return "".join(v for v in value.values() if isinstance(v, str))


def parse(value: Any) -> Any:
    """JSON, else repaired JSON, else a Python dict or list; {} where nothing fits."""
    if value is None:
        return {}
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value)
    except ValueError:
        pass
    try:
        return repair(value)
    except ValueError:
        pass
    try:
        out = ast.literal_eval(value)
        return out if isinstance(out, dict | list) else {}
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return {}


def not_null(value: Any) -> bool:
    """An empty object and a list of blanks are values; blanks, the null text, empty lists and NaN are none."""
    if value is None:
        return False
    if isinstance(value, str):
        return value != "<NULL>" and bool(value.strip())
    if isinstance(value, list | tuple):
        return any(x is not None and not (isinstance(x, float) and math.isnan(x)) for x in value)
    return not (isinstance(value, float) and math.isnan(value))


def gold_values(value: Any, unescape: Callable[[str], str] = html.unescape) -> list:
    """What a gold value allows: a list's items, or one; texts are read as Python literals where they are such.

    unescape: reads the character references of texts.
    """
    if not not_null(value):
        return []
    if isinstance(value, list | tuple):
        items = list(value)
    elif isinstance(value, str):
        try:
            read = ast.literal_eval(value)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            read = value
        items = list(read) if isinstance(read, list) else [read]
    else:
        items = [value]
    out = []
    for x in items:
        if x is None or isinstance(x, float) and math.isnan(x):
            continue
        if isinstance(x, str):
            x = " ".join(unescape(x).split())
            if not not_null(x):
                continue
        out.append(x)
    return out


def _number(x: Any) -> bool:
    return isinstance(x, int | float)


def same(gold: Any, pred: Any, unescape: Callable[[str], str] = html.unescape) -> bool:
    """Exact comparison: numbers as numbers, else normalised texts; no gold value matches no prediction."""
    allowed = gold_values(gold, unescape)
    if not allowed:
        return not not_null(pred)
    return any(x == pred if _number(x) and _number(pred) else normalize_text(str(x)) == normalize_text(str(pred)) for x in allowed)


def ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths; two empty texts are alike.  By words of bits."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def similar(gold: Any, pred: Any, threshold: float = 90, unescape: Callable[[str], str] = html.unescape) -> bool:
    allowed = gold_values(gold, unescape)
    if not allowed:
        return not not_null(pred)
    least = min(100.0, max(0.0, threshold))
    p = normalize_text(str(pred))
    return any(ratio(normalize_text(str(x)), p) >= least for x in allowed)
