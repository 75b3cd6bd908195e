"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a bounded sample of texts (``SAMPLE_ROWS``); rules then run
in the order of rejections per second, where shared work counts once, each only on the texts that the earlier ones left: what a rule counts and no
earlier one has is counted on these alone (``quality`` returns STATS and base_failed, and so has them of all).  A text is kept if no
rule rejects it, so the order changes the time taken and never the verdict.

Nulls: a null text counts as empty.  An empty text, or one of spaces only, has no words and fails the base rule.
Repeated rows each get their own, equal verdict.  Other columns are not read.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import bytesx as X
from harrow.llm.shared import give_back, let_go, ship, slim

#: Rows on which rules are timed, and partitions that they come from; it sets only the rules' order.
SAMPLE_ROWS, SAMPLE_PARTS = 256, 16
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True


class Texts:
    """A piece of texts; what several rules need is computed once, when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._have = data, offsets, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def get(self, name: str):
        if name not in self._have:
            self._have[name] = getattr(self, "_" + name)()
        return self._have[name]

    def has(self, name: str) -> bool:
        return name in self._have

    def own(self) -> Texts:
        return self

    def take(self, rows: np.ndarray) -> Texts:
        """The texts at rows (in order), with their words where these are known."""
        sizes = np.diff(self.offsets)[rows]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in rows]
        out = Texts(np.concatenate(parts) if parts else self.data[:0], offsets)
        if self.has("words"):
            starts, ends, row = self.get("words")
            place = np.full(len(self), -1, np.int64)
            place[rows] = np.arange(len(rows))
            stay = place[row] >= 0
            new = place[row[stay]]
            shift = offsets[new] - self.offsets[row[stay]]
            out._have["words"] = (starts[stay] + shift, ends[stay] + shift, new)
        return out

    def _words(self):
        return X.words(self.data, self.offsets)

    def _prefix(self):
        return X.prefix(self.data)

    def _n_words(self):
        return np.bincount(self.get("words")[2], minlength=len(self))

    def _word_chars(self):
        starts_char = (self.data & 0xC0) != 0x80
        return X.counts(starts_char & ~X.SPACE[self.data], self.offsets)

    def _n_symbols(self):
        return X.counts(_SYMBOL[self.data], self.offsets)

    def _n_marks(self):
        return X.counts(self.data == ord("!"), self.offsets)

    def _n_upper(self):
        return X.counts((self.data >= 65) & (self.data <= 90), self.offsets)

    def _n_lower(self):
        return X.counts((self.data >= 97) & (self.data <= 122), self.offsets)

    def _lines(self):
        """(has a word, equals an earlier line of its text, row) of each line."""
        data, offsets = self.data, self.offsets
        n = len(data)
        if not n:
            return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate((X.firsts(offsets, n), breaks + 1)))
        row = np.searchsorted(offsets, starts, "right") - 1
        # a \n that ends a text is followed by an empty line, which has no word and is left out
        starts, row = starts[starts < n], row[starts < n]
        limit = offsets[row + 1]
        at = np.searchsorted(breaks, starts)
        ends = np.minimum(np.where(at < len(breaks), breaks[np.minimum(at, len(breaks) - 1)] if len(breaks) else n, n), limit)
        filled = np.zeros(n + 1, np.int64)
        np.cumsum(~X.SPACE[data], out=filled[1:])
        worded = filled[ends] > filled[starts]
        h = X.mix(X.span_hash(self.get("prefix"), starts, ends) ^ X.mix(row.astype(np.uint64)))
        later = np.zeros(len(h), bool)
        twice = np.flatnonzero(X.among(h, X.repeated(h)))
        order = twice[np.argsort(h[twice], kind="stable")]
        later[order[1:]] = h[order[1:]] == h[order[:-1]]
        return worded, later & worded, row

    def _n_lines(self):
        worded, _, row = self.get("lines")
        return np.bincount(row[worded], minlength=len(self))

    def _n_dup_lines(self):
        _, later, row = self.get("lines")
        return np.bincount(row[later], minlength=len(self))

    def _n_stutter(self):
        """Words equal to the word before."""
        starts, ends, row = self.get("words")
        h = X.span_hash(self.get("prefix"), starts, ends)
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] == row[:-1]))) if len(h) else np.zeros(0, bool)
        return np.bincount(row[again], minlength=len(self))

    def _n_repeat_words(self):
        starts, ends, row = self.get("words")
        if len(starts) < REPEAT_WINDOW:
            return np.zeros(len(self), np.int64)
        h = X.window_hash(X.span_hash(self.get("prefix"), starts, ends), REPEAT_WINDOW)
        last = REPEAT_WINDOW - 1
        whole = np.flatnonzero(row[last:] == row[: len(row) - last])
        h = X.mix(h[whole] ^ X.mix(row[whole].astype(np.uint64)))
        hit = X.covered(len(starts), whole[X.among(h, X.repeated(h))], REPEAT_WINDOW)
        return np.bincount(row[hit], minlength=len(self))


@dataclass(frozen=True)
class Rule:
    """rejects(texts) is a boolean for each text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _few_words(t: Texts):
    return t.get("n_words") < MIN_WORDS


def _repetition(t: Texts):
    return 100 * t.get("n_repeat_words") > REPEAT_PERCENT * t.get("n_words")


def _symbols(t: Texts):
    return 10 * t.get("n_symbols") > 3 * t.get("n_words")


def _exclamation(t: Texts):
    return 10 * t.get("n_marks") > 3 * t.get("n_words")


def _capitals(t: Texts):
    return t.get("n_upper") > t.get("n_lower")


def _dup_lines(t: Texts):
    return 2 * t.get("n_dup_lines") > t.get("n_lines")


def _stutter(t: Texts):
    return 100 * t.get("n_stutter") > REPEAT_PERCENT * t.get("n_words")


def _word_length(t: Texts):
    return (t.get("word_chars") < 2 * t.get("n_words")) | (t.get("word_chars") > 15 * t.get("n_words"))


BASE_RULES = (Rule("few_words", _few_words), Rule("repetition", _repetition))
RULES = (
    Rule("symbols", _symbols), Rule("exclamation", _exclamation), Rule("capitals", _capitals),
    Rule("dup_lines", _dup_lines), Rule("stutter", _stutter), Rule("word_length", _word_length),
)


class Timed(Texts):
    """seconds: what each value took to work out, without the values that it needed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        self.seconds: dict[str, float] = {}
        self._inner = 0.0

    def get(self, name: str):
        if name not in self._have:
            outer, self._inner = self._inner, 0.0
            began = time.perf_counter()
            self._have[name] = getattr(self, "_" + name)()
            took = time.perf_counter() - began
            self.seconds[name], self._inner = took - self._inner, outer + took
        return self._have[name]


def measured_order(rules: tuple[Rule, ...], sample: Texts, have: tuple[str, ...] = ()) -> list[str]:
    """Names of the rules in the order to run them: next comes the one that rejects most of what is left per second.

    What several rules need is charged to the first of them; have: values that are worked out in any case.
    """
    costs, rejected = {}, {}
    for rule in rules:
        fresh = Timed(sample.data, sample.offsets)
        began = time.perf_counter()
        rejected[rule.name] = np.asarray(rule.rejects(fresh), bool)
        took = time.perf_counter() - began
        costs[rule.name] = (max(took - sum(fresh.seconds.values()), 1e-7), fresh.seconds)
    order, done, alive = [], set(have), np.ones(len(sample), bool)
    while len(order) < len(rules):

        def rate(name: str) -> float:
            own, shared = costs[name]
            return int((rejected[name] & alive).sum()) / (own + sum(s for value, s in shared.items() if value not in done))

        best = min((r.name for r in rules if r.name not in order), key=lambda name: (-rate(name), name))
        order.append(best)
        done |= costs[best][1].keys()
        alive &= ~rejected[best]
    return order


def first_texts(part: Iterator, n: int) -> list[str | None]:
    """The first texts of a partition, in a worker that drops before what other modules keep there."""
    let_go()
    give_back()
    return [row[0] for row in islice(part, n)]


def sampled_texts(docs: DataFrame, text: str) -> list[str | None]:
    """About ``SAMPLE_ROWS`` texts, the first ones of ``SAMPLE_PARTS`` partitions picked by chance; no other is read."""
    rows = docs.select(text).rdd
    n = rows.getNumPartitions()
    picked = sorted(random.Random(SAMPLE_ROWS).sample(range(n), min(n, SAMPLE_PARTS)))
    each = -(-SAMPLE_ROWS // max(1, len(picked)))
    return docs.sparkSession.sparkContext.runJob(rows, lambda part: first_texts(part, each), picked)


def order_on_sample(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", have: tuple[str, ...] = ()) -> list[str]:
    return measured_order(rules, Texts(*X.texts(pa.array(sampled_texts(docs, text), pa.string()))), have)


def cascade(t: Texts, rules: list[Rule], alive: np.ndarray) -> np.ndarray:
    """Which of the texts alive no rule rejects; each rule sees only those that are left."""
    kept = np.flatnonzero(alive)
    now = t if len(kept) == len(t) else _view(t, alive)
    for rule in rules:
        if not len(kept):
            break
        out = rule.rejects(now)
        if out.any():
            kept, now = kept[~out], _view(now, ~out)
    verdict = np.zeros(len(t), bool)
    verdict[kept] = True
    return verdict


class _view:  # noqa: N801 - a texts-like view
    """The texts of a piece whose flags are set; counts that it has are picked, others computed on these texts only."""

    def __init__(self, of, flags: np.ndarray):
        self.of, self.rows, self._own = of, np.flatnonzero(flags), None

    def __len__(self) -> int:
        return len(self.rows)

    def has(self, name: str) -> bool:
        return self.of.has(name) or self._own is not None and self._own.has(name)

    def get(self, name: str):
        if name in ("words", "prefix", "lines"):
            raise KeyError(f"{name} is not a count")
        if self.of.has(name):
            return self.of.get(name)[self.rows]
        return self.own().get(name)

    def own(self) -> Texts:
        """A copy of these texts alone."""
        if self._own is None:
            self._own = self.of.own().take(self.rows)
        return self._own

    def take(self, rows: np.ndarray) -> Texts:
        return self.own().take(rows)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the counts in STATS, base_failed and kept for every row of docs."""
    ship(docs.sparkSession)
    by_name = {r.name: r for r in rules}
    order = order_on_sample(docs, rules, text, (*STATS, "words", "prefix", "lines"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = [by_name[n] for n in order]
        for batch in batches:
            data, offsets = X.texts(batch.column(1))
            parts: dict[str, list] = {k: [] for k in (*STATS, "base_failed", "kept")}
            for _, _, d, o in X.pieces(data, offsets):
                t = Texts(d, o)
                for k in STATS:
                    parts[k].append(t.get(k))
                failed = BASE_RULES[0].rejects(t) | BASE_RULES[1].rejects(t)
                parts["base_failed"].append(failed)
                parts["kept"].append(cascade(t, ordered, ~failed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.concatenate(v).astype(np.int64 if k in STATS else bool) if v else [], pa.int64() if k in STATS else pa.bool_()) for k, v in parts.items())],
                [id_col, *parts],
            )

    stats = ", ".join(f"{k} long" for k in STATS)
    return docs.select(id_col, text).mapInArrow(slim(run), f"{id_col} {id_type}, {stats}, base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, that no rule rejects: one pass, no join."""
    ship(docs.sparkSession)
    by_name = {r.name: r for r in (*BASE_RULES, *rules)}
    order = order_on_sample(docs, (*BASE_RULES, *rules), text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = [by_name[n] for n in order]
        for batch in batches:
            data, offsets = X.texts(batch.column(at))
            kept = [np.zeros(0, bool)]
            for _, _, d, o in X.pieces(data, offsets):
                t = Texts(d, o)
                kept.append(cascade(t, ordered, np.ones(len(t), bool)))
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(slim(run), docs.schema)
