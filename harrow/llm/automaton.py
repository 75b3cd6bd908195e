"""Substring dedup with suffix automata: matching statistics of documents against reference shards.

A shard's automaton holds every stretch of its documents that no earlier one has.  Documents are streamed in
order of id: the automaton gives for each word the length of the longest match that ends there; windows inside a
match of the threshold or more are removed, and only what is new is added, with the automaton itself telling
repeats inside the document.  The first occurrence of a window stays.

Which automaton a document's stretch meets is settled by its anchors (``harrow.llm.anchors``), so each automaton
is held by one task and met by the documents that can match it, instead of every automaton by every document.

Nulls: a null text has no words.  Rows alike in id and text are one document and get one result; rows that
share an id otherwise are ordered by a hash.  A null id comes first.  Documents of fewer words than a window are
kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm import anchors as A
from harrow.llm import bytesx as X
from harrow.llm.shared import ship, slim

WINDOW, ANCHOR = 20, 8
#: Bytes of input for each shard, and states after which a map task begins a new automaton.
SHARD_BYTES, LOCAL_STATES = 4 << 20, 200_000


class SuffixAutomaton:
    """Of several sequences; grows online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def matches(self, words: list) -> list[int]:
        """Length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.len
        v = n = 0
        out = []
        for w in words:
            to = nxt[v].get(w)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = nxt[v].get(w)
                if to is None:
                    v = n = 0
                    out.append(0)
                    continue
                n = length[v]
            n += 1
            v = to
            out.append(n)
        return out

    def add(self, words: list) -> list[int]:
        """Adds a sequence; length of the longest suffix at each word that was there before, this sequence included."""
        nxt, link, length = self.next, self.link, self.len
        last = 0
        out = []
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, w, q)
                out.append(length[last])
                continue
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, w, q)
            out.append(length[link[cur]])
            last = cur
        return out

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy


class KeepFirst(A.Judge):
    def __init__(self, window: int, states: int = LOCAL_STATES):
        self.window, self.states, self.automaton = window, states, SuffixAutomaton()

    def batches(self) -> int:
        return 1

    def forget(self) -> None:
        self.automaton = SuffixAutomaton()

    def judge(self, segments: list, more: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        t = self.window
        for words in segments:
            gone = np.array(self.automaton.matches(words)[t - 1 :]) >= t
            for a, b in zip(*X.runs(~gone), strict=True):  # new stretches
                gone[a:b] = np.array(self.automaton.add(words[a : b - 1 + t])[t - 1 :]) >= t
            out.append((gone, ~gone))
        if more and len(self.automaton.len) > self.states:
            self.forget()
        return out


def drop_repeated_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (with keep_text also kept_text) for every row of docs."""
    ship(docs.sparkSession)
    k = min(ANCHOR, window)
    own = A.identified(docs, id_col, text)
    spans = A.repeated_spans(own, "word", window, k, SHARD_BYTES, lambda: KeepFirst(window))
    id_type = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.texts(batch.column(1))
            begins, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, removed, sha, kept_texts = [], [], [], []
            for first, _, d, o in X.pieces(data, offsets):
                starts, stops, row = X.words(d, o)
                bound = np.searchsorted(row, np.arange(len(o))).tolist()
                raw = d.tobytes()
                for i, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
                    words = [raw[p:q] for p, q in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True)]
                    if begins[first + i]:
                        gone = X.covered(b - a, np.array(begins[first + i]), np.array(ends[first + i]) - np.array(begins[first + i]))
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = b" ".join(words)
                    n.append(b - a)
                    removed.append(b - a - len(words))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode() if keep_text else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept_texts, pa.string())] if keep_text else [])], [*names, *(["kept_text"] if keep_text else [])])

    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return A.with_spans(own, spans).mapInArrow(slim(run), schema).withColumnRenamed("id", id_col)
