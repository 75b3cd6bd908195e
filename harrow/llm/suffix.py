"""Suffix-array dedup: longest-previous-factor arrays find byte strings that occur before or after.

Windows of the threshold's length are put in suffix order by prefix doubling (sorts of packed ranks).  In that
order the previous and the next smaller place of each window, with the least common prefix on the way, give its
longest match with an earlier place (longest previous factor); the same with places reversed gives later matches.
With keep="first" a window goes if it has an earlier match, with keep="none" if it has any other.

Matches never cross documents.  Nulls: a null text is empty.  Rows alike in id and text are one document and get
one result; a null id comes first.  Documents shorter than the threshold stay whole.
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

LENGTH, ANCHOR = 400, 64
#: Bytes of input for each shard, and of segments that a map task judges together.
SHARD_BYTES, LOCAL_BYTES = 4 << 20, 1 << 20


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (first, second), equal for equal pairs."""
    n = len(first)
    bits, wide = max(1, int(n).bit_length()), max(1, int(max(first.max(initial=0), second.max(initial=0))).bit_length())
    if 2 * wide + bits <= 64:  # the sort of packed numbers is many times faster than an indirect one
        b = np.uint64(bits)
        packed = np.sort((((first.astype(np.uint64) << np.uint64(wide)) | second.astype(np.uint64)) << b) | np.arange(n, dtype=np.uint64))
        place = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        pair = packed >> b
    else:
        place = np.lexsort((second, first))
        pair = None
    new = np.ones(n, bool)
    if pair is not None:
        new[1:] = pair[1:] != pair[:-1]
    else:
        new[1:] = (first[place][1:] != first[place][:-1]) | (second[place][1:] != second[place][:-1])
    rank = np.empty(n, np.int64)
    rank[place] = np.cumsum(new) - 1
    return rank


class SuffixOrder:
    """Windows of `length` bytes of several strings: ranks of their prefixes of 4, 8, 16 ... bytes."""

    def __init__(self, data: np.ndarray, left: np.ndarray, length: int, levels: bool = True):
        """left: bytes from each place to the end of its string.  levels: ranks of all prefixes are kept, for lcp()."""
        self.levels: list[tuple[int, np.ndarray]] = []  # (h, rank of the h bytes from a place on; negative and distinct near an end)
        n, h = len(data), 4 if length >= 4 else 1
        alone = -1 - np.arange(n) if levels else None
        rank = data.astype(np.int64)
        if h == 4:
            four = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
            rank = _dense(four[:n] << 8 | four[1 : n + 1], four[2 : n + 2] << 8 | four[3 : n + 3])
        while True:
            if levels:
                self.levels.append((h, np.where(left >= h, rank, alone)))
            if h == length:
                break
            step = h if 2 * h <= length else length - h
            at = np.flatnonzero(left >= h + step)
            out = np.zeros(n, np.int64)
            if len(at):
                out[at] = _dense(rank[at], rank[at + step])
            rank, h = out, h + step
        self.places = np.flatnonzero(left >= length)
        key = rank[self.places]
        b = np.uint64(32)
        self.order = (np.sort((key.astype(np.uint64) << b) | self.places.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.length, self.rank = length, rank

    def lcp(self, floor: int) -> np.ndarray:
        """Common prefix of each window in suffix order with the one before, up to the window's length; 0 first.
        One below floor counts as 0; with levels for all, a floor of the window's length needs the last only."""
        a, b = self.order[:-1], self.order[1:]
        if floor >= self.length:
            n = np.where(self.rank[a] == self.rank[b], self.length, 0)
        else:
            n = np.zeros(len(a), np.int64)
            last = len(self.levels[0][1]) - 1
            for h, rank in reversed(self.levels):
                p, q = np.minimum(a + n, last), np.minimum(b + n, last)
                n += np.where((n + h <= self.length) & (rank[p] == rank[q]), h, 0)
            n[n < floor] = 0
        return np.concatenate(([0], n)) if len(self.order) else n


def smaller_match(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each in suffix order, the longest common prefix with a smaller value of `order`: over its previous and
    next smaller places, found by jumping along those of larger neighbours."""
    n = len(order)
    best = np.zeros(n, np.int64)
    for back in (False, True):
        o = order[::-1] if back else order
        # reach[i]: common prefix of i with to[i], at first its neighbour before
        reach = (np.concatenate((lcp[1:], [0]))[::-1] if back else lcp).copy()
        to = np.arange(-1, n - 1)
        todo = np.flatnonzero((to >= 0) & (reach > 0))
        reach[to < 0] = 0
        while len(todo):
            todo = todo[o[to[todo]] > o[todo]]
            nearer = to[todo]
            reach[todo] = np.minimum(reach[todo], np.where(to[nearer] >= 0, reach[nearer], 0))
            to[todo] = to[nearer]
            dead = (to[todo] < 0) | (reach[todo] == 0)
            reach[todo[dead]] = 0
            todo = todo[~dead]
        best = np.maximum(best, reach[::-1] if back else reach)
    return best


def previous_factors(data: np.ndarray, left: np.ndarray, length: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the windows, longest previous factor, longest following factor), up to the window's length.
    Factors below floor count as 0, which saves following them."""
    s = SuffixOrder(data, left, length, floor < length)
    lcp = s.lcp(floor)
    earlier, later = smaller_match(s.order, lcp), smaller_match(-s.order, lcp)
    out = np.zeros((2, len(data)), np.int64)
    out[0, s.order], out[1, s.order] = earlier, later
    return s.places, out[0, s.places], out[1, s.places]


class Factors(A.Judge):
    def __init__(self, length: int, keep: str, earlier: bool = False, local_bytes: int = LOCAL_BYTES):
        self.length, self.keep, self.earlier, self.local = length, keep, earlier, local_bytes
        self.keeps_first = keep == "first"

    def batches(self) -> int:
        return self.local

    def forget(self) -> None:
        pass

    def judge(self, segments: list, more: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(s) for s in segments])
        end = np.cumsum(sizes)
        data = np.concatenate(segments)
        left = np.repeat(end, sizes) - np.arange(len(data))
        places, earlier, later = previous_factors(data, left, self.length, self.length)
        first = earlier < self.length
        gone = ~first if self.keep == "first" else ~first | (later >= self.length)
        cut = np.searchsorted(places, end)[:-1]
        flags = (gone, first, ~first) if self.earlier else (gone, first)
        return list(zip(*(np.split(x, cut) for x in flags), strict=True))


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "first", keep_text: bool = False, earlier: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (with earlier also n_earlier, with keep_text kept_bytes) for every row of docs.

    n_earlier: bytes covered by a string of the threshold's length that also starts earlier (in a row of a smaller id,
    or earlier in the same one), which is what keep="first" removes.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    ship(docs.sparkSession)
    own = A.identified(docs, id_col, text)
    spans = A.repeated_spans(own, "byte", length, min(ANCHOR, length), SHARD_BYTES, lambda: Factors(length, keep, earlier))
    id_type = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.texts(batch.column(1))
            removed, n_spans, sha, kept_bytes, n_earlier = [], [], [], [], []
            for i, (begins, ends, early_begins, early_ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                d = data[offsets[i] : offsets[i + 1]]
                runs = 0
                n_earlier.append(int(X.covered(len(d), np.array(early_begins), np.array(early_ends) - np.array(early_begins)).sum()) if early_begins else 0)
                if begins:
                    gone = X.covered(len(d), np.array(begins), np.array(ends) - np.array(begins))
                    runs, d = len(X.runs(gone)[0]), d[~gone]
                kept = d.tobytes()
                removed.append(int(offsets[i + 1] - offsets[i]) - len(kept))
                n_spans.append(runs)
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_bytes.append(kept if keep_text else None)
            columns = [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            more = {"n_earlier": pa.array(n_earlier, pa.int64())} if earlier else {}
            more |= {"kept_bytes": pa.array(kept_bytes, pa.binary())} if keep_text else {}
            yield pa.RecordBatch.from_arrays([*columns, *more.values()], [*names, *more])

    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_earlier long" * earlier + ", kept_bytes binary" * keep_text
    return A.with_spans(own, spans).mapInArrow(slim(run), schema).withColumnRenamed("id", id_col)
