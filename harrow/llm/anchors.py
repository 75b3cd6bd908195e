"""Where long strings repeat: anchors of windows, candidates among them, and segments dealt to shards.

A window of W consecutive symbols (bytes or words) has an anchor: the least hash of the k-symbol strings in it.
Equal windows have equal anchors at equal places, so a window that repeats has an anchor found twice or more.
Anchors are one in some tens of bytes (or one in seven words); they are counted over the whole corpus and tell
which stretches of a document can hold a repeated window, and in which shard its equals are looked for: that of
the first document with the same anchor.

No group is gathered: counts are sums and minima by anchor, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import bytesx as X
from harrow.llm.shared import shuffle_partitions, slim, written


#: Bits for places beside the hash: the same everywhere, so that equal windows choose alike.
_PLACE = np.uint64(31)


def window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the anchor of each window of `width` consecutive hashes: the least hash, the last of equal ones."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    low = (np.uint64(1) << _PLACE) - np.uint64(1)
    packed = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    return (low - (X.sliding_min(packed, width) & low)).astype(np.int64)


class Symbols:
    """The symbols of a piece of texts: place, hash of each k-string, and text's row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, k: int):
        self.data, self.offsets = data, offsets
        s = X.prefix(data)
        if unit == "byte":
            self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            n = max(0, len(data) - k + 1)
            self.hash = X.mix((s[k : k + n] - s[:n]) * X.powers(len(s))[1][:n])
            self.starts = self.ends = None
        else:
            self.starts, self.ends, self.row = X.words(data, offsets)
            self.hash = X.window_hash(X.span_hash(s, self.starts, self.ends), k)
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))


def _anchored(x: Symbols, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first symbol of each window inside one text, place of its anchor)."""
    width = window - k + 1
    at = window_anchors(x.hash, width)
    n = max(0, len(x.row) - window + 1)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(x.row[:n] == x.row[window - 1 :][:n])
    return whole, at[whole]


def count_anchors(docs: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """anchor, rid, n: anchors of each document (rid, text) and how often each occurs in it (2 for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.texts(batch.column(1))
            rid = batch.column(0).to_numpy()
            for first, _, d, o in X.pieces(data, offsets):
                x = Symbols(d, o, unit, k)
                _, at = _anchored(x, window, k)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at  # places never go back
                # order by text and value: a value's repeats in a text become one row
                row, value = x.row[at].astype(np.int64), x.hash[at]
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                begin = np.flatnonzero(new)
                n = np.minimum(np.diff(np.append(begin, len(row))), 2)
                if len(begin):
                    yield pa.RecordBatch.from_arrays([pa.array(value[begin].view(np.int64)), pa.array(rid[row[begin] + first]), pa.array(n.astype(np.int8))], ["anchor", "rid", "n"])

    return docs.select("rid", "text").mapInArrow(slim(run), "anchor long, rid long, n byte")


def candidates(found: DataFrame, shards: int) -> DataFrame:
    """rid, hits (array of anchor and shard): anchors found twice or more, by document.

    An anchor's shard is that of one document that has it, the same choice for all anchors, so that passages
    copied together stay together.
    """
    twice = found.groupBy("anchor").agg(F.sum("n").alias("m"), F.min("rid").alias("ref")).where("m > 1")
    twice = twice.select("anchor", F.pmod("ref", F.lit(shards)).cast("int").alias("shard"))
    hits = found.join(twice, "anchor").select("rid", "anchor", "shard")
    return hits.groupBy("rid").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("shard").alias("shards"))  # bounded by the document


def segments(h: np.ndarray, window: int, k: int, anchors: np.ndarray, shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, first symbol, symbol after the last) of the runs of windows whose anchors are candidates, in a text
    whose k-strings have the hashes h."""
    at = window_anchors(h, window - k + 1)
    if not len(at) or not len(anchors):
        return []
    order = np.argsort(anchors)
    anchors, shards = anchors[order], shards[order]
    spot = np.searchsorted(anchors, h[at])
    spot[spot == len(anchors)] = 0
    shard = np.where(anchors[spot] == h[at], shards[spot], -1)
    edge = np.flatnonzero(np.diff(shard)) + 1
    begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(shard)]))
    return [(int(shard[i]), i, j - 1 + window) for i, j in zip(begin.tolist(), end.tolist(), strict=True) if shard[i] >= 0]


class Judge:
    """Takes segments in order of (document, place); gives for each which of its windows are removed, which windows have
    no equal among the segments taken before (those stand for their equals elsewhere), and, if it tells them apart,
    which have one."""

    #: Whether the first of equal windows is not removed, and whether earlier ones are told apart.
    keeps_first, earlier = True, False

    def batches(self) -> int:
        """Symbols after which what was taken may be judged and forgotten."""
        raise NotImplementedError

    def judge(self, segments: list, more: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError


def window_keys(body: bytes, unit: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window of a segment."""
    data = np.frombuffer(body, np.uint8)
    out = []
    for d in (data, _OTHER[data]):
        s = X.prefix(d)
        if unit == "byte":
            n = max(0, len(data) - window + 1)
            out.append(X.mix((s[window : window + n] - s[:n]) * X.powers(len(s))[1][:n]))
        else:
            starts, ends, _ = X.words(data, np.array([0, len(data)]))
            out.append(X.window_hash(X.span_hash(s, starts, ends), window))
    return out[0], out[1]


#: Bytes that a word counts for.
WORD_BYTES = 8
#: A permutation of bytes, for a second hash.
_OTHER = (np.arange(256) * 167 + 13).astype(np.uint8)


def spans_by_window(sent: DataFrame, unit: str, window: int, judge: Judge) -> DataFrame:
    """id, rid, begin, end, early as in repeated_spans for the segments sent, by the key of each window.

    For shards that are too large for one task: what is held together is a window's equals, of which each map task
    has sent one.
    """
    id_type = sent.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins = batch.column(2).to_pylist()
            for i, body in enumerate(batch.column(3).to_pylist()):
                h1, h2 = window_keys(body, unit, window)
                at = pa.array(np.zeros(len(h1), np.int64))
                alike = [batch.column(c).slice(i, 1).take(at) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*alike, pa.array(np.arange(begins[i], begins[i] + len(h1))), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "rid", "begin", "h1", "h2"])

    rows = sent.select("id", "rid", "begin", "body").mapInArrow(slim(run), f"id {id_type}, rid long, begin long, h1 long, h2 long")
    place = F.struct("id", "rid", "begin")
    groups = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    told = rows.join(groups, ["h1", "h2"]).withColumn("early", ~place.eqNullSafe(F.col("first")))
    spans = ["id", "rid", "begin", (F.col("begin") + window).alias("end")]
    gone = told.where("early") if judge.keeps_first else told
    out = gone.select(*spans, F.lit(False).alias("early"))
    return out.union(told.where("early").select(*spans, "early")) if judge.earlier else out


def repeated_spans(docs: DataFrame, unit: str, window: int, k: int, shard_bytes: int, judge: Callable[[], Judge]) -> DataFrame:
    """id, rid, begin, end, early: spans of symbols, each a run of windows that the judge removes, or (early) of those
    that have an equal earlier.

    docs: id, rid, text; rows alike in all three count as one.  First each task judges the segments of its own documents, which removes what repeats
    among them and leaves one copy of each window; then shards judge the copies that are left.  So a group of
    copies of any size reaches its shard as one copy from each run of documents.  A shard of over twice
    shard_bytes is held by no task: its windows are compared by their keys.
    """
    spark = docs.sparkSession
    if docs.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        docs = docs.dropDuplicates(["id", "rid"])  # combined before the shuffle, so that none is sent many times
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    id_type = docs.schema["id"].dataType.simpleString()
    found = written(count_anchors(docs, unit, window, k), "anchors")
    hits = written(candidates(found, shards), "hits")
    own = docs.join(hits, "rid").select("id", "rid", "text", "anchors", "shards").sortWithinPartitions("id", "rid")
    schema = f"shard int, id {id_type}, rid long, begin long, end long, body binary"
    names = ["shard", "id", "rid", "begin", "end", "body"]

    def packed(rows: list[tuple], types) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def told(i, r: int, begin: int, gone: np.ndarray, early: list[np.ndarray]) -> list[tuple]:
        """Spans: shard is null for those that go, else -1; no body."""
        return [(shard, i, r, begin + int(a), begin + int(b) - 1 + window, None) for shard, flags in zip((None, -1), (gone, *early), strict=False) for a, b in zip(*X.runs(flags), strict=True)]

    def kinds(arrow_id) -> tuple:
        return (pa.int32(), arrow_id, pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, held, size, types = judge(), [], 0, None

        def settle(more: bool) -> list[tuple]:
            rows = []
            for (shard, i, r, begin, body), (gone, first, *early) in zip(held, j.judge([h[4] for h in held], more), strict=True):
                rows += told(i, r, begin, gone, early)
                rows += [(shard, i, r, begin + int(a), begin + int(b) - 1 + window, _joined(body, int(a), int(b) - 1 + window, unit)) for a, b in zip(*X.runs(first), strict=True)]
            held.clear()
            return rows

        for batch in batches:
            types = kinds(batch.column(0).type)
            ids, rids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = X.texts(batch.column(2))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(3), batch.column(4))]
            for row in range(len(ids)):
                d = data[offsets[row] : offsets[row + 1]]
                x = Symbols(d, np.array([0, len(d)]), unit, k)
                anchors, of_shard = (v[o[row] : o[row + 1]] for o, v in lists)
                found_here = segments(x.hash, window, k, anchors.view(np.uint64), of_shard)
                for shard, a, b in found_here:
                    body = d[a:b] if unit == "byte" else [d[p:q].tobytes() for p, q in zip(x.starts[a:b].tolist(), x.ends[a:b].tolist(), strict=True)]
                    held.append((shard, ids[row], rids[row], a, body))
                    size += b - a
                if size >= j.batches():
                    if rows := settle(True):
                        yield packed(rows, types)
                    size = 0
        if held and (rows := settle(False)):
            yield packed(rows, types)

    first = written(own.mapInArrow(slim(local), schema), "segments")
    sent = first.where("body is not null")

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, held, at, types = judge(), [], None, None
        streams = j.batches() == 1

        def settle() -> list[tuple]:
            rows = []
            for (i, r, begin, _), (gone, _, *early) in zip(held, j.judge([h[3] for h in held], False), strict=True):
                rows += told(i, r, begin, gone, early)
            held.clear()
            return rows

        for batch in batches:
            types, rows = kinds(batch.column(1).type), []
            for shard, i, r, begin, _, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if held:
                        rows += settle()
                    j.forget()
                    at = shard
                held.append((i, r, begin, np.frombuffer(body, np.uint8) if unit == "byte" else body.split(b" ")))
                if streams:
                    rows += settle()
            if rows:
                yield packed(rows, types)
        if held and (rows := settle()):
            yield packed(rows, types)

    limit = 2 * shard_bytes // (1 if unit == "byte" else WORD_BYTES)
    large = sent.groupBy("shard").agg(F.sum(F.col("end") - F.col("begin")).alias("n")).where(F.col("n") > limit).select("shard")
    apart = None
    if large.limit(1).count():
        large = written(large, "large", rows=0)
        apart = spans_by_window(sent.join(large, "shard", "left_semi"), unit, window, judge())
        sent = sent.join(large, "shard", "left_anti").select(sent.columns)
    by_shard = sent.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "id", "rid", "begin")
    second = by_shard.mapInArrow(slim(owned), schema)
    spans = ["id", "rid", "begin", "end", F.col("shard").isNotNull().alias("early")]
    found = first.where("body is null").select(spans).union(second.select(spans))
    return written(found.union(apart) if apart is not None else found, "spans")


def _joined(body, a: int, b: int, unit: str) -> bytes:
    return body[a:b].tobytes() if unit == "byte" else b" ".join(body[a:b])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """id, text, begins, ends (arrays, null where nothing is removed), early_begins, early_ends for every row of docs."""
    lists = [F.collect_list(F.when(F.col("early") == early, F.col(c))).alias(("early_" if early else "") + c + "s") for early in (False, True) for c in ("begin", "end")]
    by_doc = spans.groupBy("id", "rid").agg(*lists)  # bounded by the document
    by_doc = by_doc.withColumnsRenamed({"id": "i2", "rid": "r2"})
    both = docs.join(by_doc, (F.col("rid") == F.col("r2")) & F.col("id").eqNullSafe(F.col("i2")), "left")
    return both.select("id", "text", "begins", "ends", "early_begins", "early_ends")


def identified(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, rid, text; rid tells rows apart that share an id, and rows alike in both are one document."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), body).alias("rid"), body.alias("text"))
