"""Language-model scores by prediction by partial matching over byte contexts, beside a word-count base.

The model is a trie of contexts of up to five bytes, learnt from the training rows.  A byte is coded in the
longest known context; where it has not been seen there an escape is coded (a byte seen n times counts 2n - 1, an
escape as many as there are distinct bytes) and the next shorter context is tried without the bytes already excluded; under
the empty context all bytes are alike.  A text ends with byte 0xFF, which UTF-8 never has, and begins after 0xFE.

Everything the trie decides depends on the last six bytes only.  So strings of six bytes are counted over the
corpus, shorter contexts are sums of these, and the log probability of each distinct string is worked out once,
by joins.  Texts are then scored by looking strings up: the most frequent ones (at most ``TABLE_ROWS``, a bound
on what is broadcast) in a table that each worker has, all others by a join.  Words of the base likewise.
Nothing is dropped: the bound only says which way a string is looked up.  Contexts of up to two bytes are tables of at
most 65,536 rows, which are broadcast too.

Nulls: a null text is empty (one end token, one end byte); a null id counts as a training row.  Rows alike in id
and text get the same scores.  With no training rows every token is unknown and bytes are alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import bytesx as X
from harrow.llm.shared import ship, slim, written

ORDER = 5
#: Most entries of each table that workers hold: 16 bytes each.
TABLE_ROWS = 1_000_000
#: Bytes of text scored together: some hundred bytes of arrays stand beside each.
SCORED_BYTES = 1 << 19
#: Counts that a map task merges before it sends them: 16 bytes each, and as many again while they are merged.
TALLIES = 2_000_000
BEGIN, END, SYMBOLS = 0xFE, 0xFF, 256


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the last ORDER + 1 bytes at each byte and end of the texts as a number, first place of each text)."""
    n, rows = len(data), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded = np.full(n + (ORDER + 1) * rows, BEGIN, np.uint8)
    padded[np.arange(n) + (ORDER + 1) * row + ORDER] = data
    ends = offsets[1:] + (ORDER + 1) * np.arange(1, rows + 1) - 1
    padded[ends] = END
    wide = padded.astype(np.uint64)
    key = np.zeros(len(padded) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        key = (key << np.uint64(8)) | wide[i : i + len(key)]
    inside = np.ones(len(padded), bool)
    begins = offsets[:-1] + (ORDER + 1) * np.arange(rows)
    for i in range(ORDER):
        inside[begins + i] = False
    return key[inside[ORDER:]], offsets[:-1] + np.arange(rows)


def _tally(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs (or the sum of its weights)."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        s = np.sort(values)
    else:
        order = np.argsort(values)
        s, weights = values[order], weights[order]
    begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[begin], np.add.reduceat(weights, begin) if weights is not None else np.diff(np.append(begin, len(s)))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = X.words(data, offsets)
    return X.span_hash(X.prefix(data), starts, ends), row


WORD, GRAM = 0, 1


class _Tallies:
    """Counts of strings and words, merged until there are ``TALLIES`` of them."""

    def __init__(self):
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, kind: int, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((kind, keys, n))
        self.size += len(keys)

    def merge(self) -> None:
        """One part of each kind."""
        merged = []
        for kind in (WORD, GRAM):
            own = [x for x in self.parts if x[0] == kind]
            if own:
                merged.append((kind, *_tally(np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own]))))
        self.parts, self.size = merged, sum(len(x[1]) for x in merged)

    def out(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for kind, key, n in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])
        self.parts, self.size = [], 0


def count_training(docs: DataFrame) -> DataFrame:
    """kind, key, n: words and strings of ORDER + 1 bytes of docs (rid, held, text), n over training rows (strings: 0 too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _TABLES.clear()  # of an earlier call in this worker
        tallies = _Tallies()
        for batch in batches:
            held = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            data, offsets = X.texts(batch.column(2))
            for first, end, d, o in X.pieces(data, offsets):
                d = X.lower(d)
                h, row = word_hashes(d, o)
                tallies.add(WORD, *_tally(h[~held[first:end][row]]))
                key, begin = strings(d, o)
                out = np.repeat(held[first:end], np.diff(np.append(begin, len(key))))
                tallies.add(GRAM, *_tally(key[~out]))
                unseen = _tally(key[out])[0]
                tallies.add(GRAM, unseen, np.zeros(len(unseen), np.int64))
                if tallies.size > TALLIES:
                    tallies.merge()
                    if tallies.size > TALLIES // 2:
                        yield from tallies.out()
        yield from tallies.out()

    counted = docs.select("rid", "held", "text").mapInArrow(slim(run), "kind byte, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def trie_costs(grams: DataFrame) -> DataFrame:
    """key, n, cost: log10 probability of the last byte of each string after those before, under PPM.

    Levels that need a shuffle are plans of their own: Spark plans, logs and watches a plan anew after each of its
    shuffles, so that one plan of all levels takes the driver hundreds of MB.  A string whose last byte is known at
    a level is priced and goes no further.
    """

    def low(c: str, k: int) -> Column:
        return F.col(c).bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))

    def sent(df: DataFrame, key_bytes: int) -> DataFrame:
        """Tables with keys of at most two bytes have 65,536 rows at most and go to all tasks: dealt by so few keys, a task would have all rows of the most frequent."""
        return F.broadcast(df) if key_bytes <= 2 else df

    entries = {ORDER: grams.where("n > 0").select("key", "n")}
    for k in range(ORDER - 1, -1, -1):
        entries[k] = written(entries[k + 1].groupBy(low("key", k).alias("key")).agg(F.sum("n").alias("n")), "trie", narrow=True)
    costs, priced = grams.select("key", "n", F.lit(False).alias("done"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("qv"), F.lit(0).cast("long").alias("xv"), F.lit(0).cast("long").alias("q0")), []
    for k in range(ORDER, -1, -1):
        e = entries[k]
        node = e.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum(2 * F.col("n") - 1).alias("nu"), F.count(F.lit(1)).alias("qu"))
        if k:
            # bytes seen in this context, as they count in the next shorter one, where they are excluded
            below = e.select(F.shiftright("key", 8).alias("ctx"), low("key", k - 1).alias("low")).join(sent(entries[k - 1].select(F.col("key").alias("low"), (2 * F.col("n") - 1).alias("m")), k), "low")
            node = node.join(below.groupBy("ctx").agg(F.sum("m").alias("xu")), "ctx")
        else:
            node = node.withColumn("xu", F.lit(0).cast("long"))
        costs = costs.withColumn("ctx", F.shiftright(low("key", k), 8)).join(sent(node, k), "ctx", "left")
        if k == ORDER:  # the strings themselves
            costs = costs.withColumn("ns", F.when(F.col("n") > 0, 2 * F.col("n") - 1))
        else:
            costs = costs.withColumn("e", low("key", k)).join(sent(e.select(F.col("key").alias("e"), (2 * F.col("n") - 1).alias("ns")), k + 1), "e", "left")
        new, left = F.col("qu") - F.col("qv"), F.col("nu") - F.col("xv")
        all_left = (new + left).cast("double")
        step = F.when(F.col("done") | F.col("nu").isNull() | (new == 0), 0.0).otherwise(F.log10(F.coalesce(F.col("ns"), new) / all_left))
        costs = costs.select(
            "key", "n", (F.col("done") | F.col("ns").isNotNull()).alias("done"), (F.col("cost") + step).alias("cost"),
            F.coalesce("qu", "qv").alias("qv"), F.coalesce("xu", "xv").alias("xv"), F.coalesce("qu", F.lit(0)).alias("q0"),
        )
        if k > 2:
            costs = written(costs, "costs", narrow=True)
            priced.append(costs.where("done").select("key", "n", "cost"))
            costs = costs.where("not done")
    uniform = -F.log10((F.lit(SYMBOLS) - F.col("q0")).cast("double"))
    priced.append(written(costs.select("key", "n", (F.col("cost") + F.when(F.col("done"), 0.0).otherwise(uniform)).alias("cost")), "costs", narrow=True))
    return reduce(DataFrame.union, priced)


class Table:
    """Numbers by 64-bit key: open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.key, self.value, self.full = np.zeros(size, np.uint64), np.zeros(size, np.float64), np.zeros(size, bool)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], step)
            free = np.flatnonzero(~self.full[slot])
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.key[slot[won]], self.value[slot[won]], self.full[slot[won]] = keys[todo[won]], values[todo[won]], True
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, step = todo[left], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)) + np.uint64(step) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """NaN where a key is not there."""
        slot = self._slot(keys, 0)
        hit = self.full[slot] & (self.key[slot] == keys)
        out = np.where(hit, self.value[slot], np.nan)
        todo, step = np.flatnonzero(~hit & self.full[slot]), 1
        while len(todo) and step < self.steps:
            slot = self._slot(keys[todo], step)
            hit = self.full[slot] & (self.key[slot] == keys[todo])
            out[todo[hit]] = self.value[slot[hit]]
            todo, step = todo[~hit & self.full[slot]], step + 1
        return out


def most_frequent(df: DataFrame, rows: int) -> tuple[int, DataFrame]:
    """(n, the entries of df counted n times or more, at most `rows`)."""
    top = 1 << 20
    by_n = df.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("k")).groupBy(F.expr("if(n < 1024, n, cast(pow(2, ceil(log2(n))) as long))").alias("n")).agg(F.sum("k").alias("k"))
    have, least = 0, None
    for n, k in sorted(((r.n, r.k) for r in by_n.collect()), reverse=True):  # some 1,040 rows
        if have + k > rows:
            break
        # a class above 1,024 holds the counts down to just over half of it
        have, least = have + k, n if n <= 1024 else n // 2 + 1
    least = 1 << 62 if least is None else least
    return least, df.where(F.col("n") >= least)


_TABLES: dict[str, tuple] = {}


def _tables(sent, name: str) -> tuple[Table, Table]:
    """A worker's tables; name is that of one call of score()."""
    if name not in _TABLES:
        _TABLES.clear()
        (wk, wv), (gk, gv) = sent.value
        _TABLES[name] = (Table(wk, wv), Table(gk, gv))
        vars(sent).pop("_value", None)  # a worker that lives on would keep what it was sent beside the tables
    return _TABLES[name]


def _arrays(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("key", F.col(value).cast("double").alias("v")).toArrow()
    return t["key"].to_numpy().view(np.uint64), t["v"].to_numpy()


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: Column | None = None, table_rows: int = TABLE_ROWS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs; learns where not held."""
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), body).alias("rid"), (held if held is not None else is_held_out(F.col(id_col))).alias("held"), body.alias("text"))
    counts = written(count_training(own), "counts", "kind")
    words = counts.where(f"kind = {WORD}").select("key", "n")
    costs = trie_costs(counts.where(f"kind = {GRAM}").select("key", "n"))
    ends = own.where(~F.col("held")).count()
    n_words, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, types = n_words + ends, v + (ends > 0)

    common = words.withColumn("cost", F.log10((F.col("n") + 1).cast("double")))
    _, top_words = most_frequent(common, table_rows)
    _, top_grams = most_frequent(costs, table_rows)
    sent = spark.sparkContext.broadcast((_arrays(top_words, "cost"), _arrays(top_grams, "cost")))
    name = uuid.uuid4().hex
    id_type = own.schema["id"].dataType.simpleString()
    end_cost, one = float(np.log10(ends + 1.0)), float(np.log10(float(total + (types + 1))))

    def lists(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
        """Distinct keys of each row and their counts."""
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(keys)))
        bound = np.searchsorted(row[begin], np.arange(rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(bound, pa.array(keys[begin].view(np.int64))), pa.ListArray.from_arrays(bound, pa.array(n.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table, gram_table = _tables(sent, name)
        for batch in batches:
            data, offsets = X.texts(batch.column(3))
            for first, end, d, o in X.pieces(data, offsets, SCORED_BYTES):
                d, rows = X.lower(d), end - first
                h, row = word_hashes(d, o)
                cost = word_table.get(h)
                there = ~np.isnan(cost)
                n_tokens = np.bincount(row, minlength=rows) + 1
                base = np.bincount(row[there], cost[there], rows).astype(np.float64)
                known = np.bincount(row[there], minlength=rows)
                wk, wn = lists(h[~there], row[~there], rows)
                key, begin = strings(d, o)
                p = gram_table.get(key)
                missing = np.isnan(p)
                at = np.flatnonzero(missing)
                gk, gn = lists(key[at], np.searchsorted(begin, at, "right") - 1, rows)
                p[at] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, rows) for c in batch.columns[:3]), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(np.add.reduceat(p, begin)), wk, wn, gk, gn],
                    ["id", "rid", "held", "n_tokens", "known", "base", "p", "wk", "wn", "gk", "gn"],
                )

    schema = f"id {id_type}, rid long, held boolean, n_tokens long, known long, base double, p double, wk array<long>, wn array<int>, gk array<long>, gn array<int>"
    scored = written(own.mapInArrow(slim(run), schema), "scored")

    def rest(keys: str, n: str, table: DataFrame, name: str) -> DataFrame:
        """rid, sum of cost * n, sum of n of what the workers' table has not."""
        rows = scored.where(F.size(keys) > 0).select("rid", F.explode(F.arrays_zip(keys, n)).alias("x")).select("rid", F.col(f"x.{keys}").alias("key"), F.col(f"x.{n}").alias("m"))
        found = rows.join(table.select("key", "cost"), "key").groupBy("key", "rid").agg(F.max("m").alias("m"), F.max("cost").alias("cost"))  # rows alike count once
        return found.groupBy("rid").agg(F.sum(F.col("m") * F.col("cost")).alias(f"{name}_sum"), F.sum("m").alias(f"{name}_n"))

    out = scored.drop("wk", "wn", "gk", "gn").join(rest("wk", "wn", common, "w"), "rid", "left").join(rest("gk", "gn", costs, "g"), "rid", "left")
    known_end = int(ends > 0)
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("w_n", F.lit(0)) + known_end).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("w_sum", F.lit(0.0)) + end_cost - F.col("n_tokens") * F.lit(one)).alias("base_score"), (F.col("p") + F.coalesce("g_sum", F.lit(0.0))).alias("score"),
    )
