"""Exact dedup over an extendible-hash index on shared files.

1. One pass writes the key (64-bit hash, SHA-256, size) of every text to the shared folder.
2. Directory: slots are the first bits of the key.  Distinct keys are counted by slot; starting from one bucket,
   an overfull bucket is split by one more bit, and the directory doubles when a bucket is as deep as it.
3. Build: each map task combines its copies first (a copy adds to a count, its text is not sent), so a text that
   a third of all rows share reaches its bucket once for each task.  Owner tasks take ranges of the directory
   and insert keys bucket by bucket: texts of one key are chained and compared byte by byte.
4. The buckets are written to the shared folder as the index, and every row looks its key up there.

Texts are equal when identical after lower-casing A-Z.  Null counts as empty.  Of equal texts the largest id
stays (null ids last); rows that repeat an id and a text count in the size and share its fate.  An empty table
gives an empty result.  Further columns of docs are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import bytesx as X
from harrow.llm.shared import shared_path, ship, slim, written

#: Distinct text bytes a bucket may hold before it is split, at least.
BUCKET_BYTES = 32 << 20
#: Distinct text bytes a map task holds while it combines copies.
COMBINE_BYTES = 48 << 20
#: Most buckets of an index (about); beyond, buckets grow with the input.  It bounds the directory, which the driver makes
#: from four counts for each bucket and every task has a copy of.  An owner streams its bucket in order of keys and holds
#: the chain of one key only, so a bucket's size is no bound on memory.
MOST_BUCKETS = 1 << 16


class Directory:
    """slot (the first `depth` bits of a key) -> bucket.  Buckets are numbered in the order of keys."""

    def __init__(self, depth: int, bucket_of_slot: np.ndarray):
        self.depth, self.bucket_of_slot = depth, bucket_of_slot

    @property
    def buckets(self) -> int:
        return int(self.bucket_of_slot[-1]) + 1

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return self.bucket_of_slot[(keys >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)]

    @staticmethod
    def grown(load: np.ndarray, capacity: int) -> Directory:
        """Splits overfull buckets of a directory of one until none is left or the slots of `load` are reached."""
        deepest = int(len(load)).bit_length() - 1
        total = np.concatenate(([0], np.cumsum(load)))
        depth, done, todo = 0, [], [(0, 0)]
        while todo:
            prefix, local = todo.pop()
            width = 1 << (deepest - local)
            if total[(prefix + 1) * width] - total[prefix * width] > capacity and local < deepest:
                depth = max(depth, local + 1)  # the directory doubles when a bucket gets deeper than it
                todo += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
            else:
                done.append((prefix << (deepest - local), local))
        slots = np.zeros(1 << depth, np.int32)
        for number, (first, local) in enumerate(sorted(done)):
            at = first >> (deepest - depth)
            slots[at : at + (1 << (depth - local))] = number
        return Directory(depth, slots)


def _hash(text: bytes, bits: int) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h if bits == 64 else (h >> (64 - bits)) << (64 - bits)


def normal(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.ascii_lower(column), "").cast(pa.binary())


def text_keys(docs: DataFrame, id_col: str, text: str, bits: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v.as_buffer() for v in normal(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array([_hash(v, bits) for v in values], np.uint64).view(np.int64)), pa.array([len(v) for v in values], pa.int64()), pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())],
                ["id", "key", "n_bytes", "sha"],
            )

    return docs.select(id_col, text).mapInArrow(slim(run), f"id {id_type}, key long, n_bytes long, sha string")


def _combine(directory: Directory, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, names = 0, ["bucket", "key", "text", "keep_id", "n"]
        id_type = None

        def out():
            keys = np.array([_hash(t, bits) for t in held], np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array(directory.bucket(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], id_type), pa.array([v[1] for v in held.values()], pa.int64())], names
            )

        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), normal(batch.column(1)).to_pylist(), strict=True):
                if (have := held.get(t)) is None:
                    held[t] = [i, 1]
                    size += len(t)
                else:
                    have[1] += 1
                    if have[0] is None or i is not None and i > have[0]:
                        have[0] = i
                if size > COMBINE_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return run


def _insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and key: entries of one key are a chain, in which texts are compared."""
    key, chain, id_type = None, [], None

    def out(chains):
        rows = [(b, k, slot, len(c), e[0], e[1], e[2] if len(c) > 1 else None) for b, k, c in chains for slot, e in enumerate(c)]
        columns = list(zip(*rows, strict=True))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), id_type, pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "key", "slot", "chain", "keep_id", "n", "text"])

    done: list = []
    for batch in batches:
        id_type = batch.column(3).type
        for b, k, t, i, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if chain:
                    done.append((bucket, key, chain))  # noqa: F821 - set with key
                bucket, key, chain = b, k, []
            for entry in chain:
                if entry[2] == t:
                    entry[1] += n
                    if entry[0] is None or i is not None and i > entry[0]:
                        entry[0] = i
                    break
            else:
                chain.append([i, n, t])
        if done:
            yield out(done)
            done = []
    if chain:
        yield out([*done, (bucket, key, chain)])


def build_index(docs: DataFrame, keys: DataFrame, id_col: str, text: str, bits: int, bucket_bytes: int) -> DataFrame:
    """The index: bucket, key, slot in the chain, length of the chain, keep_id, n, text (of chains over one)."""
    spark = docs.sparkSession
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    bucket_bytes = max(bucket_bytes, -(-total // MOST_BUCKETS))
    # two bits beyond an even spread; deeper buckets go on as overflow pages of their owner
    bits_deep = min(bits, 40, max(0, int(total // bucket_bytes).bit_length()) + 2)
    load = np.zeros(1 << bits_deep, np.int64)
    slot = F.shiftrightunsigned("key", 64 - bits_deep) if bits_deep else F.lit(0)
    distinct = keys.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"))
    for row in distinct.groupBy(slot.cast("long").alias("slot")).agg(F.sum("n_bytes").alias("b")).collect():  # four rows for each bucket at most
        load[row.slot] = row.b
    directory = Directory.grown(load, bucket_bytes)
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(id_col, text).mapInArrow(slim(_combine(directory, bits)), f"bucket int, key long, text binary, keep_id {id_type}, n long")
    owned = sent.repartitionById(directory.buckets, "bucket").sortWithinPartitions("bucket", "key")
    index = owned.mapInArrow(slim(_insert), f"bucket int, key long, slot int, chain int, keep_id {id_type}, n long, text binary")
    path = shared_path(spark, "index")
    index.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 64, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for every row of docs.  bits: of the key's hash (fewer in tests of chains)."""
    ship(docs.sparkSession)
    keys = written(text_keys(docs, id_col, text, bits), "keys")
    index = build_index(docs, keys, id_col, text, bits, bucket_bytes)
    alone = index.where("chain = 1").select("key", "keep_id", F.col("n").alias("group_size"))
    found = keys.select("id", "key", "sha").join(alone, "key", "left")
    if index.where("chain > 1").limit(1).count():
        # the few keys that different texts share: rows find their slot by the text's own digest
        chained = index.where("chain > 1").select("key", F.sha2("text", 256).alias("sha"), F.col("keep_id").alias("k2"), F.col("n").alias("n2"))
        found = found.join(chained, ["key", "sha"], "left").select("id", "sha", F.expr("if(n2 is null, keep_id, k2)").alias("keep_id"), F.coalesce("n2", "group_size").alias("group_size"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts left, all columns as they were."""
    groups = exact_groups(docs.select(id_col, text), id_col, text)
    gone = groups.where(~F.col("kept")).select(F.col(id_col).alias("id__"), F.col("text_sha256").alias("gone__")).distinct()
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # rows are told apart by id and text, as ids may repeat or be null
    named = docs.withColumn("sha__", F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), upper, small), 256))
    left = named.join(gone, F.col(id_col).eqNullSafe(F.col("id__")) & (F.col("sha__") == F.col("gone__")), "left_anti")
    return left.dropDuplicates([id_col, "sha__"]).select(docs.columns)
