"""Near-duplicate groups: MinHash with tensored banding, candidates verified on full shingle sets.

A row of two small collections of band keys (``BANDS`` each, of ``ROWS`` minhashes) stands for BANDS * BANDS
tables: table (i, j) is keyed by the pair of the i-th key of one collection and the j-th of the other, so
2 * BANDS * ROWS minhashes serve BANDS**2 tables.  A pair of Jaccard similarity 0.8 shares a table with
probability (1 - (1 - 0.8**ROWS)**BANDS)**2, 0.9998 with these values.

* Rows of equal shingle sets are one class; only the least id of a class is looked up.
* The pairs of keys are formed only for ids that meet another in the first collection.
* In each table every id is compared with the least id of its entry (minimum by key, then a join: no list of
  members).  Entries whose members then lie in different components are compared across components, where
  sizes and sketches still allow the similarity, so no link between different texts is lost by the star.
* Of texts that meet many others (in an entry of over ``HOT`` members, or ``CROWD`` in all entries), pairs that share a
  shingle of at most ``RARE`` of these texts are met by that shingle; all others have at most their other shingles
  in common, which rules out all but a few pairs however large the group.  What is left of large entries is met
  by the keys of the first collection, so that a member stands in ``BANDS`` of them at most, and cut into blocks.
* Every candidate is verified on full sets; components are those of the verified links.

Nulls: a null text has no shingles and is linked with nothing, like one without words; a text of fewer than
four words is one shingle.  Null ids are linked with nothing.  Rows that repeat an id are told apart by their
text where there are any; rows alike in both share a component and whether they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm import bytesx as X
from harrow.llm.graph import components, with_edges
from harrow.llm.shared import discard, ship, shuffle_partitions, slim, written

BANDS, ROWS = 9, 2
#: Of 2 * BANDS * ROWS minhashes, equal ones that a later candidate needs (3.7 standard deviations below 0.8).
LEAST_EQUAL = 20
#: Members of an entry that are compared across components in one unit of work.
BLOCK = 2_000
#: Members from which an entry counts as hot, and texts that may have a shingle that counts as rare.
HOT, RARE = 64, 64
#: Others (met again in each entry) from which a text counts as one that meets many.
CROWD = 1_000
#: Shingles of such texts (about, and with their repeats) that are counted together.
BUCKET = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct hashes of the k-word shingles of each text, in order; A-Z lower-cased."""
    data = X.lower(data)
    starts, ends, row = X.words(data, offsets)
    h = X.span_hash(X.prefix(data), starts, ends)
    grams = X.window_hash(h, k)
    bound = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:  # the whole sequence, told from shingles by its length
            out.append(X.window_hash(h[a:b], b - a) ^ np.uint64(0xA5A5 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, id_col: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), k1 and k2 (128 bits of the set), a and b (band keys), s (minhashes, 32 bits of each)."""
    n_hash = 2 * bands * rows
    odd = X.mix(np.arange(1, n_hash + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    flip = X.mix(np.arange(1001, n_hash + 1001, dtype=np.uint64))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.texts(batch.column(1))
            for first, end, d, o in X.pieces(data, offsets):
                sets = shingle_sets(d, o, k)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((2, len(sets)), np.uint64)
                least = np.zeros((len(sets), n_hash), np.uint64)
                if len(full):
                    x = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    keys[0, full] = np.add.reduceat(X.mix(x), at)
                    keys[1, full] = np.add.reduceat(X.mix(x ^ np.uint64(0x1F123BB5)), at)
                    for i in range(n_hash):
                        least[full, i] = np.minimum.reduceat((x ^ flip[i]) * odd[i], at)
                band = np.zeros((len(sets), 2 * bands), np.uint64)
                for i in range(rows):
                    band = X.mix(band * np.uint64(31) + least[:, i * 2 * bands : (i + 1) * 2 * bands] + np.arange(2 * bands, dtype=np.uint64)[None, :])
                lists = [pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(np.ascontiguousarray(part).view(np.int64).ravel())) for part in (band[:, :bands], band[:, bands:])]
                sketch = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * n_hash, pa.array((least >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), *(pa.array(x.view(np.int64)) for x in keys), *lists, sketch], ["id", "n", "k1", "k2", "a", "b", "s"])

    return docs.select(id_col, text).mapInArrow(slim(run), f"id {id_type}, n long, k1 long, k2 long, a array<long>, b array<long>, s array<int>")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, c) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("id").alias("c"), F.col("text").alias("tc")), "c")
    id_type = pairs.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_set = None, None
        for batch in batches:
            ids = batch.column(1).to_pylist()
            data, offsets = X.texts(batch.column(2))
            other, other_offsets = X.texts(batch.column(3))
            good: list[bool] = []
            for first, _, d, o in X.pieces(data, offsets):
                for j, s in enumerate(shingle_sets(d, o, k)):
                    i = first + j
                    if ids[i] != last_id or last_set is None:  # rows of one c mostly come together
                        p, q = other_offsets[i], other_offsets[i + 1]
                        last_id, last_set = ids[i], shingle_sets(other[p:q], np.array([0, q - p]), k)[0]
                    shared = int(X.among(s, last_set).sum())
                    good.append(100 * shared >= percent * (len(s) + len(last_set) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "c"]).filter(pa.array(good, pa.bool_()))

    return both.select("x", "c", "tx", "tc").mapInArrow(slim(run), f"x {id_type}, c {id_type}")


def _rare(texts: DataFrame, k: int, buckets: int) -> DataFrame:
    """g, id, m: shingles that 2 to ``RARE`` of the texts (id, text) have, with that number; and rows of a null g, where m
    is how many shingles (of a bucket) an id alone has.

    Shingles are counted by bucket.  Each piece of texts sends one row to each bucket, in which a shingle that more than
    ``RARE`` of the piece have stands once, without ids: what a bucket is sent of a shingle that all texts share does not
    grow with these.
    """
    id_type = texts.schema["id"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.texts(batch.column(1))
            for first, _, d, o in X.pieces(data, offsets):
                sets = shingle_sets(d, o, k)
                row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                order = np.argsort(flat, kind="stable")
                flat, row = flat[order], row[order]
                begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
                n = np.diff(np.append(begin, len(flat)))
                of = (X.mix(flat[begin]) % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(of, kind="stable")
                few = n <= RARE
                at = np.concatenate([np.zeros(0, np.int64), *(np.arange(begin[i], begin[i] + n[i]) for i in by[few[by]].tolist())])
                sent, first_of = np.unique(of[by], return_index=True)
                bound = np.append(first_of, len(by)).astype(np.int32)
                held = np.concatenate(([0], np.cumsum(np.where(few, n, 0)[by])))[bound].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sent),
                        pa.ListArray.from_arrays(bound, pa.array(flat[begin][by].view(np.int64))),
                        pa.ListArray.from_arrays(bound, pa.array(n[by].astype(np.int32))),
                        pa.ListArray.from_arrays(held, pa.array(row[at].astype(np.int32))),
                        pa.ListArray.from_arrays(held, batch.column(0).take(pa.array(first + row[at]))),
                    ],
                    ["bucket", "g", "n", "row", "ids"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None

        def settle() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            g, n, row, ids = (t[c].combine_chunks() for c in ("g", "n", "row", "ids"))
            key, many = g.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64)
            _, of = np.unique(key, return_inverse=True)
            total = np.bincount(of, weights=many).astype(np.int64)[of]
            few = many <= RARE
            m = np.repeat(total[few], many[few])  # of each id sent
            shingle = np.repeat(key[few], many[few])
            flat_ids, piece = ids.flatten(), np.repeat(np.arange(len(t)), np.diff(ids.offsets.to_numpy()))
            rare = np.flatnonzero((m > 1) & (m <= RARE))
            alone = np.flatnonzero(m == 1)
            _, one, times = np.unique(piece[alone] << 32 | row.flatten().to_numpy()[alone], return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(shingle[rare]), pa.nulls(len(one), pa.int64())]),
                    flat_ids.take(pa.array(np.concatenate((rare, alone[one])))),
                    pa.array(np.concatenate((m[rare], times))),
                ],
                ["g", "id", "m"],
            )

        for batch in batches:
            names = batch.column(0).to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)])).tolist()
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if j > i:
                    if names[i] != bucket and held:
                        yield settle()
                    held.append(batch.slice(i, j - i))
                    bucket = names[i]
        if held:
            yield settle()

    sent = texts.select("id", "text").mapInArrow(slim(send), f"bucket int, g array<long>, n array<int>, row array<int>, ids array<{id_type}>")
    dealt = sent.repartition(shuffle_partitions(texts.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(slim(count), f"g long, id {id_type}, m long")


def _rare_pairs(low: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, c), x > c, in different components that share a rare shingle, where the similarity is possible.

    low: g, id, m of ``_rare``; facts: id, n, core, g of its ids.  A shingle has at most ``RARE`` texts, so pairs grow
    with the texts, not with the square of a group.
    """
    rows = low.where("g is not null").select(F.col("g").alias("s"), "id").join(facts, "id")
    a, b = (rows.select("s", *(F.col(c).alias(c + end) for c in ("id", "n", "core", "g"))) for end in ("1", "2"))
    fits = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    both = a.join(b.hint("merge"), "s").where((F.col("id1") > F.col("id2")) & (F.col("g1") != F.col("g2")) & fits)
    both = both.groupBy(F.col("id1").alias("x"), F.col("id2").alias("c"), "n1", "n2", "core1", "core2").agg(F.count(F.lit(1)).alias("shared"))
    most = F.least("core1", "core2") + F.col("shared")
    return both.where(100 * most >= percent * (F.col("n1") + F.col("n2") - most)).select("x", "c")


def _across(small: DataFrame, hot: DataFrame | None, facts: DataFrame, percent: int, least: int, best: bool) -> DataFrame:
    """Pairs (x, c), x > c, of an entry's members in different components whose sizes and sketches allow the similarity.

    small: t, id, g, i, j of entries that are compared whole.  hot: t, id, g, i, main, blocks of larger ones: main is the
    entry's largest component, whose members come to one block each; the others come to every block.
    facts: id, n, core (-1 where it is not known), s, a, b.  best: for each member outside the largest component only
    the one with the most equal minhashes; else all, each pair where both first meet.
    """
    id_type = facts.schema["id"].dataType.simpleString()
    none = F.lit(None).cast("array<long>")
    columns = ["t", "q", "own", "main", "id", "g", "i", "j"]
    units = small.select("t", F.lit(0).alias("q"), F.lit(True).alias("own"), F.lit(None).cast("boolean").alias("main"), "id", "g", "i", "j")
    if hot is not None:
        met = hot.withColumn("p", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("main", F.col("g") == F.col("main"))
        others = met.where(~F.col("main")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        for part in (met.where("main").withColumn("q", F.col("p")), others):
            units = units.unionByName(part.select("t", "q", (F.col("p") == F.col("q")).alias("own"), "main", "id", "g", "i", F.lit(0).cast("byte").alias("j")))
    keys = [none.alias("a"), none.alias("b")] if best else [F.col("a"), F.when(F.col("main").isNull(), F.col("b")).alias("b")]
    units = units.join(facts, "id").select(*columns, "n", "core", "s", *keys)
    dealt = units.repartition(shuffle_partitions(facts.sparkSession), "t", "q").sortWithinPartitions("t", "q", "id")

    def compare(t: pa.Table):
        ids = t["id"].combine_chunks()
        own, g, n, core, i_at, j_at = (t[c].to_numpy() for c in ("own", "g", "n", "core", "i", "j"))
        whole = t["main"].null_count > 0
        if whole:
            names, size = np.unique(g, return_counts=True)
            main = g == names[size.argmax()]
        else:
            main = t["main"].to_numpy()
        if not best:  # each pair only where it first meets: in a small entry's table, or by a key of the first collection
            a, b = (t[c].combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if whole or c == "a" else None for c in ("a", "b"))
        s = t["s"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        place = np.arange(len(n))
        x, c = [], []
        for i in np.flatnonzero(~main).tolist():
            # core counts among the texts that have it
            most = np.where(core >= 0, np.minimum(core, core[i]), np.minimum(n, n[i])) if core[i] >= 0 else np.minimum(n, n[i])
            ok = (g != g[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (100 * most >= percent * (n + n[i] - most))
            if not best:
                ok &= main | (place < i) if own[i] else main
                ok &= (a[:, : i_at[i]] != a[i, : i_at[i]]).all(1)
                if whole:
                    ok &= (b[:, : j_at[i]] != b[i, : j_at[i]]).all(1)
            j = np.flatnonzero(ok)
            if not len(j):
                continue
            equal = (s[j] == s[i]).sum(1)
            if best:
                j = j[[int(equal.argmax())]] if equal.max() >= least else j[:0]
            else:
                j = j[equal >= least]
            x.append(np.maximum(i, j))
            c.append(np.minimum(i, j))
        if x:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(x))), ids.take(pa.array(np.concatenate(c)))], ["x", "c"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def settle():
            t = pa.Table.from_batches(held)
            held.clear()
            return compare(t)

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(2)], 1)
            edge = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)])).tolist()
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if j == i:
                    continue
                now = tuple(key[i])
                if now != last and held and (out := settle()) is not None:
                    yield out
                held.append(batch.slice(i, j - i))
                last = now
        if held and (out := settle()) is not None:
            yield out

    return dealt.mapInArrow(slim(run), f"x {id_type}, c {id_type}")


def _grouped(docs: DataFrame, sigs: DataFrame, id_col: str, text: str, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of sigs, the signatures of docs."""
    keyed, n_rows = sigs.where("n > 0 and id is not null"), sigs.count()
    classes = written(keyed.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes", rows=n_rows)
    reps = keyed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    reps = written(reps.select("id", "n", "a", "b", "s"), "reps", narrow=True)

    half = reps.select("id", F.posexplode("a").alias("i", "a"))
    met = half.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("a")
    half = half.join(met, "a").join(reps.select("id", "b"), "id")
    keyed_tables = half.select("id", "i", "a", F.posexplode("b").alias("j", "b")).select("id", F.col("i").cast("byte").alias("i"), F.col("j").cast("byte").alias("j"), F.xxhash64("a", "b").alias("t"), F.col("a").alias("u"))
    tables = written(keyed_tables, "tables", narrow=True)
    entries = tables.groupBy("t").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("t", "c")
    near = tables.join(entries, "t").where("id != c").select(F.col("id").alias("x"), "c").distinct()
    sizes = reps.select("id", "n")
    near = near.join(sizes.toDF("x", "nx"), "x").join(sizes.toDF("c", "nc"), "c")
    near = written(near.where(100 * F.least("nx", "nc") >= percent * F.greatest("nx", "nc")).select("x", "c"), "pairs", narrow=True)
    wanted = tables.join(entries, "t").select("id").distinct()  # ids that meet another in some table
    texts = written(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi").dropDuplicates(["id"]), "texts")
    links = written(_verified(near, texts, k, percent), "links", narrow=True)
    comp = written(components(links, "x", "c"), "components", rows=n_rows)

    # Entries whose members are still apart are compared across components.
    tried = near
    least = LEAST_EQUAL * (2 * bands * rows) // (2 * BANDS * ROWS)

    def apart(crowded: DataFrame) -> DataFrame:
        """crowded with the members' components, of entries where these differ, and m, the members of the entry."""
        g = F.coalesce("component", "id")
        g = F.xxhash64(g) if isinstance(facts.schema["id"].dataType, StructType) else g  # only compared
        names = [c for c in ("t", "id", "i", "j", "u") if c in crowded.columns]
        placed = written(crowded.join(comp.withColumnRenamed("node", "id"), "id", "left").select(*names, g.alias("g")), "placed", narrow=True)
        still = placed.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi").select("t", "m")
        out = written(placed.join(still, "t"), "crowded", narrow=True)
        discard(placed)
        return out

    def tries(pairs: DataFrame) -> bool:
        """Verifies pairs not tried yet; whether they join components."""
        nonlocal tried, comp
        pairs = written(pairs.distinct().join(tried, ["x", "c"], "left_anti"), "across", narrow=True)
        more = written(_verified(pairs, texts, k, percent), "links", rows=20 * pairs.count())  # the same tasks compare texts
        tried = tried.union(pairs)
        if not more.limit(1).count():
            return False
        comp = written(with_edges(comp, more, "x", "c"), "components", rows=n_rows)
        return True

    facts = reps.select("id", "n", F.lit(-1).cast("long").alias("core"), "s", "a", "b")
    crowded = apart(tables.join(entries.select("t"), "t"))
    discard(tables)
    meets = crowded.groupBy("id").agg(F.first("g").alias("g"), F.max("m").alias("most"), F.sum(F.col("m") - 1).alias("all"))
    members = written(meets.where((F.col("most") > HOT) | (F.col("all") >= CROWD)).select("id", "g"), "members", rows=n_rows)
    if members.limit(1).count():
        # Shingles that few of these texts have tell which of them can be alike: a pair that shares none of these has at
        # most the lesser number of other shingles in common.
        shingles = reps.join(members, "id", "left_semi").agg(F.sum("n")).first()[0]
        low = written(_rare(texts.join(members, "id", "left_semi"), k, 16 + shingles // BUCKET), "rare", narrow=True)
        core = low.groupBy("id").agg(F.sum(F.when(F.col("g").isNull(), F.col("m")).otherwise(1)).alias("low"))
        core = members.select("id").join(core, "id", "left").select("id", F.coalesce("low", F.lit(0)).alias("low"))
        known = F.coalesce(F.col("n") - F.col("low"), F.lit(-1)).alias("core")
        facts = written(reps.join(core, "id", "left").select("id", "n", known, "s", "a", "b"), "facts", narrow=True)
        tries(_rare_pairs(low, members.join(facts.select("id", "n", "core"), "id"), percent))
        # what else a member of a hot entry may be like has nearly all its shingles among the others
        few = facts.where((F.col("core") >= 0) & (100 * F.col("core") < percent * F.col("n"))).select("id")
        hot = crowded.where(F.col("m") > HOT).join(few, "id", "left_anti").select(F.col("u").alias("t"), "id", "i").distinct()
        small, hot = apart(crowded.where(F.col("m") <= HOT).drop("u")), apart(hot)
        discard(crowded)
    else:
        small, hot = crowded.drop("u"), None
    best = True
    while True:
        large = None
        if hot is not None:
            largest = hot.groupBy("t", "g").agg(F.count(F.lit(1)).alias("size")).groupBy("t").agg(F.max_by("g", F.struct("size", "g")).alias("main"))
            large = hot.join(largest, "t").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        joined = tries(_across(small, large, facts, percent, least, best))
        if not best:
            break
        best = joined
        if joined:
            before = [x for x in (small, hot) if hasattr(x, "_written_path")]
            small, hot = apart(small), hot if hot is None else apart(hot)
            discard(*before)

    out = sigs.join(classes, ["k1", "k2", "n"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _rows(docs: DataFrame, id_col: str, text: str, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, bool]:
    """id, n_shingles, component_id, kept of every row, and whether ids repeat: then id is (id, h), h a hash of the text."""
    ship(docs.sparkSession)
    sigs = written(signatures(docs, id_col, text, k, bands, rows), "signatures")
    repeats = sigs.where("n > 0 and id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0
    if repeats:
        named = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
        docs = docs.select(F.when(F.col(id_col).isNotNull(), named).alias("id"), F.col(text).alias("text"))
        id_col, text = "id", "text"
        sigs = written(signatures(docs, id_col, text, k, bands, rows), "signatures")
    return _grouped(docs, sigs, id_col, text, k, percent, bands, rows), repeats


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs."""
    out, repeats = _rows(docs, id_col, text, k, percent, bands, rows)
    if repeats:
        out = out.withColumns({"id": F.col("id.id"), "component_id": F.col("component_id.id")})
    return out.withColumnRenamed("id", id_col)


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of the least id of each near-duplicate group left, all columns as they were."""
    groups, repeats = _rows(docs.select(id_col, text), id_col, text, **options)
    if not repeats:
        return docs.join(groups.where(~F.col("kept")).select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti").select(docs.columns)
    facts = groups.where("id is not null and n_shingles > 0").select(F.col("id.id").alias("id__"), F.col("id.h").alias("h__"), F.col("kept").alias("kept__")).distinct()
    # rows without an id or shingles are linked with nothing
    found = docs.withColumn("text_h__", F.xxhash64(text)).join(facts, (F.col(id_col) == F.col("id__")) & (F.col("text_h__") == F.col("h__")), "left")
    single = found.where("kept__").dropDuplicates(["id__", "h__"])
    return found.where("kept__ is null").union(single).select(docs.columns)
