"""Mixing sources to target weights, with DataFrame functions only.

Words of each source are packed into blocks of a fixed length, in the order of a hash of the row's id.  Targets
share all words by weight and stop at three times a source's size (the excess is reshared).  A source's target
gives its number of draws; the draws of all sources lie on one line of slots, and a pseudorandom permutation of
that line, picked by a seed, deals them to output shards: the counts of a shard are multinomial draws on condition of
the totals (multivariate hypergeometric), so each source meets its target to half a block.  The i-th draw of a source
takes the block that a permutation of its indices of the same kind gives for i, a fresh one each time round, so no
block is taken more than three times.  Blocks are joined to draws by (source, index); ``dealt`` has the mix by shard and slot,
``mixed`` and ``taken_words`` by row, for which the deal makes no difference.

Nulls: a null text has no words, a null source is a source of its own, last in order; null ids have size but,
like repeated ids, are packed as rows of their own.  No words at all: every count is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.llm.shared import shuffle_partitions, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
SEED = 3
#: Of the Feistel permutation that deals draws to slots: rounds, and walks at most (all but n below 4,096 end in one or two, and those in 64).
ROUNDS, WALKS = 6, 64
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Rows (about, and at least) that are put in order together while offsets are summed.
GROUP_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it, and that of a text's first one.
SPACED, SPACE_BEFORE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r"^[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(i: Column, n: Column, seed: Column | int) -> Column:
    """A pseudorandom permutation of 0 .. n-1 (n below 2^60) that seed picks: Feistel rounds of modular addition, walked until inside."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def once(x: Column) -> Column:
        def turn(v: Column, r: Column) -> Column:
            left, right = F.floor(v / b), v % b
            f = F.xxhash64(F.when(r % 2 == 0, right).otherwise(left), r, n, seed)
            return F.when(r % 2 == 0, F.pmod(left + F.pmod(f, a), a) * b + right).otherwise(left * b + F.pmod(right + F.pmod(f, b), b))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, turn)

    walks = F.sequence(F.lit(1), F.lit(WALKS))
    return F.aggregate(walks, once(i), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target of the sources in sizes (source, source_size): water-filling in closed form.

    With sources in the order of cap / weight, the first ones are capped while the level that the others would
    share exceeds their own ratio.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    a = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    a = a.withColumn("cap", F.col("source_size") * float(MOST_TIMES)).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = ranked.rowsBetween(W.unboundedPreceding, -1), ranked.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    a = a.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    a = a.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    a = a.withColumn("rank", F.row_number().over(ranked))  # the level is that of the first source that is not capped
    a = a.withColumn("final", F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("rank"))).over(everything))
    return a.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    spread = F.xxhash64(F.col(id_col), F.lit(11))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("h"), word_count(F.col(text)).alias("size"), spread.alias("spread"))
    # rows alike in id, source and text are numbered, so that KEY tells all rows apart
    return sized.withColumn("copy", F.row_number().over(W.partitionBy("id", "source", "h").orderBy("spread")))


KEY = ("id", "source", "h", "copy")


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Equal KEY; b has it as id_, source_, h_, copy_."""
    return a["id"].eqNullSafe(b["id_"]) & a["source"].eqNullSafe(b["source_"]) & (a["h"] == b["h_"]) & (a["copy"] == b["copy_"])


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, draws).

    rows: KEY, size, source_size, target, start (place of its first word among its source's words).
    parts: KEY, block, first and n (words of the row, counted from 0, that lie in the block).
    draws: source, block, times, shard, slot: one row for each draw.
    """
    sized = written(_sized(docs, id_col, text, source), "sized")  # texts are read once
    # rows in groups of bounded size: a group's words are summed in one task, groups by their totals
    # and there are no more groups than rows in one
    each = F.greatest(F.lit(float(GROUP_ROWS)), F.sqrt(F.col("n_rows").cast("double")))
    groups = F.pmod("spread", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / each)).cast("long"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(per_source.select("source", "source_size"))
    facts = targets.join(per_source.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    facts = facts.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    facts = facts.withColumn("draws", F.least(F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long"), F.col("blocks") * MOST_TIMES))
    facts = written(facts, "facts")
    grouped = sized.join(facts.select(F.col("source").alias("s"), "n_rows", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("grp", groups)
    totals = grouped.groupBy("source", "grp").agg(F.sum("size").alias("group_size"))
    before = W.partitionBy("source").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("grp").alias("g"), F.coalesce(F.sum("group_size").over(before), F.lit(0)).alias("group_start"))
    inside = W.partitionBy("source", "grp").orderBy("spread", "id", "h", "copy").rowsBetween(W.unboundedPreceding, -1)
    rows = grouped.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # merge joins by hint: sizes are estimated before rows are exploded, and no such side may be broadcast
    rows = rows.join(totals.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("grp") == F.col("g")))
    rows = rows.select(*KEY, "size", "source_size", "target", (F.col("group_start") + F.col("inner")).alias("start"))
    rows = written(rows, "rows")
    n = F.lit(block_words)
    first, last = F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n)
    parts = rows.where("size > 0").select(*KEY, "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * n), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n)
    parts = parts.select(*KEY, "block", (low - F.col("start")).alias("first"), (high - low).alias("n"))
    # draws, in runs of a thousand so that no row bears a source's whole list
    run = 1000
    line = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    lined = facts.where("draws > 0").withColumn("from", F.coalesce(F.sum("draws").over(line), F.lit(0)))
    lined = lined.withColumn("all_draws", F.sum("draws").over(W.partitionBy(F.lit(1))))
    chunked = lined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / run))).alias("c"))
    chunked = chunked.repartition(shuffle_partitions(docs.sparkSession), F.col("source"), F.col("c"))  # few bytes, but work for all cores
    drawn = chunked.select("source", "blocks", "from", "all_draws", F.explode(F.sequence(F.col("c") * run, F.least(F.col("draws"), (F.col("c") + 1) * run) - 1)).alias("i"))
    time_round = F.floor(F.col("i") / F.col("blocks"))
    place = shuffled(F.col("from") + F.col("i"), F.col("all_draws"), seed)
    key = F.xxhash64("source", time_round, F.lit(seed))
    draws = drawn.select("source", shuffled(F.col("i") % F.col("blocks"), F.col("blocks"), key).alias("block"), time_round.alias("times"), F.floor(place / shard_slots).alias("shard"), (place % shard_slots).alias("slot"))
    return rows, parts, draws


def shard_counts(draws: DataFrame) -> DataFrame:
    """shard, source, n: how many draws of each source a shard has."""
    return draws.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n"))


def dealt(parts: DataFrame, draws: DataFrame) -> DataFrame:
    """The mix by place: parts of every draw, with its times, shard and slot."""
    d = draws.select(F.col("source").alias("s"), F.col("block").alias("b"), "times", "shard", "slot")
    return parts.join(d.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")


def taken_parts(parts: DataFrame, draws: DataFrame) -> DataFrame:
    """parts that the mix takes, with k, the number of times."""
    takes = draws.groupBy("source", "block").agg(F.count(F.lit(1)).alias("k")).select(F.col("source").alias("s"), F.col("block").alias("b"), "k")
    return parts.join(takes.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")


def taken_words(rows: DataFrame, parts: DataFrame, draws: DataFrame) -> DataFrame:
    """id, size, source_size, target, taken for each of rows."""
    taken = taken_parts(parts, draws).groupBy(*KEY).agg(F.sum(F.col("n") * F.col("k")).alias("taken"))
    taken = taken.select(*(F.col(c).alias(c + "_") for c in KEY), "taken").hint("merge")
    out = rows.join(taken, _same(rows, taken), "left")
    return out.select("id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows with the columns of docs: for the first, second and third time that words of a row are
    taken one row each, with the words taken that many times and the white space between them (the text as it was
    where these are all)."""
    rows, parts, draws = mix_plan(docs, id_col, text, source, **options)
    taken = taken_parts(parts, draws).groupBy(*KEY).agg(F.collect_list(F.struct("first", "n", "k")).alias("taken"))  # bounded by the row
    sizes = rows.select(*(F.col(c).alias(c + "_") for c in KEY), "size")
    taken = taken.join(sizes.hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("h") == F.col("h_")) & (F.col("copy") == F.col("copy_")))
    # further columns of docs may have any name but one that ends as these do
    taken = taken.select(*(F.col(c).alias(f"key_{c}__") for c in KEY), F.col("size").alias("size__"), F.array_sort("taken").alias("taken__"))
    numbered = docs.withColumn("h__", F.xxhash64(F.col(text)))
    numbered = numbered.withColumn("copy__", F.row_number().over(W.partitionBy(id_col, source, "h__").orderBy(F.lit(1))))
    same = F.col(id_col).eqNullSafe(F.col("key_id__")) & F.col(source).eqNullSafe(F.col("key_source__")) & (F.col("h__") == F.col("key_h__")) & (F.col("copy__") == F.col("key_copy__"))
    both = numbered.join(taken.hint("merge"), same)
    most = F.aggregate("taken__", F.lit(0).cast("long"), lambda m, x: F.greatest(m, x["k"]))
    both = both.withColumn("time__", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    left = F.filter("taken__", lambda x: x["k"] >= F.col("time__"))
    both = both.withColumn("left__", left).withColumn("n__", F.aggregate("left__", F.lit(0).cast("long"), lambda m, x: m + x["n"]))
    words = F.regexp_extract_all(F.col(text), F.lit(SPACED), F.lit(0))
    some = F.expr("array_join(flatten(transform(left__, x -> slice(words__, cast(x.first + 1 as int), cast(x.n as int)))), '')")
    # a text is cut into words only where some are left out
    both = both.withColumn("words__", F.when(F.col("n__") < F.col("size__"), words))
    new = F.when(F.col("n__") == F.col("size__"), F.col(text)).otherwise(F.regexp_replace(some, SPACE_BEFORE, ""))
    columns = [new.alias(c) if c == text else F.length(new).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return both.select(*columns)
