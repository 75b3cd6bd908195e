import collections
import statistics

from pyspark.sql import functions as F

from harrow.llm import mixing


def test_the_deal_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 17, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.shuffled(F.col("id"), F.lit(n).cast("long"), 5)).collect()]
        assert sorted(got) == list(range(n))


def test_shard_counts_vary_as_draws_do(spark):
    # 600 of 1,000 draws are of one source; shards of 100 slots: hypergeometric with mean 60 and variance 21.6
    seeds = range(30)
    df = spark.range(1000).select("id", *(mixing.shuffled(F.col("id"), F.lit(1000).cast("long"), s).alias(f"p{s}") for s in seeds)).where("id < 600")
    rows = df.collect()
    counts = [n for s in seeds for n in collections.Counter(r[f"p{s}"] // 100 for r in rows).values()]
    assert len(counts) == 300 and statistics.mean(counts) == 60 and 15 < statistics.pvariance(counts) < 29


def test_the_mix_carries_shard_and_slot(spark):
    df = spark.createDataFrame([(i, "w " * (i % 70), "sr"[i % 2]) for i in range(120)], "doc_id long, text string, source string")
    rows, parts, draws = mixing.mix_plan(df, block_words=10, shard_slots=16)
    mix, drawn = mixing.dealt(parts, draws).collect(), draws.collect()
    assert {(r.shard, r.slot) for r in mix} == {(r.shard, r.slot) for r in drawn} == {divmod(i, 16) for i in range(len(drawn))}
    taken = collections.Counter()
    for r in mix:
        taken[r.id] += r.n
    assert dict(taken) == {r.id: r.taken for r in mixing.taken_words(rows, parts, draws).collect() if r.taken}
    counts = {(r.shard, r.source): r.n for r in mixing.shard_counts(draws).collect()}
    assert counts == collections.Counter((r.shard, r.source) for r in drawn)
    other = {(r.shard, r.source): r.n for r in mixing.shard_counts(mixing.mix_plan(df, block_words=10, shard_slots=16, seed=4)[2]).collect()}
    assert other != counts
