"""Places on tables of wide rows, whatever the partitions and however often the plan runs."""

import pytest
from pyspark.sql import functions as F

from harrow.operators import datasets


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", [1, 13])
def test_wide_rows_keep_all_places(spark, tmp_path, adaptive, partitions):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        wide = spark.range(3000).select(F.xxhash64("id").alias("k"), F.repeat(F.concat(F.lit("x"), F.col("id")), 400).alias("html")).repartition(partitions)
        placed = datasets.indexed(wide, F.col("k").desc())
        placed.write.parquet(str(tmp_path / "placed"))
        out = spark.read.parquet(str(tmp_path / "placed"))
        want = sorted((r.k for r in wide.select("k").collect()), reverse=True)
        assert [r.k for r in out.orderBy("idx").select("k").collect()] == want
        assert [r.idx for r in out.orderBy("idx").select("idx").collect()] == list(range(3000))
        both = datasets.shuffled(placed, 5)
        assert sorted(r.pos for r in both.select("pos").collect()) == list(range(3000))
        assert sorted(r.idx for r in both.select("idx").collect()) == list(range(3000))
        last = datasets.batches(placed, 64).groupBy("batch_id").count().collect()
        assert sorted(r["count"] for r in last) == [3000 % 64] + [64] * (3000 // 64)
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_keys_and_no_rows(spark):
    same = spark.range(500).select(F.lit(1).alias("k"), "id")
    assert sorted(r.idx for r in datasets.indexed(same, "k").collect()) == list(range(500))
    assert datasets.indexed(same.where("id < 0"), "k").collect() == []


def test_an_experiment_scores_every_page(spark, tmp_path):
    import os

    from harrow.plans.config import DatasetConfig, ExperimentConfig
    from harrow.plans.experiment import Experiment

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        pages = spark.read.parquet(path).repartition(9)
        samples = pages.select(F.concat(F.lit("s_"), F.col("page_id")).alias("id"), F.col("html").alias("content"), F.lit('{"title": ""}').alias("query"), F.lit('{"title": "x"}').alias("ground_truth"), F.lit(False).alias("is_content_url"))
        config = ExperimentConfig("e", DatasetConfig(batch_size=64, shuffle=True, metrics=("page_level_f1",)), output_dir=str(tmp_path))
        e = Experiment(spark, config, datasets.indexed(samples, "id"))
        e.run()
        got = [r.id for r in e.predictions().select("id").collect()]
        assert len(got) == len(set(got)) == pages.count() == 250
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
