"""The skewed join against a plain one."""

import pytest
from pyspark.sql import functions as F

from sediment.operators import skew


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_any_number_of_hot_keys(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "KEY_HASHES", 64)
    hot = spark.range(1500 * 12).select((F.col("id") % 1500).alias("k"), F.col("id").alias("v"))
    cold = spark.range(40).select((F.col("id") + 5000).alias("k"), F.col("id").alias("v"))
    nulls = spark.range(30).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    left = hot.union(cold).union(nulls)
    right = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    want = sorted(map(repr, left.join(right, "k", how).collect()))
    got = skew.lookup_join(left, right, "k", how, hot_rows=5)
    assert sorted(map(repr, got.collect())) == want
    assert sorted(map(repr, skew.lookup_join(left, right, "k", how, hot_rows=5, counted=left.unionByName(hot)).collect())) == want


def test_each_hot_key_has_the_salts_its_rows_ask_for(spark):
    left = spark.range(60_000).select(F.when(F.col("id") < 40_000, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(7, "x")], "k long, w string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are joined again
    try:
        parts = skew.lookup_join(left, right, "k", "inner", hot_rows=1_000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in parts) == 40_000 and max(r["count"] for r in parts) < 20_000


def test_clashing_extra_columns_and_empty_sides(spark):
    left = spark.createDataFrame([], "k long, v string")
    right = spark.createDataFrame([(1, 2)], "k long, w long")
    assert skew.lookup_join(left, right, "k").collect() == []
    assert skew.lookup_join(right.withColumnRenamed("w", "v"), left.withColumnRenamed("v", "w"), "k", "left").first()["w"] is None
