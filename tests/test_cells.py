"""Joins whose large keys are cut into cells."""

from collections import Counter

from pyspark.sql import functions as F

from pactum.operators import cells


def test_large_keys_are_cut_and_every_pair_is_made_once(spark):
    one = spark.range(900).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("a"))
    two = spark.range(500).select(F.when(F.col("id") < 300, 1).when(F.col("id") != 301, F.col("id") % 7).alias("k"), F.col("id").alias("b"))
    met = cells.paired(one, two, ["k"], "a", "b", cell=64)
    rights = two.collect()
    wanted = [(x["a"], y["b"]) for x in one.collect() for y in rights if x["k"] == y["k"]]
    assert Counter((r["a"], r["b"]) for r in met.collect()) == Counter(wanted)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "_cell_p" in plan and "SortMergeJoin" in plan and met.columns == ["k", "a", "b"]
    assert "_cell_p" not in cells.paired(one, two, ["k"], "a", "b")._jdf.queryExecution().executedPlan().toString()
