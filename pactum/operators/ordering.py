"""A dense global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize


def global_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """``df`` with a dense 1..N number in the given order, which must be total (unique).

    The rows are range partitioned and sorted, and written with their partition and place in it; each partition then
    starts after the rows of those before it. The only window without a key has one row per partition.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ordinal",
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row") + 1)
        .drop("_part", "_row", "_start")
    )
