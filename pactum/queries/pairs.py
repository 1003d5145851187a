"""The two versions of ``orders`` that the snapshot queries compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import table

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def actual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*COLUMNS)


def desired_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` without keys % 11 = 0, dearer by 1 where % 7 = 0, and with copies of % 13 = 0 under new keys."""
    orders = actual_orders(spark, sf_dir)
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", price)
    copies = orders.filter("o_orderkey % 13 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10000000)
    return kept.unionByName(copies)


def keyed_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(actual, desired) with ``copy``, which makes the key whole: once keys reach 10,000,000, a copy's new key may be one
    that ``orders`` has. The rows of a desired key are numbered from 0; the actual one is number 0."""
    own = Window.partitionBy("o_orderkey").orderBy(*COLUMNS[1:])
    desired = desired_orders(spark, sf_dir).withColumn("copy", F.row_number().over(own) - 1)
    return actual_orders(spark, sf_dir).withColumn("copy", F.lit(0)), desired


#: Common table expressions ``actual`` and ``desired`` of the oracle.
SQL_PAIR = """
actual AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders),
desired AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 13 = 0
)"""
