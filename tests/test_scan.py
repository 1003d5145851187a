"""Running and moving states against plain loops, and the size of what one task sees."""

import random

import pytest
from pyspark.sql import functions as F

from pactum.operators import graph, scan


def plain(rows, width, fold):
    """{(key, order): fold of the last ``width`` values} of rows (key, order, value)."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, r in enumerate(own):
            seen = [v for _, _, v in own[max(0, i + 1 - width) : i + 1] if v is not None]
            out[key, r[1]] = fold(seen) if seen else None
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    keys = ["hot"] * 400 + ["a"] * 9 + ["b"] * 33 + [None] * 20
    return [(k, i * 3 % 1009, rng.choice([None, *range(-50, 50)])) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, o int, v long").repartition(4)
    return scan.numbered(df, ["k"], [F.col("o")]).cache()


def test_numbers_are_dense_in_each_partition(frame, rows):
    wanted = {}
    for key in {r[0] for r in rows}:
        wanted |= {(key, o): i for i, o in enumerate(sorted(r[1] for r in rows if r[0] == key), 1)}
    assert {(r["k"], r["o"]): r["number"] for r in frame.collect()} == wanted


@pytest.mark.parametrize("block", [2, 64])
def test_running_states(frame, rows, block):
    # Joining text is associative and not commutative, so the order shows.
    found = scan.running_state(frame, ["k"], "number", F.col("v").cast("string"), lambda a, b: F.concat(a, F.lit(","), b), block=block)
    wanted = plain(rows, 10**6, lambda vs: ",".join(map(str, vs)))
    assert {(r["k"], r["o"]): r["state"] for r in found.collect()} == wanted


@pytest.mark.parametrize("width", [1, 5, 64, 150, 1000])
def test_moving_states(frame, rows, width):
    add = lambda a, b: a + b
    total = scan.moving_state(frame, ["k"], "number", F.col("v"), add, width, inverse=lambda a, b: a - b)
    assert {(r["k"], r["o"]): r["state"] for r in total.collect()} == plain(rows, width, sum)
    text = scan.moving_state(frame, ["k"], "number", F.col("v").cast("string"), lambda a, b: F.concat(a, F.lit(","), b), width, block=16)
    assert {(r["k"], r["o"]): r["state"] for r in text.collect()} == plain(rows, width, lambda vs: ",".join(map(str, vs)))


def test_one_key_is_dealt_out(spark):
    """One partition holds all rows: no part of the sort, and no gathered block, has more than its share."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("o"))
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows are put together again
    spark.conf.set(small, "false")
    spread = df.repartitionByRange("k", "o").groupBy(F.spark_partition_id()).count()
    assert spread.count() == 4 and spread.agg(F.max("count")).first()[0] < 8000
    placed = scan.numbered(df, ["k"], [F.col("o")]).cache()
    spark.conf.set(small, "true")
    assert placed.agg(F.min("number"), F.max("number"), F.count_distinct("number")).first() == (1, 20_000, 20_000)
    top = scan.moving_state(placed, ["k"], "number", F.col("o"), F.greatest, 1000)
    assert top.filter("number = 20000").first()["state"] == df.orderBy(F.desc("o")).first()["o"]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "k string, o int, v long")
    placed = scan.numbered(none, ["k"], [F.col("o")])
    assert scan.moving_state(placed, ["k"], "number", F.col("v"), F.greatest, 3).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_tables_that_grow_with_the_rows(spark):
    df = spark.range(300).selectExpr("id % 9 AS k", "id div 9 + 1 AS n", "id AS v")
    moved = scan.moving_state(df, ["k"], "n", F.col("v"), F.greatest, 7, name="top")
    assert "Broadcast" not in _plan(moved) and moved.agg(F.sum("top")).first()[0] == sum(range(300))
    levels = graph.dependency_levels(df.select(F.col("v").alias("id")), df.selectExpr("v AS child", "v div 2 AS parent").filter("v > 0"))
    assert "Broadcast" not in _plan(levels) and levels.agg(F.max("level")).first()[0] == 9


def test_a_fold_takes_several_pieces_a_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(scan, "materialize", lambda df, name="stage", by=(), own=scan.materialize: made.append(name) or own(df, name, by))
    monkeypatch.setattr(scan, "ROUND", 40)
    df = spark.range(103).selectExpr("0 AS k", "id AS at", "IF(id % 5 = 0, NULL, id) AS v").union(spark.sql("SELECT 1, 1L, 9L"))
    found = scan.ordered_fold(df, ["k"], [F.col("at")], F.col("v"), F.lit(7).cast("long"), lambda s, v: (s * 31 + v) % 1000003, lambda s: s, size=4)
    wanted = 7
    for v in range(103):
        wanted = (wanted * 31 + v) % 1000003 if v % 5 else wanted
    assert {r["k"]: r["state"] for r in found.collect()} == {0: wanted, 1: 226}
    assert made.count("fold") <= 4
