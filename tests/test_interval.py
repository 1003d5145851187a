"""Interval and inequality joins against nested loops, and the plans they make."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pactum.operators import derive, interval


def held(lo, hi, x, bounds):
    above = lo is None or x > lo or (bounds[0] == "[" and x == lo)
    return above and (hi is None or x < hi or (bounds[1] == "]" and x == hi))


@pytest.mark.parametrize("bounds", ["[)", "[]", "()", "(]"])
def test_points_in_ranges_of_any_width(spark, bounds):
    rng = random.Random(3)
    points = [(i, rng.choice([0, 1, -1, 5, 10**10, -(10**10), rng.randrange(-100, 100)])) for i in range(150)] + [(999, None)]
    ends = [None, 0, 1, -7, 10**10, -(10**12), 50, 51]
    ranges = [(i, rng.choice(ends), rng.choice(ends)) for i in range(90)] + [(900, 0, 10**10), (901, None, None), (902, 5, 5)]
    p, r = spark.createDataFrame(points, "p int, x long"), spark.createDataFrame(ranges, "r int, a long, b long")
    found = interval.range_join(p, F.col("x"), r, F.col("a"), F.col("b"), bounds).select("p", "r").collect()
    wanted = [(i, j) for i, x in points for j, a, b in ranges if x is not None and held(a, b, x, bounds)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_other_types_and_equal_columns(spark):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    p = spark.createDataFrame([("a", day(3), Decimal("1.25")), ("b", day(3), Decimal("1.30"))], "g string, d date, m decimal(9,2)")
    r = spark.createDataFrame([("a", day(1), day(3), Decimal("1.2"), Decimal("1.3"))], "g string, d1 date, d2 date, m1 decimal(5,1), m2 decimal(5,1)")
    count = lambda how, on: interval.range_join(p, F.col("d"), r, F.col("d1"), F.col("d2"), how, on).count()
    on = lambda df: df.withColumnRenamed("g", "h")
    assert count("[]", ["g"]) == 1 and count("[)", ["g"]) == 0
    assert [x["m"] for x in interval.range_join(p, F.col("m"), on(r), F.col("m1"), F.col("m2")).collect()] == [Decimal("1.25")]
    assert interval.range_join(p, F.col("m"), on(r), F.lit(None), F.col("m2"), "[]").count() == 2
    with pytest.raises(TypeError):
        interval.range_join(p.select(F.lit(1.5).alias("x")), F.col("x"), r, F.col("m1"), F.col("m2"))


def test_few_nodes_for_wide_ranges(spark):
    n = spark.sql("SELECT 3L AS a, 10000000003L AS b").select(F.size(interval.nodes(F.col("a"), F.col("b")))).first()[0]
    assert 0 < n <= 68
    whole = spark.sql(f"SELECT {interval.LEAST}L AS a, {interval.MOST}L AS b").select(interval.nodes(F.col("a"), F.col("b")).alias("n")).first()["n"]
    assert [(x["k"], x["i"]) for x in whole] == [(62, -1), (62, 0)]


def test_overlaps(spark):
    rng = random.Random(8)
    ends = [None, *range(12)]
    make = lambda n: [(i, *sorted((rng.choice(ends), rng.choice(ends)), key=lambda x: (x is not None, x)), rng.choice(["[)", "[]", "()"])) for i in range(n)]
    rows = [make(70), make(70)]
    frames = []
    for side in rows:
        df = spark.createDataFrame(side, "i int, a int, b int, how string")
        whole = F.when(F.col("how") == "[)", derive.range_value(F.col("a"), F.col("b"))).when(F.col("how") == "[]", derive.range_value(F.col("a"), F.col("b"), "[]")).otherwise(derive.range_value(F.col("a"), F.col("b"), "()"))
        frames.append(df.select("i", F.when(F.col("i") % 9 != 0, whole).alias("r")))
    found = interval.overlap_join(frames[0].withColumnRenamed("i", "x"), F.col("r"), frames[1].toDF("y", "s"), F.col("s")).select("x", "y").collect()

    def numbers(row):
        return {n / 2 for n in range(-2, 30) if held(row[1], row[2], n / 2, row[3]) and n % 2 == 0}  # whole numbers only

    wanted = [(x[0], y[0]) for x in rows[0] for y in rows[1] if x[0] % 9 and y[0] % 9 and numbers(x) & numbers(y)]
    assert sorted(map(tuple, found)) == sorted(wanted)


@pytest.mark.parametrize("ops", [("<",), (">=",), ("<", ">"), ("<=", "<="), (">", "<=", ">=")])
def test_inequalities(spark, ops):
    rng = random.Random(4)
    value = lambda: rng.choice([None, *range(40)])
    rows = [[(i, value(), str(value()), float(value() or 0)) for i in range(120)] for _ in range(2)]
    left, right = (spark.createDataFrame(r, "i int, a int, b string, c double") for r in rows)
    terms = [(c, op, c) for c, op in zip("abc", ops)]
    joined = interval.inequality_join(left, right, terms, block=8)
    holds = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    fits = lambda x, y: all(x[k] is not None and y[k] is not None and holds[op](x[k], y[k]) for k, op in enumerate(ops, 1))
    wanted = sorted((x[0], y[0]) for x in rows[0] for y in rows[1] if fits(x, y))
    assert sorted((r["left"]["i"], r["right"]["i"]) for r in joined.collect()) == wanted
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_blocks_that_cannot_match_never_meet(spark):
    """A narrow band over many rows: the rows that meet in blocks are a small part of all pairs."""
    rows = spark.range(4000).select("id", F.col("id").cast("double").alias("v"), (F.col("id") + 1.5).alias("limit"))
    joined = interval.inequality_join(rows, rows, [("v", "<", "v"), ("limit", ">", "v")], block=50)
    assert joined.count() == 3999
    with pytest.raises(ValueError):
        interval.inequality_join(rows, rows, [("v", "=", "v")])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_ranges_are_not_broadcast(spark):
    """A range is some dozens of nodes, which the planner does not count: it took them for small."""
    points = spark.range(2000).select((F.col("id") % 20).alias("g"), F.col("id").alias("x"))
    ranges = spark.range(20).select(F.col("id").alias("g"), (F.col("id") * 50).alias("a"), (F.col("id") * 50 + 777).alias("b"))
    found = interval.range_join(points, F.col("x"), ranges, F.col("a"), F.col("b"), on=["g"])
    assert "Broadcast" not in plan_of(found)
    assert found.count() == sum(g * 50 <= x < g * 50 + 777 for g in range(20) for x in range(g, 2000, 20))


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_nodes_cover_a_range_once(spark, bits):
    rng = random.Random(bits)
    ends = [sorted((rng.randrange(-700, 700), rng.randrange(-700, 700))) for _ in range(60)]
    df = spark.createDataFrame([tuple(e) for e in ends], "a long, b long").select("a", "b", interval.nodes(F.col("a"), F.col("b"), bits).alias("n"))
    for r in df.collect():
        covered = [x for n in r["n"] for x in range(n["i"] << n["k"] * bits, (n["i"] + 1) << n["k"] * bits)]
        assert sorted(covered) == list(range(r["a"], r["b"] + 1))


def test_no_levels_above_the_longest_interval(spark):
    ends = spark.sql("SELECT id * 7 - 300 AS a, id * 7 - 300 + id % 41 AS b FROM range(120)")
    for bits in (1, 2, 4):
        n = lambda *most: interval.nodes(F.col("a"), F.col("b"), bits, *most)  # noqa: B023, E731
        assert ends.filter(n() != n(41)).isEmpty()
    assert str(interval.nodes(F.col("a"), F.col("b"), 1, 41)).count("62") < str(interval.nodes(F.col("a"), F.col("b"))).count("62")


def test_intervals_of_one_file_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(interval, "DEALT", 25)
    placed = spark.range(100).coalesce(1).selectExpr("id AS _lo", "id + 9 AS _hi")
    held = interval._held(placed, spark.range(100).selectExpr("id AS _at"), 100)[0]
    assert len(held.inputFiles()) == 4 and held.select("_k", "_i").distinct().count() > 1


@pytest.mark.parametrize("ops", [("<", ">="), ("<=", "<"), (">", "<="), (">=", ">")])
def test_totals_of_inequalities_without_pairs(spark, ops):
    rng = random.Random(6)
    value = lambda: rng.choice([None, *range(30)])
    rows = [[(i, value(), float(value() or 0)) for i in range(200)] for _ in range(2)]
    left, right = (spark.createDataFrame(r, "i int, a int, b double") for r in rows)
    totals = {"n": (F.count(F.lit(1)), F.sum), "first": (F.min("i"), F.min)}
    found = interval.inequality_totals(left, right.withColumn("k", F.col("i") % 150), [("a", ops[0], "a"), ("b", ops[1], "b")], ["k"], totals)
    holds = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    wanted = {}
    for i, a, b in rows[0]:
        for j, c, d in rows[1]:
            if a is not None and c is not None and holds[ops[0]](a, c) and holds[ops[1]](b, d):
                wanted.setdefault(j % 150, []).append(i)
    assert {r["k"]: (r["n"], r["first"]) for r in found.collect()} == {k: (len(v), min(v)) for k, v in wanted.items()}
