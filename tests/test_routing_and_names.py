"""Routers, numbering, overloads, recursion and collations."""

import random

import pytest
from pyspark.sql import functions as F

from pactum.functions.collations import Collation, collated_ordinal, unique_violations
from pactum.functions.overloads import Functions
from pactum.operators import merge, routing, views
from pactum.operators.routing import MAXVALUE, MINVALUE, Partition, Partitioning


def test_ranges_of_two_columns(spark):
    parts = [
        Partition("a", lower=(MINVALUE, MINVALUE), upper=(1, 5)),
        Partition("b", lower=(1, 5), upper=(1, MAXVALUE)),
        Partition("c", lower=(2, MINVALUE), upper=(3, 0)),
        Partition("d", lower=(7, 7)),
    ]
    rows = [(x, y) for x in [None, 0, 1, 2, 3, 7, 8] for y in [None, -1, 0, 4, 5, 6, 7, 9]]

    def wanted(x, y):
        if x is None or y is None:
            return "rest"
        return "a" if (x, y) < (1, 5) else "b" if x == 1 else "c" if (2,) <= (x, y) < (3, 0) else "d" if (x, y) >= (7, 7) else "rest"

    df = spark.createDataFrame(rows, "x int, y int")
    found = routing.route_partitions(df, ["x", "y"], "RANGE", parts, "rest").collect()
    assert {(r["x"], r["y"]): r["partition"] for r in found} == {r: wanted(*r) for r in rows}
    with pytest.raises(ValueError, match="overlapping"):
        routing.route_partitions(df, ["x", "y"], "RANGE", [*parts, Partition("e", lower=(1, 9), upper=(1, 10))])
    with pytest.raises(ValueError, match="empty"):
        routing.route_partitions(df, ["x", "y"], "RANGE", [Partition("e", lower=(1, 9), upper=(1, 9))])
    with pytest.raises(ValueError, match="bounds"):
        routing.route_partitions(df, ["x", "y"], "RANGE", [Partition("e", lower=(1,))])


def test_partitions_of_partitions(spark):
    below = Partitioning("LIST", ("g",), (Partition("low_a", values=("a",)), Partition("low_none", values=(None,))), "low_rest")
    parts = [Partition("low", upper=10, parts=below), Partition("high", lower=10)]
    rows = [(5, "a"), (5, None), (5, "z"), (50, "a"), (None, "a")]
    found = routing.route_partitions(spark.createDataFrame(rows, "k int, g string"), "k", "RANGE", parts).collect()
    assert [r["partition"] for r in found] == ["low_a", "low_none", "low_rest", "high", None]


def test_many_partitions_of_each_kind(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("v"), "id").alias("v"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    ranges = [Partition(f"r{i}", lower=i * 3, upper=i * 3 + 2) for i in range(900)]
    found = routing.route_partitions(df, "id", "RANGE", ranges).collect()
    assert all(r["partition"] == (f"r{r['id'] // 3}" if r["id"] % 3 < 2 and r["id"] < 2700 else None) for r in found)
    lists = [Partition(f"l{i}", values=(f"v{i}", f"v{i + 1000}")) for i in range(1000)]
    found = routing.route_partitions(df, "v", "LIST", lists, "rest").collect()
    assert all(r["partition"] == (f"l{r['id'] % 1000}" if r["id"] < 2000 else "rest") for r in found)
    import datetime

    start = datetime.date(2020, 1, 1)
    days = [Partition(f"d{i}", lower=start + datetime.timedelta(i * 30), upper=start + datetime.timedelta(i * 30 + 30)) for i in range(50)]
    found = routing.route_partitions(df, "d", "RANGE", days).collect()
    assert all(r["partition"] == (f"d{r['id'] // 30}" if r["id"] < 1500 else None) for r in found)
    mixed = [Partition("even", modulus=2, remainder=0), Partition("one", modulus=4, remainder=1), Partition("three", modulus=4, remainder=3)]
    sizes = {r["partition"]: r["count"] for r in routing.route_partitions(df, "id", "HASH", mixed).groupBy("partition").count().collect()}
    assert set(sizes) == {"even", "one", "three"} and abs(sizes["even"] - 1500) < 150
    with pytest.raises(ValueError, match="overlapping"):
        routing.route_partitions(df, "v", "LIST", [Partition("x", values=("a",)), Partition("y", values=("a",))])


def numbered_plainly(rows):
    names, seen, out = {n for _, n in rows}, {}, {}
    for i, name in sorted(rows, key=lambda r: r[0]):
        if name not in seen:
            seen[name], out[i] = 0, name
            continue
        seen[name] += 1
        while f"{name}_{seen[name]}" in names:
            seen[name] += 1
        out[i] = f"{name}_{seen[name]}"
    return out


def test_numbers_over_gaps(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "a_1", "a_2", "a_4", "a_9", "a_10", "a_01", "b_3", "a_2_1", "a_999999999999"])) for i in range(300)]
    found = merge.number_duplicates(spark.createDataFrame(rows, "i int, name string"), "name", ["i"])
    assert {r["i"]: r["unique_name"] for r in found.collect()} == numbered_plainly(rows)


def test_numbers_of_one_name_have_no_large_task(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 1000 == 7, F.concat(F.lit("n_"), F.col("id") * 2 + 1)).otherwise(F.lit("n")).alias("name"))
    found = merge.number_duplicates(df, "name", ["id"])
    assert found.select("unique_name").distinct().count() == 200_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and "windowspecdefinition(name" not in plan
    last = found.filter("id = 199999").first()["unique_name"]
    taken = {2 * i + 1 for i in range(7, 200_000, 1000)}
    free, repeats = 0, 200_000 - 200 - 1
    while repeats:
        free += 1
        repeats -= free not in taken
    assert last == f"n_{free}"


def test_overloads(spark):
    own = Functions(spark, "test_overloads")
    own.define("f", [("a", "int"), ("b", "int")], "string", "'int int'", volatility="immutable")
    own.define("f", [("a", "bigint"), ("b", "double")], "string", "'bigint double'")
    own.define("f", [("a", "string")], "string", "concat('text ', a)", strict=True)
    own.define("f", [("a", "double"), ("b", "double"), ("c", "int", "7")], "string", "concat('three ', c)")
    df = spark.createDataFrame([(1, 2, 3.0, "x", None)], "i int, j int, d double, s string, n string")
    call = lambda *names: df.select(own.call(df, "f", *map(F.col, names))).first()[0]
    assert call("i", "j") == "int int" and call("i", "d") == "three 7" and call("s") == "text x" and call("n") is None
    own.define("f", [("a", "bigint"), ("b", "string")], "string", "'bigint string'")
    assert call("i", "s") == "bigint string"  # the only one to which both convert
    assert call("d", "i") == "three 7" and call("d", "d", "i") == "three 1"
    assert own.resolve("f", ["void"]).kinds == ("string",)
    own.define("g", [("a", "int"), ("b", "bigint")], "int", "1")
    own.define("g", [("a", "bigint"), ("b", "int")], "int", "2")
    with pytest.raises(LookupError, match="ambiguous"):
        own.call(df, "g", F.col("i"), F.col("j"))
    with pytest.raises(LookupError, match="no function"):
        own.call(df, "f", F.col("s"), F.col("s"))
    with pytest.raises(ValueError, match="there already"):
        own.define("f", [("a", "integer"), ("b", "int")], "string", "'again'")
    with pytest.raises(ValueError, match="volatile"):
        own.call(df, "f", F.col("s"), at_least="immutable")
    assert df.select(own.call(df, "f", F.col("i"), F.col("j"), at_least="immutable")).first()[0] == "int int"
    own.drop("f", ["string"])
    with pytest.raises(LookupError):
        own.resolve("f", ["string"])


def test_recursion_of_many_rounds(spark):
    """A chain with a branch that ends and one that comes back: the rows, and a plan that does not grow."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 100), (40, 3), (None, 7)], "a int, b int").cache()
    sizes = []

    def step(fresh):
        sizes.append(len(fresh._jdf.queryExecution().optimizedPlan().toString()))
        return edges.join(fresh, edges["a"] == fresh["n"]).select("b")

    found = views.recursive_view(spark.createDataFrame([(0,), (0,), (None,)], "n int"), step, buckets=4, runs=3)
    assert sorted((r["n"] for r in found.collect()), key=str) == sorted([*range(41), 100, None], key=str)
    assert len(sizes) == 41 and max(sizes) - min(sizes) < 10
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert views.recursive_view(spark.createDataFrame([], "n int"), step).count() == 0


def test_collations(spark):
    words = spark.createDataFrame([("côté",), ("cote",), ("coté",), ("côte",), ("Cote",), ("zone",), ("zone",), (None,), (None,)], "w string")
    loose = Collation(accents=False, case=False, deterministic=False)
    assert {(r["example"], r["n"]) for r in unique_violations(words, "w", loose).collect()} == {("Cote", 5), ("zone", 2)}
    assert {(r["example"], r["n"]) for r in unique_violations(words, "w", Collation("fr")).collect()} == {("zone", 2)}
    assert {r["n"] for r in unique_violations(words, "w", Collation("fr_FR", accents=False, deterministic=False)).collect()} == {4, 2}
    order = lambda locale: [r["w"] for r in collated_ordinal(words.filter("w LIKE 'c%'"), "w", Collation(locale), []).orderBy("ordinal").collect()]
    assert order("fr_FR.utf8") == ["cote", "coté", "côte", "côté"]
    assert order("fr_CA") == ["cote", "côte", "coté", "côté"]
    assert order("C") == sorted(["cote", "coté", "côte", "côté"], key=str.encode)
    with pytest.raises(ValueError):
        Collation("fr", accents=False)
    with pytest.raises(ValueError):
        Collation("xx_YY").resolved(spark)
