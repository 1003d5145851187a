"""Gathering and folding groups of any size, ordered sets, and what a foreign table's declaration leaves out."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pactum.operators import merge as M
from pactum.operators import scan as W
from pactum.sources import tables as S


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most rows, a null key, a key of its own, nulls and repeated rows."""
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([None, 1, 2, 2, 5, 9])) for i in range(700)]
    rows += [(None, i, i % 4) for i in range(30)] + [("one", 0, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, at int, v int").repartition(5)


def grouped(rows):
    out = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((at, v))
    return out


@pytest.mark.parametrize("size", [1, 64, 1000])
def test_pieces_hold_every_row_in_order(hot, size):
    rows, df = hot
    found = W.gathered_pieces(df, ["k"], [F.col("at")], [F.col("at"), F.col("v")], "items", size).collect()
    for k, own in grouped(rows).items():
        pieces = sorted((r["piece"], [tuple(x) for x in r["items"]]) for r in found if r["k"] == k)
        assert [n for n, _ in pieces] == list(range(1, -(-len(own) // size) + 1))
        assert all(len(items) <= size for _, items in pieces)
        assert [x for _, items in pieces for x in items] == own


def test_pieces_of_names_that_clash_and_of_nothing(spark, hot):
    clashing = hot[1].select(F.col("k").alias("_key"), F.col("at").alias("_part"), F.col("v").alias("piece x"))
    found = W.gathered_pieces(clashing, ["_key"], [F.col("_part")], [F.col("`piece x`")], "its `items`", 100)
    assert found.columns == ["_key", "piece", "its `items`"] and found.count() == 7 + 1 + 1
    assert W.gathered_pieces(hot[1].limit(0), ["k"], [F.col("at")], [F.col("v")], "items", 10).count() == 0
    with pytest.raises(ValueError):
        W.gathered_pieces(hot[1], ["k"], [F.col("at")], [F.col("v")], "items", 0)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("size", [100, 1000])
def test_folds_run_in_order_over_all_pieces(hot, size, strict):
    rows, df = hot
    step = lambda s, v: (s * 31 + F.coalesce(v, F.lit(3))) % 1000003
    found = W.ordered_fold(df, ["k"], [F.col("at")], F.col("v"), F.lit(7).cast("long"), step, lambda s: s + 1, "state", strict, size)
    want = {}
    for k, own in grouped(rows).items():
        state = 7
        for _, v in own:
            if v is not None or not strict:
                state = (state * 31 + (3 if v is None else v)) % 1000003
        want[k] = state + 1
    assert {r["k"]: r["state"] for r in found.collect()} == want
    assert W.ordered_fold(df.limit(0), ["k"], [F.col("at")], F.col("v"), F.lit(7).cast("long"), step, lambda s: s).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_ordered_sets_are_those_of_sorted_values(hot, p):
    rows, df = hot
    found = {r["k"]: r for r in W.ordered_set(df, ["k"], F.col("v"), {"c": p}, {"d": p}, mode="m").collect()}
    for k, own in grouped(rows).items():
        values = sorted(v for _, v in own if v is not None)
        if not values:
            assert (found[k]["c"], found[k]["d"], found[k]["m"]) == (None, None, None)
            continue
        place = p * (len(values) - 1)
        low = int(place)
        high = min(low + 1, len(values) - 1)
        assert found[k]["c"] == pytest.approx(values[low] + (place - low) * (values[high] - values[low]))
        assert found[k]["d"] == values[max(-int(-p * len(values) // 1), 1) - 1]
        assert found[k]["m"] == min(values, key=lambda v: (-values.count(v), v))
    assert len(found) == 3


def test_ordered_set_of_the_whole_table_and_refusals(hot):
    rows, df = hot
    values = sorted(v for *_, v in rows if v is not None)
    assert W.ordered_set(df, [], F.col("v"), discrete={"top": 1.0}).collect()[0]["top"] == values[-1]
    assert W.ordered_set(df, ["k"], F.col("v"), mode="m").count() == 3
    with pytest.raises(ValueError):
        W.ordered_set(df, ["k"], F.col("v"), {"c": 1.5})


def test_children_beyond_the_bound_are_refused_or_cut_in_pieces(spark, hot):
    parents = spark.createDataFrame([("hot",), ("one",), ("none",), (None,)], "k string")
    with pytest.raises(PySparkException, match="a key has 700 rows"):
        M.bounded(hot[1], ["k"], 699).collect()
    assert M.bounded(hot[1], ["k"], 700).count() == 731
    found = M.children_pieces(parents, hot[1], ["k"], ["at"], "children", size=300).collect()
    assert sorted((r["k"] or "", r["piece"], len(r["children"])) for r in found) == [
        ("", 1, 0), ("hot", 1, 300), ("hot", 2, 300), ("hot", 3, 100), ("none", 1, 0), ("one", 1, 1)
    ]
    whole = {r["k"]: len(r["children"]) for r in M.attach_children(parents, hot[1], ["k"], ["at"], "children").collect()}
    assert whole == {"hot": 700, "one": 1, "none": 0, None: 0}


def test_round_trips(spark):
    given = ['{"k":1}', '{"k":null}', '{"k":"word"}', '{"x":1}', '{"k":1,"k":2}', "[1]", "word", None, "{}", '{"k":1,"s":"t"}', '{"s":null,"k":7}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    found = [r["kept"] for r in df.orderBy("i").select(M.round_trip(F.col("t"), "k INT, s STRING", ["k", "s"]).alias("kept")).collect()]
    assert found == ['{"k":1}', "{}", None, None, None, None, None, None, "{}", '{"k":1,"s":"t"}', '{"k":7}']


def test_foreign_columns_are_reported(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([("7", "x", "q"), ("word", "y", "r"), (None, "z", "s")], "a string, b string, `odd name` string").write.csv(path, header=True)
    layers = ({"header": "false"}, {"Header": "true"}, {"path": path})
    report = {r["column_name"]: (r["found"], r["state"], r["lost"]) for r in S.foreign_columns(spark, "csv", {"b": "string", "a": "int", "c": "date"}, *layers).collect()}
    assert report == {"b": ("string", "same", 0), "a": ("string", "cast", 1), "c": (None, "missing", 0), "odd name": ("string", "extra", 0)}
    rows = S.foreign_table(spark, "csv", {"b": "string", "a": "int", "c": "date"}, *layers).orderBy("b").collect()
    assert [tuple(r) for r in rows] == [("x", 7, None), ("y", None, None), ("z", None, None)]
    assert S.overlaid({"sep": ","}, {"SEP": ";"}, {"path": "p"}) == {"sep": (";", 1), "path": ("p", 2)}
