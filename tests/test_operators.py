"""Laws and edge cases of the contract and snapshot operators."""

import random

import pytest
from pyspark.sql import functions as F

from pactum.functions import routines, text
from pactum.operators import cells, checks, derive, diff, grants, graph, merge, ordering, views
from pactum.queries.pairs import actual_orders, desired_orders
from pactum.sources import tables
from pactum.streaming import replication

KEY = ["o_orderkey"]


def test_diff_of_a_snapshot_with_itself_is_unchanged(spark, sf_dir):
    own = actual_orders(spark, sf_dir)
    assert [r["change"] for r in diff.diff_summary(diff.snapshot_diff(own, own, KEY)).collect()] == [diff.UNCHANGED]


def test_diff_tells_null_data_from_absence(spark):
    desired = spark.createDataFrame([(1, None), (None, "x")], "k int, v string")
    actual = spark.createDataFrame([(1, None), (2, None), (None, "x")], "k int, v string")
    found = {r["k"]: r["change"] for r in diff.snapshot_diff(desired, actual, ["k"]).collect()}
    assert found == {1: "Unchanged", 2: "Removed", None: "Unchanged"}


def test_diff_compares_maps_without_order(spark):
    a = spark.createDataFrame([(1,)], "k int").withColumn("m", F.expr("map('a', 1, 'b', 2)"))
    b = spark.createDataFrame([(1,)], "k int").withColumn("m", F.expr("map('b', 2, 'a', 1)"))
    assert diff.snapshot_diff(a, b, ["k"]).first()["change"] == "Unchanged"


def test_normalized_equal_at_depth(spark):
    row = spark.sql(
        "SELECT struct(1 AS x, struct('me' AS owner, 'int4' AS data_type) AS s) AS a, "
        "struct(1 AS x, struct('you' AS owner, 'integer' AS data_type) AS s) AS b"
    )
    kind = row.schema["a"].dataType
    same = diff.normalized_equal(F.col("a"), F.col("b"), kind, ignore=("owner",), canonical=("data_type",))
    assert row.select(same).first()[0] is True
    assert row.select(diff.normalized_equal(F.col("a"), F.col("b"), kind, ignore=("owner",))).first()[0] is False


@pytest.mark.parametrize(
    "name, wanted",
    [
        ("int4", "integer"),
        ("varchar(255)", "character varying(255)"),
        ("numeric(10,2)[]", "numeric(10,2)[]"),
        ("timestamptz", "timestamp with time zone"),
        ("int8[]", "bigint[]"),
        ("my_type", "my_type"),
    ],
)
def test_canonical_type(spark, name, wanted):
    assert spark.range(1).select(diff.canonical_type(F.lit(name))).first()[0] == wanted


def test_second_merge_writes_nothing(spark, sf_dir):
    desired, actual = desired_orders(spark, sf_dir), actual_orders(spark, sf_dir)
    once = merge.merge_update(actual, desired, KEY, prune=True)
    counts = merge.merge_counts(once, desired, KEY, prune=True).first()
    assert (counts["written"], counts["stale"]) == (0, 0)


def test_gated_plan_has_no_destructive_row(spark):
    plan = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, drop boolean")
    kept, held = diff.destructive_gate(plan, F.col("drop"), allow=False)
    assert sorted(r["k"] for r in kept.collect()) == [2, 3]
    assert [r["k"] for r in held.collect()] == [1]
    assert diff.destructive_gate(plan, F.col("drop"), allow=True)[0].count() == 3


def test_duplicate_keys_are_reported(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in diff.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]


def test_number_duplicates_leaves_out_taken_numbers(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1"), (4, "a"), (5, "b")], "i int, name string")
    found = {r["i"]: r["unique_name"] for r in merge.number_duplicates(names, "name", ["i"]).collect()}
    assert found == {1: "a", 2: "a_2", 3: "a_1", 4: "a_3", 5: "b"}


def test_null_semantics_of_rules(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, 5, 3), (4, 5, 4)], "k int, a int, b int")
    assert checks.violations(rows, [checks.check("c", "a > 10")]).count() == 2  # null passes
    assert checks.check_unique(rows, ["a"]).first()["n"] == 2  # nulls are distinct
    parent = spark.createDataFrame([(7,)], "p int")
    assert checks.check_foreign_key(rows, ["a"], parent, ["p"]).count() == 2  # nulls pass
    view = views.View("v", F.col("a") > 1, option="LOCAL")
    assert views.check_option_violations(rows, view).count() == 2  # null fails
    with pytest.raises(ValueError):
        checks.check_foreign_key(rows, ["a"], parent, ["p"], "PARTIAL")


def test_foreign_key_full_match(spark):
    rows = spark.createDataFrame([(1, None), (None, None), (1, 1), (2, 2)], "a int, b int")
    parent = spark.createDataFrame([(1, 1)], "x int, y int")
    bad = checks.check_foreign_key(rows, ["a", "b"], parent, ["x", "y"], "FULL").collect()
    assert sorted((r["a"], r["b"] or 0) for r in bad) == [(1, 0), (2, 2)]


def test_local_check_option_stops_where_no_option_is_set(spark):
    rows = spark.createDataFrame([(5,), (50,)], "a int")
    base = views.View("base", F.col("a") > 10)
    assert views.check_option_violations(rows, views.View("v", F.col("a") > 1, base, "LOCAL")).count() == 0
    assert views.check_option_violations(rows, views.View("v", F.col("a") > 1, base, "CASCADED")).count() == 1


def test_cycles_have_no_level(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(1, 0), (2, 3), (3, 2), (4, 3)], "child long, parent long")
    found = {r["id"]: r["level"] for r in graph.dependency_levels(nodes, edges).collect()}
    assert found == {0: 0, 1: 1, 2: None, 3: None, 4: None}


def test_global_ordinal_is_dense(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id"))
    found = ordering.global_ordinal(df, [F.col("x")]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in found] == list(range(1, 1001))
    assert [r["x"] for r in found] == sorted(r["x"] for r in found)


def test_sequence_without_cycle_overflows_to_null(spark):
    seq = derive.Sequence_(start=8, increment=1, maximum=9)
    got = spark.range(1, 4).select(derive.sequence_value(F.col("id"), seq).alias("v")).collect()
    assert [r["v"] for r in got] == [8, 9, None]


def test_partitions(spark):
    rows = spark.createDataFrame([(1,), (10,), (None,)], "k int")
    parts = [derive.Partition("low", upper=10), derive.Partition("high", lower=10)]
    found = [r["partition"] for r in derive.route_partitions(rows, "k", "RANGE", parts).orderBy("k").collect()]
    assert found == [None, "low", "high"]
    with pytest.raises(ValueError):
        derive.route_partitions(rows, "k", "RANGE", [derive.Partition("a", upper=10), derive.Partition("b", lower=5)])
    assert derive.overlaps([derive.Partition("a", modulus=4, remainder=1), derive.Partition("b", modulus=6, remainder=3)], "HASH")


def test_generated_columns_refuse_writes(spark):
    with pytest.raises(ValueError):
        derive.generated_column(spark.range(1), "id", "1")


def test_materialized_view_checks_its_index(spark):
    with pytest.raises(ValueError):
        views.refresh_materialized(spark.createDataFrame([(1,), (1,)], "k int"), "dup", ["k"])


def test_generated_fixtures(spark, sf_dir):
    base = spark.range(1, 5001).select(F.col("id").alias("k"))
    users = tables.generate_users(base, "k").cache()
    n = users.count()
    rate = users.filter("last_modified_at IS NULL").count() / n
    assert 0.42 < rate < 0.48
    assert users.select("email").distinct().count() == n
    assert users.select("locale").distinct().count() == 60
    addresses = tables.generate_addresses(users)
    assert addresses.join(users, addresses["user_id"] == users["id"], "left_anti").count() == 0
    again = tables.generate_users(base.repartition(7), "k")
    assert users.exceptAll(again).count() == 0


def test_feed_conflicts_and_truncate(spark):
    feed = spark.createDataFrame(
        [(1, 1, "insert", "a"), (1, 2, "insert", "b"), (2, 3, "update", "c"), (0, 4, "truncate", None), (1, 5, "update", "d"), (3, 6, "insert", "e")],
        "k int, ord int, op string, v string",
    )
    found = {r["k"]: (r["present"], r["conflicts"], r["skipped"]) for r in replication.fold_feed(feed, "k", "ord").collect()}
    assert found == {1: (False, 0, 1), 3: (True, 0, 0)}
    initial = spark.createDataFrame([(9, "z")], "k int, v string")
    state = replication.subscribed_state(feed.filter("op <> 'truncate'"), "k", "ord", initial=initial)
    assert {r["k"]: r["v"] for r in state.collect()} == {1: "d", 3: "e", 9: "z"}


def test_replayed_batches_are_applied_once(spark):
    feed = spark.createDataFrame([(1, 1, "insert", "a"), (1, 2, "update", "b")], "k int, ord int, op string, v string")
    own = replication.StreamSubscriber(spark, "k", "ord")
    own.apply(feed, 0)
    own.apply(feed, 0)
    own.apply(feed, 1)
    assert [tuple(r) for r in own.state().collect()] == [(1, "b")]


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "The cat and the Dog"), (2, None)], "id int, body string")
    assert [(r["position"], r["lexeme"]) for r in text.lexemes(docs, "id", "body").collect()] == [(2, "cat"), (5, "dog")]
    assert text.matches(docs, "body", ["the", "dog"]).count() == 1
    assert docs.select(text.headline(F.col("body"), ["cat"])).first()[0] == "The <b>cat</b> and the Dog"


def test_quarantine(spark):
    rows = spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "body string")
    good, bad = merge.quarantine(rows, "body", "k INT")
    assert [r["parsed"]["k"] for r in good.collect()] == [1]
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "missing"]


def test_deep_chains_have_levels_to_the_end(spark, monkeypatch):
    """A chain of 10,000 in a number of steps that is logarithmic."""
    steps = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: steps.append(name) or write(df, name))
    nodes = spark.range(10_000)
    edges = spark.range(9_999).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    found = graph.dependency_levels(nodes, edges)
    assert len(steps) <= 30 and found.filter("level = id").count() == 10_000
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_levels_of_random_graphs(spark):
    rng = random.Random(12)
    for most in (2, 5):
        pairs = {(c, rng.randrange(max(0, c - 12), c)) for c in range(1, 80) for _ in range(rng.randint(0, most))} | {(70, 75), (90, 91), (91, 90), (92, 91)}
        level = {}

        def at(n, path=()):
            if n in path:
                return None
            if n not in level:
                above = [at(p, (*path, n)) for c, p in pairs if c == n]
                own = None if None in above else max((a + 1 for a in above), default=0)
                if path and own is None:
                    return None  # decided from its own start
                level[n] = own
            return level[n]

        wanted = {n: at(n) for n in range(95)}
        nodes = spark.createDataFrame([(n,) for n in range(95)], "id int")
        found = graph.dependency_levels(nodes, spark.createDataFrame(sorted(pairs), "child int, parent int"))
        assert {r["id"]: r["level"] for r in found.collect()} == wanted


def test_levels_of_branches_and_cycles(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(9)], "id string")
    pairs = [(1, 0), (2, 1), (3, 2), (3, 0), (4, 3), (6, 7), (7, 6), (8, 7), (8, 4)]
    edges = spark.createDataFrame([(f"n{c}", f"n{p}") for c, p in pairs], "child string, parent string")
    found = {r["id"]: r["level"] for r in graph.dependency_levels(nodes, edges).collect()}
    assert found == {**{f"n{i}": i for i in range(5)}, "n5": 0, "n6": None, "n7": None, "n8": None}


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(150, 149)], "src int, dst int")
    found = {(r["src"], r["dst"]) for r in graph.reachable(edges).collect()}
    assert found == {(i, j) for i in range(149) for j in range(i + 1, 151)} | {(i, j) for i in (149, 150) for j in (149, 150)}


def test_repeated_keys_are_refused(spark):
    once = spark.createDataFrame([(1,), (2,)], "k int")
    twice = spark.createDataFrame([(1,), (1,)], "k int")
    assert diff.snapshot_diff(once, once, ["k"], checked=True).count() == 2
    for pair in ((once, twice), (twice, once)):
        with pytest.raises(ValueError):
            diff.snapshot_diff(*pair, ["k"], checked=True)


def test_types_of_document_values(spark):
    kinds = {"i": "integer", "n": "number", "b": "boolean", "s": "string", "a": "array", "o": "object"}
    contract = checks.DocumentContract(fields={k: checks.Field(kind=v) for k, v in kinds.items()})
    bad = {"i": ['"5"', "1.5", "9007199254740993.5", "true", "null"], "n": ['"1"', "false"], "b": ['"true"', "0"], "s": ["7", "true", "[]"], "a": ["{}", '"[1]"'], "o": ["[]", '"{}"']}
    good = {"i": ["5", "-7", "5.0", "12345678901234567890", "1e19", "1e300"], "n": ["1", "2.5", "1e3"], "b": ["true", "false"], "s": ['"7"', '""'], "a": ["[]", "[1]"], "o": ["{}", '{"x":1}']}
    rows = [(k, f'{{"{k}":{v}}}', wrong) for wrong, table in ((True, bad), (False, good)) for k, vs in table.items() for v in vs]
    found = checks.document_violations(spark.createDataFrame(rows, "k string, body string, wrong boolean"), ["k", "body", "wrong"], "body", contract).collect()
    assert sorted((r["k"], r["body"], r["path"], r["rule"]) for r in found) == sorted((k, b, k, "type") for k, b, wrong in rows if wrong)
    assert all(r["wrong"] for r in found)


def test_null_and_empty_ranges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    r = lambda a, b, how="[)": derive.range_value(F.lit(a), F.lit(b), how)
    none = F.when(F.lit(False), r(1, 2))
    assert value(derive.range_contains(none, F.lit(1))) is None and value(derive.range_contains(r(1, 5), F.lit(None).cast("int"))) is None
    assert value(derive.range_contains(r(5, 5), F.lit(5))) is False and value(derive.range_contains(r(5, 5, "[]"), F.lit(5))) is True
    assert value(derive.range_overlaps(r(5, 5), r(1, 10))) is False and value(derive.range_overlaps(r(1, 10), none)) is None
    assert value(derive.range_overlaps(r(1, 5), r(5, 9))) is False and value(derive.range_overlaps(r(1, 5, "[]"), r(5, 9))) is True
    assert value(derive.range_length(r(5, 5))) is None
    with pytest.raises(Exception, match="lower bound"):
        value(r(6, 5))


def test_privileges_of_every_section(spark):
    rows = [
        ("a", "views", "s.v", "ALL", None), ("a", "large_objects", "17", "UPDATE", None), ("a", "foreign_servers", "x.y-1", "USAGE", None),
        ("a", "domains", "s.1-d", "USAGE WITH GRANT OPTION", None), ("a", "databases", "d-b.x", "TEMP", None), ("a", "tables", "s.t", "MAINTAIN", None),
        ("a", "views", "v", "SELECT", "name"), ("a", "large_objects", "x", "SELECT", "name"), ("a", "views", "s.v", "INSERT", "privilege"), ("a", "servers", "x", "USAGE", "section"),
    ]
    entries = spark.createDataFrame(rows, "role string, section string, object string, privilege string, wanted string")
    assert sorted((r["section"], r["object"], r["rule"]) for r in grants.privilege_violations(entries).collect()) == sorted((r[1], r[2], r[4]) for r in rows if r[4])
    no = entries.limit(0).select("role", "section", "object", "privilege")
    members = spark.createDataFrame([("m", "a")], "member string, role string")
    held = grants.effective_privileges(entries.filter("wanted IS NULL").drop("wanted"), no, members).filter("role = 'm'")
    found = {(r["section"], r["privilege"]) for r in held.collect()}
    assert found == {("views", "SELECT"), ("large_objects", "UPDATE"), ("foreign_servers", "USAGE"), ("domains", "USAGE"), ("databases", "TEMPORARY"), ("tables", "MAINTAIN")}


def test_explicit_null_is_not_absence(spark):
    rows = spark.createDataFrame([(1, None, {"v": True}), (2, None, {}), (3, "x", {"v": True})], "k int, v string, given map<string,boolean>")
    box = spark.createDataFrame([("box",)], "v string")
    found = merge.inject_defaults(rows, box, F.lit(True), ["v"], {}, presence="given").collect()
    assert {r["k"]: r["v"] for r in found} == {1: None, 2: "box", 3: "x"}


def test_subscription_before_and_after_compaction(spark):
    schema = "id int, n long, op string, v string"
    subscriber = replication.StreamSubscriber(spark, "id", "n", schema=spark.createDataFrame([], schema).schema)
    assert subscriber.state().count() == 0
    batches = [[(1, 1, "insert", "a"), (2, 2, "insert", "b")], [(1, 3, "update", "c"), (2, 4, "delete", None)], [(2, 5, "insert", "d"), (1, 6, "delete", None)]]
    for i, rows in enumerate(batches[:2]):
        subscriber.apply(spark.createDataFrame(rows, schema), i)
    subscriber.compact(3)
    state = lambda: sorted((r["id"], r["v"]) for r in subscriber.state().collect())
    assert state() == [(1, "c")]
    subscriber.apply(spark.createDataFrame(batches[2], schema), 2)
    subscriber.apply(spark.createDataFrame(batches[0], schema), 0)  # replayed
    assert state() == [(2, "d")]
    subscriber.enabled = False
    subscriber.apply(spark.createDataFrame([(9, 9, "insert", "x")], schema), 3)
    assert state() == [(2, "d")]


def test_pairs_of_an_operator_join_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(cells, "PAIRS", 50)
    a = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(40)], "a int, x int")
    b = spark.createDataFrame([(i, None if i == 5 else -(i % 2)) for i in range(30)], "b int, y int")
    met = routines.operator_join(a, b, F.col("x") * F.col("x"), F.col("y") * F.col("y"))
    assert "REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()
    wanted = [(i, j) for i in range(40) for j in range(30) if i != 3 and j != 5 and i % 2 == j % 2]
    assert sorted((r["a"], r["b"]) for r in met.collect()) == wanted and met.columns == ["a", "x", "b", "y"]
