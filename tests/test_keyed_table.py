"""Stored tables and subscriptions: versions, buckets, failures half way, restarts."""

import contextlib
import json
import random

import pytest

from pactum.operators import diff, merge
from pactum.sources.keyed_table import KeyedTable, VersionConflict
from pactum.streaming import replication


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "k int, v string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("k", "v").collect())


def counts(done):
    return {c: done[c] for c in ("rewritten", "written", "kept", "stale", "pruned")}


def test_staged_merge_touches_changed_buckets_only(spark, frame, tmp_path):
    path, table = f"file://{tmp_path}/t", KeyedTable(spark, f"file://{tmp_path}/t")
    rows = [(i, "a") for i in range(100)]
    assert counts(merge.staged_merge(path, frame(rows), ["k"], buckets=8)) == {"rewritten": 8, "written": 100, "kept": 0, "stale": 0, "pruned": 0}
    folders = lambda: {b: x["folder"] for b, x in table.manifest()["buckets"].items()}
    before, changed = folders(), [(3, "b"), *rows[:3], *rows[4:99]]
    assert counts(merge.staged_merge(path, frame(changed), ["k"], buckets=8)) == {"rewritten": 1, "written": 1, "kept": 98, "stale": 1, "pruned": 0}
    assert sum(before[b] != f for b, f in folders().items()) == 1
    pruned = merge.staged_merge(path, frame(changed), ["k"], prune=True)
    assert (pruned["pruned"], pruned["written"]) == (1, 0)
    versions = table.versions()
    again = merge.staged_merge(path, frame(changed), ["k"], prune=True)
    assert (again["rewritten"], again["written"], again["pruned"]) == (0, 0, 0) and table.versions() == versions
    assert rows_of(table.read()) == sorted(changed)
    assert merge.staged_merge(path, frame([(3, "b")]), ["k"], prune=True)["pruned"] == 98
    assert rows_of(table.read()) == [(3, "b")]
    # A source of one key reads one bucket, and the rows of the others still count as stale.
    assert counts(merge.staged_merge(path, frame([(5, "z")]), ["k"]))["stale"] == 1


def test_another_number_of_buckets(spark, frame, tmp_path):
    path, table = f"file://{tmp_path}/t", KeyedTable(spark, f"file://{tmp_path}/t")
    rows = [(i, "a") for i in range(100)]
    merge.staged_merge(path, frame(rows), ["k"], buckets=64)
    merge.staged_merge(path, frame([(0, "b")]), ["k"], buckets=32)
    assert len(table.manifest()["buckets"]) == 32
    assert rows_of(table.read()) == sorted([(0, "b"), *rows[1:]])
    with pytest.raises(ValueError, match="power of two"):
        merge.staged_merge(path, frame(rows), ["k"], buckets=12)
    with pytest.raises(ValueError, match="keys"):
        merge.staged_merge(path, frame(rows), ["v"])
    with pytest.raises(ValueError, match="columns"):
        merge.staged_merge(path, frame(rows).withColumnRenamed("v", "w"), ["k"])


def test_repeated_keys_raise(spark, frame, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(Exception, match="repeats a key"):
        merge.staged_merge(path, frame([(1, "a"), (1, "b"), (2, "c")]), ["k"])
    merge.staged_merge(path, frame([(1, "a")]), ["k"])
    with pytest.raises(Exception, match="repeats a key"):
        merge.staged_merge(path, frame([(None, "a"), (None, "b")]), ["k"])
    assert rows_of(KeyedTable(spark, path).read()) == [(1, "a")]
    once, twice = frame([(1, "a"), (2, "b")]), frame([(1, "a"), (1, "b")])
    for pair in ((once, twice), (twice, once)):
        with pytest.raises(Exception, match="repeats a key"):
            diff.snapshot_diff(*pair, ["k"]).collect()
    assert diff.snapshot_diff(once, twice, ["k"], checked=False).count() == 3
    plan = diff.snapshot_diff(once, once, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one for each side, as without the check


def test_buckets_split_as_they_grow(spark, frame, tmp_path):
    path, table = f"file://{tmp_path}/t", KeyedTable(spark, f"file://{tmp_path}/t")
    table.create(frame([]).schema, ["k"], buckets=2, split_rows=50)
    rows = [(i, "a") for i in range(400)]
    merge.staged_merge(path, frame(rows), ["k"])
    sizes = [b["rows"] for b in table.manifest()["buckets"].values()]
    assert len(sizes) >= 8 and max(sizes) < 80 and sum(sizes) == 400
    more = [(i, "b") for i in range(300, 1200)]
    merge.staged_merge(path, frame(more), ["k"])
    assert rows_of(table.read()) == sorted(rows[:300] + more)
    assert merge.staged_merge(path, frame(rows[:300] + more), ["k"], prune=True)["rewritten"] == 0
    depths = {b.split("-")[0] for b in table.manifest()["buckets"]}
    assert sum(2.0 ** -int(b.split("-")[0]) for b in table.manifest()["buckets"]) == 1 and depths


def test_a_reader_stays_on_its_version(spark, frame, tmp_path):
    path, table = f"file://{tmp_path}/t", KeyedTable(spark, f"file://{tmp_path}/t")
    first = merge.staged_merge(path, frame([(i, "a") for i in range(20)]), ["k"], buckets=4)["version"]
    reader = table.read()
    merge.staged_merge(path, frame([(i, "b") for i in range(10)]), ["k"], prune=True)
    assert {r["v"] for r in reader.collect()} == {"a"} and reader.count() == 20
    assert table.read(first).count() == 20
    assert table.vacuum() > 0 and table.read().count() == 10 and len(table.versions()) == 1


def test_of_two_writers_one_is_refused(spark, frame, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t")
    seen = table.create(frame([]).schema, ["k"], buckets=2)
    rows = frame([(1, "a")])
    touched = [r[0] for r in rows.select(table.bucket(seen)).collect()]
    table.rewrite(seen, rows, touched)
    with pytest.raises(VersionConflict):
        table.rewrite(seen, frame([(1, "z")]), touched)
    assert rows_of(table.read()) == [(1, "a")]


SCHEMA = "id int, n long, op string, v string"


def ops(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(subscriber):
    return sorted((r["id"], r["v"]) for r in subscriber.state().collect())


def test_a_subscription_is_found_again(spark, tmp_path):
    first = replication.StreamSubscriber(spark, "id", "n", name="again-" + tmp_path.name)
    first.apply(ops(spark, [(1, 1, "insert", "a"), (2, 2, "insert", "b")]), 0)
    second = replication.StreamSubscriber(spark, "id", "n", name="again-" + tmp_path.name)
    second.apply(ops(spark, [(1, 1, "insert", "a"), (2, 2, "insert", "b")]), 0)  # replayed
    second.apply(ops(spark, [(3, 3, "insert", "c"), (1, 4, "update", "d")]), 1)
    assert state(second) == state(first) == [(1, "d"), (2, "b"), (3, "c")]
    second.enabled = False
    third = replication.StreamSubscriber(spark, "id", "n", name="again-" + tmp_path.name)
    third.apply(ops(spark, [(9, 9, "insert", "x")]), 2)
    assert not third.enabled and state(third) == [(1, "d"), (2, "b"), (3, "c")]


def test_a_batch_that_dies_before_its_version_is_applied_again(spark, monkeypatch):
    own = replication.StreamSubscriber(spark, "id", "n")
    own.apply(ops(spark, [(1, 1, "insert", "a")]), 0)
    late = ops(spark, [(1, 2, "update", "b"), (2, 3, "insert", "c")])
    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            own.apply(late, 1)
    assert state(own) == [(1, "a")]
    own.apply(late, 1)
    assert state(own) == [(1, "b"), (2, "c")]


def test_batches_out_of_order_truncates_and_the_horizon(spark):
    own = replication.StreamSubscriber(spark, "id", "n")
    own.apply(ops(spark, [(1, 5, "update", "late"), (2, 2, "insert", "b")]), 0)
    own.apply(ops(spark, [(1, 1, "insert", "a"), (2, 4, "delete", None)]), 1)  # before what the first batch brought
    assert state(own) == [(1, "late")]
    own.compact(5)
    assert own.table.read().filter("_kind = 'op'").count() == 0 and state(own) == [(1, "late")]
    own.apply(ops(spark, [(0, 8, "truncate", None), (3, 7, "insert", "gone"), (4, 9, "insert", "d")]), 2)
    assert state(own) == [(4, "d")]
    own.compact(9)
    own.apply(ops(spark, [(5, 10, "insert", "e"), (4, 11, "update", "f")]), 3)  # the base outlives an earlier truncate
    assert state(own) == [(4, "f"), (5, "e")]


def test_batches_touch_the_buckets_of_their_keys(spark):
    own = replication.StreamSubscriber(spark, "id", "n", buckets=16)
    own.apply(ops(spark, [(i, i, "insert", "a") for i in range(200)]), 0)
    before = own.table.manifest()["buckets"]
    own.apply(ops(spark, [(7, 1000, "update", "z")]), 1)
    after = own.table.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and json.dumps(after)


def test_listing_many_buckets_takes_few_tasks(spark, tmp_path):
    own = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(own)
    with KeyedTable(spark, f"file://{tmp_path}")._few_listing_tasks():
        assert spark.conf.get(own) == "64"
    assert spark.conf.get(own) == before


def test_a_batch_writes_aside_what_is_new_only(spark, monkeypatch):
    """Operations held are read where they lie: what a batch writes aside does not grow with those before it."""
    schema, written = "id long, n long, op string, v string", []
    kept = replication.materialize
    monkeypatch.setattr(replication, "materialize", lambda df, name="stage": written.append((name, kept(df, name))) or written[-1][1])
    monkeypatch.setattr(replication, "scratch", lambda spark: contextlib.nullcontext())
    subscriber = replication.StreamSubscriber(spark, "id", "n", buckets=2)
    subscriber.apply(spark.createDataFrame([(i % 5, i, "update" if i > 4 else "insert", str(i)) for i in range(500)], schema), 0)
    written.clear()
    late = [(i, 500 + i, "delete" if i == 3 else "update", "z") for i in range(5)]
    # Sent again, and twice: the same rows again.
    subscriber.apply(spark.createDataFrame(late + late[:1] + [(4, 4, "insert", "4")], schema), 1)
    assert all(df.count() <= 7 for _, df in written)
    assert state(subscriber) == [(0, "z"), (1, "z"), (2, "z"), (4, "z")]
    assert subscriber.table.read().filter("_kind = 'op'").count() == 505


@pytest.mark.parametrize("rows", (1_000_000, 20))
def test_rows_of_a_subscription_are_those_of_the_fold(spark, monkeypatch, rows):
    """Large keys are dealt out in pieces, nulls among keys and values included."""
    monkeypatch.setattr(replication, "PIECE_ROWS", rows)
    rng = random.Random(rows)
    ops = [(rng.choice([None, 1, 2, 3, *[9] * 6, *range(10, 60)]), n, "truncate" if n == 20 else rng.choice(["insert", "update", "update", "delete"]), rng.choice([None, "a", "b"])) for n in range(900)]
    rng.shuffle(ops)
    feed, initial = spark.createDataFrame(ops, "k long, n long, op string, v string"), spark.createDataFrame([(70, None)], "k long, v string")
    for cut in (feed, feed.filter("op <> 'truncate'")):
        folded = replication.fold_feed(cut, "k", "n", initial=initial).filter("present")
        found = replication.subscribed_state(cut.unionByName(cut.filter("n % 7 = 0")), "k", "n", initial=initial)
        assert sorted(map(str, found.collect())) == sorted(map(str, folded.select("k", "v").collect()))


def test_the_feed_of_a_restart_is_written_and_read_by_many_tasks(spark, tmp_path):
    from pactum.plans.session import list_names, shared_folder
    from pactum.queries import routines

    rows = spark.range(4000).selectExpr("id AS event_id", "id % 30 AS user_id", "'view' AS event_type")
    rows.repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    before = set(list_names(spark, shared_folder(spark)))
    files = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        found = {tuple(r) for r in routines.cdc2_restart(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", files)
    assert found == {(r["user_id"], r["kind"]) for r in routines.cdc2(spark, str(tmp_path)).filter("present").collect()}
    (feed,) = [n for n in set(list_names(spark, shared_folder(spark))) - before if n.startswith("feed-") and not n.endswith("-checkpoint")]
    assert len([n for n in list_names(spark, f"{shared_folder(spark)}/{feed}") if n.startswith("part-")]) > 4
    (name,) = [n for n in set(list_names(spark, shared_folder(spark))) - before if n.startswith("subscription-")]
    assert KeyedTable(spark, f"{shared_folder(spark)}/{name}").manifest()["meta"]["batch"] == 3  # two batches a run still


def files_below(folder):
    return [p for p in folder.rglob("*.parquet")]


def test_small_buckets_share_files(spark, frame, tmp_path, monkeypatch):
    path, table = f"file://{tmp_path}/t", KeyedTable(spark, f"file://{tmp_path}/t")
    table.create(frame([]).schema, ["k"], buckets=2, split_rows=20)
    rows = [(i, "a") for i in range(1000)]
    merge.staged_merge(path, frame(rows), ["k"])
    assert len(table.manifest()["buckets"]) >= 64 and len(files_below(tmp_path / "t")) == 1
    # What has been rewritten since is left out of the files of before, and one bucket alone can be read.
    seen, late = table.manifest(), [(i, "b") for i in range(0, 1000, 199)]
    merge.staged_merge(path, frame(late), ["k"])
    merge.staged_merge(path, frame([(0, "c")]), ["k"])
    now = {**dict(rows), **dict(late), 0: "c"}
    assert rows_of(table.read()) == sorted(now.items()) and rows_of(table.read(manifest=seen)) == rows
    manifest = table.manifest()
    for key in (0, 1, 199):
        (name,) = [r[0] for r in frame([(key, "")]).select(table.bucket(manifest)).collect()]
        found = rows_of(table.read(buckets=[name]))
        assert (key, now[key]) in found and len(found) == manifest["buckets"][name]["rows"]
    monkeypatch.setattr("pactum.sources.keyed_table.GROUP_ROWS", 100)
    table.rebucket(4)
    assert 8 <= len(files_below(next(f for f in (tmp_path / "t/data").iterdir() if f.name in table.manifest()["folders"]))) <= 16
    assert rows_of(table.read()) == sorted(now.items())


def test_a_table_with_a_folder_for_each_bucket_is_still_read(spark, frame, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t")
    manifest, rows = table.create(frame([]).schema, ["k"], buckets=2), frame([(i, "a") for i in range(10)])
    rows.withColumn("_bucket", table.bucket(manifest)).write.partitionBy("_bucket").parquet(f"{tmp_path}/t/data/old")
    sizes = {r[0]: r[1] for r in rows.groupBy(table.bucket(manifest)).count().collect()}
    table.commit(manifest | {"buckets": {b: {"folder": "old", "rows": n} for b, n in sizes.items()}})
    assert rows_of(table.read()) == [(i, "a") for i in range(10)]
    merge.staged_merge(table.path, frame([(3, "b")]), ["k"])
    assert rows_of(table.read()) == [(i, "b" if i == 3 else "a") for i in range(10)]


@pytest.mark.parametrize("name", ("mrg1_table_versions", "mrg1_staged_merge"))
def test_new_keys_that_orders_has_already(spark, tmp_path, name):
    """From 10,000,000 on, the keys that ``desired`` gives its copies are those of other orders."""
    import duckdb

    from pactum.queries import merges

    small = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    small.unionByName(small.withColumn("o_orderkey", small["o_orderkey"] + 10_000_000)).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
        wanted = db.execute(merges.SQL[name]).fetchall()
    assert sorted(tuple(r) for r in merges.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(wanted)
