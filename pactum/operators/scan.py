"""Numbers, running states and moving states within a partition, whatever share of all rows one partition has.

No step puts the rows of a partition into one task. Rows are numbered from a range sort, whose parts cut a large
partition into segments. From then on a row is addressed by (partition, number), and states are gathered in blocks of
at most ``BLOCK`` neighbours: each block is folded by itself, the totals of the blocks are the rows of the next level,
and a block's carry is joined back by (partition, block). The levels are logarithmic in the longest partition.

A state is any column; null means that no value has come yet, as for a strict transition function. ``combine`` has to
be associative, and sees two states that are not null, the earlier one first.

Joins of tables that grow with the rows ask for a merge join: Spark judges a table by its compressed bytes, and would
send one of a million short keys through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize, quoted

BLOCK = 64
ROUND = 1 << 18  # rows of a partition that one round of an ordered fold takes

Combine = Callable[[Column, Column], Column]


def _key(partition: Sequence[str]) -> Column:
    """One column for a partition, never null, in which nulls are equal."""
    return F.struct(F.lit(0).alias("_0"), *(F.col(quoted(c)) for c in partition))


def _segmented(df: DataFrame, partition: Sequence[str], order: Sequence[Column], ties: Sequence[Column] = ()) -> DataFrame:
    """``df`` range sorted and written, with _key, _part (number of the sort's part) and _row (place in the part): a
    partition's rows in one part are a segment of it."""
    return materialize(
        df.withColumn("_key", _key(partition))
        .repartitionByRange("_key", *order)
        .sortWithinPartitions("_key", *order, *ties)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "segments",
    )


def numbered(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "number", ties: Sequence[Column] = ()) -> DataFrame:
    """``df`` with the 1-based number of each row in its partition. The order, then ``ties``, have to be total there.
    Rows that only ``ties`` tell apart are not cut into segments; wide columns do not go into the range sort's sample.

    The only windows run over segments: one row for each partition and part of the range sort.
    """
    placed = _segmented(df, partition, order, ties)
    segments = placed.groupBy("_key", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(segments.drop("_n").hint("merge"), ["_key", "_part"])
    return joined.withColumn(name, F.col("_row") - F.col("_first") + F.col("_before") + 1).select(*(F.col(quoted(c)) for c in df.columns), name)


def last_before(df: DataFrame, partition: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the last value that is not null among the rows before each one in its partition.

    Windows run within a segment, and over the last values of a partition's segments."""
    placed = _segmented(df.withColumn("_value", value), partition, order)
    within = Window.partitionBy("_key", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    lasts = placed.groupBy("_key", "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_row"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("_key", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    local = placed.withColumn("_local", F.last("_value", ignorenulls=True).over(within)).join(lasts.hint("merge"), ["_key", "_part"])
    return local.withColumn(name, F.coalesce("_local", "_carry")).select(*(F.col(quoted(c)) for c in df.columns), name)


def segment_totals(
    df: DataFrame, partition: Sequence[str], order: Sequence[Column], totals: Mapping[str, Callable[[str], Column]], wanted: Column, keep: Sequence[str]
) -> DataFrame:
    """(keep, totals): for the ``wanted`` rows the totals (sum, min, ... of a column's name; nulls do not count) of the
    rows of their partition up to each one, in two rows at most: of its own segment, and of those before."""
    placed = _segmented(df, partition, order)
    at = Window.partitionBy("_key", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("_key", "_part", *keep, wanted.alias("_wanted"), *(f(name).over(at).alias(name) for name, f in totals.items())).filter("_wanted")
    segments = placed.groupBy("_key", "_part").agg(*(f(name).alias(name) for name, f in totals.items()))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = segments.select("_key", "_part", *(f(name).over(before).alias(name) for name, f in totals.items()))
    asking = placed.filter(wanted).select("_key", "_part", *keep)
    return within.select(*keep, *totals).unionByName(asking.join(carry.hint("merge"), ["_key", "_part"]).select(*keep, *totals))


def combined(a: Column, b: Column, combine: Combine) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))


def _prefixes(rows: DataFrame, combine: Combine, block: int) -> DataFrame:
    """(_key, _pos, _prefix) of (_key, _pos, _state): the states up to each position, combined."""
    placed = rows.withColumn("_block", F.expr(f"(_pos - 1) div {block}"))
    kind = rows.schema["_state"].dataType.simpleString()
    none = F.expr(f"CAST(array() AS array<struct<p: bigint, s: {kind}>>)")

    def grown(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)["s"]
        return F.array_append(done, F.struct(x["p"].alias("p"), combined(last, x["s"], combine).alias("s")))

    items = F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("p"), F.col("_state").alias("s"))), lambda x, y: (x["p"] - y["p"]).cast("int"))
    folded = placed.groupBy("_key", "_block").agg(items.alias("_items"))
    folded = materialize(folded.select("_key", "_block", F.aggregate("_items", none, grown).alias("_items")), "scan")
    local = folded.select("_key", "_block", F.explode("_items").alias("_i")).select("_key", "_block", F.col("_i.p").alias("_pos"), F.col("_i.s").alias("_local"))
    if folded.filter("_block > 0").isEmpty():
        return local.select("_key", "_pos", F.col("_local").alias("_prefix"))
    totals = folded.select("_key", (F.col("_block") + 1).alias("_pos"), F.element_at("_items", -1)["s"].alias("_state"))
    # The prefix of block b is the carry of block b + 1; positions of totals begin with 1.
    carry = _prefixes(totals, combine, block).select("_key", F.col("_pos").alias("_block"), F.col("_prefix").alias("_carry"))
    joined = local.join(carry.hint("merge"), ["_key", "_block"], "left")
    return joined.select("_key", "_pos", combined(F.col("_carry"), F.col("_local"), combine).alias("_prefix"))


def running_state(df: DataFrame, partition: Sequence[str], number: str, state: Column, combine: Combine, name: str = "state", block: int = BLOCK) -> DataFrame:
    """``df`` with the combined ``state`` of its rows up to each one. ``number`` is 1..n in each partition."""
    key = _key(partition)
    own = df.withColumn("_key", key).withColumn("_pos", F.col(number))
    found = _prefixes(own.select("_key", "_pos", state.alias("_state")), combine, block)
    return own.join(found.hint("merge"), ["_key", "_pos"]).withColumn(name, F.col("_prefix")).select(*(F.col(quoted(c)) for c in df.columns), name)


def moving_state(
    df: DataFrame,
    partition: Sequence[str],
    number: str,
    state: Column,
    combine: Combine,
    rows: int,
    inverse: Combine | None = None,
    name: str = "state",
    block: int = BLOCK,
) -> DataFrame:
    """``df`` with the combined ``state`` of the last ``rows`` rows, this one included.

    With ``inverse`` (the whole, its beginning) -> its end, a frame is the difference of two running states, and the
    number of states in it tells an empty frame. Without, the partition is cut into runs of ``rows`` numbers: a frame
    is the end of one run and the beginning of the next, each a running state within its run.
    """
    if rows < 1:
        raise ValueError("a frame has at least one row")
    kept = [F.col(quoted(c)) for c in df.columns]
    if inverse is not None:
        seen = df.withColumn("_s", state)
        both = F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("s"), F.lit(1).cast("long").alias("n")))
        add = lambda a, b: F.struct(combine(a["s"], b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"))
        total = materialize(running_state(seen, partition, number, both, add, "_upto", block), "moving")
        key = _key(partition)
        earlier = total.select(key.alias("_key"), (F.col(number) + rows).alias("_at"), F.col("_upto").alias("_before"))
        joined = total.withColumn("_key", key).withColumn("_at", F.col(number)).join(earlier.hint("merge"), ["_key", "_at"], "left")
        whole, before = F.col("_upto"), F.col("_before")
        frame = F.when(before.isNull(), whole["s"]).when(whole["n"] > before["n"], inverse(whole["s"], before["s"]))
        return joined.withColumn(name, frame).select(*kept, name)
    # Every row is the end of the first part of one frame and the beginning of the second part of another.
    run = df.withColumns({"_s": state, "_run": F.expr(f"({quoted(number)} - 1) div {rows}"), "_in": F.col(number) - 1})
    run = run.withColumns({"_in": F.col("_in") % rows + 1, "_out": rows - F.col("_in") % rows})
    run = materialize(run, "runs")
    own = [*partition, "_run"]
    # The last run may be short; numbers from its end would not begin with 1, and no frame needs its suffixes.
    last = run.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") == rows)
    key = _key(own)
    full = run.withColumn("_key", key).join(last.select(key.alias("_key")).hint("merge"), "_key", "left_semi")
    heads = running_state(run, own, "_in", F.col("_s"), combine, "_head", block)
    tails = _prefixes(full.select("_key", F.col("_out").cast("long").alias("_pos"), F.col("_s").alias("_state")), lambda a, b: combine(b, a), block)
    # A suffix that has k rows of run r goes with row (rows - k) of run r + 1.
    tails = tails.select(
        F.col("_key").withField("_run", F.col("_key")["_run"] + 1).alias("_key"),
        (rows - F.col("_pos")).alias("_at"),
        F.col("_prefix").alias("_tail"),
    )
    joined = heads.withColumn("_key", key).withColumn("_at", F.col("_in")).join(tails.hint("merge"), ["_key", "_at"], "left")
    return joined.withColumn(name, combined(F.col("_tail"), F.col("_head"), combine)).select(*kept, name)


def gathered_pieces(
    df: DataFrame, partition: Sequence[str], order: Sequence[Column], values: Sequence[Column], name: str, size: int, ties: Sequence[Column] = ()
) -> DataFrame:
    """(partition, piece, ``name``): the rows of a partition in order as arrays of at most ``size`` structs of
    ``values``, numbered from 1. A partition of any length is spread over tasks, and none holds more than a piece."""
    if size < 1:
        raise ValueError("a piece has at least one row")
    keys = [F.col(quoted(c)) for c in partition]
    # The range sort has names of its own, so that columns called like its helpers do no harm.
    named = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.struct(*values).alias("v"), F.struct(*order).alias("o"), F.struct(F.lit(0), *ties).alias("t"))
    own = [f"k{i}" for i in range(len(keys))]
    placed = numbered(named, own, [F.col("o")], "at", [F.col("t")])
    items = F.array_sort(F.collect_list(F.struct("at", "v")), lambda x, y: (x["at"] - y["at"]).cast("int"))
    pieces = placed.groupBy(*own, F.expr(f"(at - 1) div {size} + 1").alias("piece")).agg(F.transform(items, lambda x: x["v"]).alias(name))
    return pieces.select(*(F.col(k).alias(c) for k, c in zip(own, partition)), "piece", F.col(quoted(name)))


def ordered_fold(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[Column],
    value: Column,
    initial: Column,
    step: Combine,
    final: Callable[[Column], Column],
    name: str = "state",
    strict: bool = True,
    size: int = 100_000,
) -> DataFrame:
    """(partition, ``name``): a transition that need not be associative, folded over each partition's values in order.

    Partitions of up to ``size`` rows are folded at once. Of a longer one each round folds as many pieces as have ``ROUND``
    rows, with the state carried in a written table: no task sees more of a partition. The order has to be total. A
    strict transition does not see nulls. The state's type is that of ``initial``.
    """
    run = max(1, ROUND // size)
    pieces = gathered_pieces(df, partition, order, [value.alias("v")], "_items", size)
    pieces = materialize(pieces.select(_key(partition).alias("_key"), F.col("piece").alias("_piece"), F.col("_items.v").alias("_items")), "pieces")
    given = (lambda items: F.filter(items, lambda x: x.isNotNull())) if strict else (lambda items: items)
    long = pieces.filter("_piece = 2").select("_key")
    begun = pieces.filter("_piece = 1").withColumn("_state", F.aggregate(given(F.col("_items")), initial, step)).select("_key", "_state")
    rounds = pieces.agg(F.max("_piece")).first()[0] or 0
    if rounds < 2:
        done = begun
    else:
        carried = materialize(begun.join(long, "_key", "left_semi"), "fold")
        # Sorted by piece, so that a round reads the files and row groups of its own pieces only.
        later = materialize(pieces.filter("_piece > 1").repartitionByRange("_piece", "_key").sortWithinPartitions("_piece"), "later")
        for at in range(2, rounds + 1, run):
            own = later.filter(F.col("_piece").between(at, at + run - 1)).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_piece", "_items"))).alias("_run"))
            folded = F.aggregate(F.col("_run"), F.col("_state"), lambda s, piece: F.aggregate(given(piece["_items"]), s, step))
            more = carried.join(own, "_key", "left")
            carried = materialize(more.select("_key", F.when(F.col("_run").isNull(), F.col("_state")).otherwise(folded).alias("_state")), "fold")
        done = begun.join(long, "_key", "left_anti").unionByName(carried)
    return done.select(*(F.col("_key")[c].alias(c) for c in partition), final(F.col("_state")).alias(name))


def ordered_set(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    continuous: dict[str, float] | None = None,
    discrete: dict[str, float] | None = None,
    mode: str | None = None,
) -> DataFrame:
    """One row for each group with the named percentiles and the most frequent value (of equally frequent ones the
    smallest). Nulls do not count; a group of nulls only has null results.

    Equal values are counted before they are sorted, so neither a frequent value nor a large group fills a task, and no
    group's values are held in memory. A percentile is the value whose running count covers its position.
    """
    wanted = {**(continuous or {}), **(discrete or {})}
    if any(not 0 <= p <= 1 for p in wanted.values()):
        raise ValueError("a percentile lies between 0 and 1")
    counts = df.select(_key(keys).alias("g"), value.alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts, "values")
    sizes = counts.groupBy("g").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("n"))
    found = counts.filter("v IS NOT NULL")
    if wanted:
        found = running_state(numbered(found, ["g"], [F.col("v")], "at"), ["g"], "at", F.col("c"), lambda a, b: a + b, "upto")
        found = found.join(sizes.hint("merge"), "g")
    at = lambda place: F.max(F.when((F.col("upto") - F.col("c") < place) & (place <= F.col("upto")), F.col("v")))
    n, out = F.col("n"), []
    for name, p in (discrete or {}).items():
        out.append(at(F.greatest(F.ceil(F.lit(float(p)) * n), F.lit(1))).alias(name))
    for name, p in (continuous or {}).items():
        place = F.lit(float(p)) * (n - 1)
        low, high = at(F.floor(place) + 1), at(F.ceil(place) + 1)
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    if mode:
        out.append(F.min(F.struct((-F.col("c")).alias("c"), F.col("v").alias("v")))["v"].alias(mode))
    joined = sizes.select("g").join(found.groupBy("g").agg(*out).hint("merge"), "g", "left")
    return joined.select(*(F.col("g")[c].alias(c) for c in keys), *(F.col(quoted(x)) for x in joined.columns if x != "g"))
