"""Joins on intervals and inequalities, by equality only.

Points and intervals. Values are put on a line of whole numbers (integers, days, microseconds, decimals without their
point). A dyadic node (level k, index i) holds the numbers from i 2^k up to (i + 1) 2^k - 1. An interval is at most two
nodes a level, and a point lies in one node of each level, so both meet on (level, index): an interval of any width,
or without a bound, costs the logarithm of its width, and no pair has to be compared afterwards. The pairs of a node are
cut into cells (``cells.paired``). Where only totals of the pairs are wanted, nodes are totalled and no pair is made.

Inequalities. Both sides are sorted into blocks; a block is known by the least and greatest value of each column. Blocks
that may have a pair are found by an interval join on the ranks of their bounds, those that another inequality rules
out are skipped, and only rows of the blocks that are left meet, on their blocks' numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import all_columns, materialize, quoted
from .cells import paired
from .ordering import global_ordinal
from .scan import numbered, segment_totals

TOP = 62  # levels of the line; its ends are -2^62 and 2^62 - 1
LEAST, MOST = -(1 << TOP), (1 << TOP) - 1
DEALT = 5_000  # intervals of one task


def _scale(kinds: Sequence[T.DataType]) -> int:
    return max((k.scale for k in kinds if isinstance(k, T.DecimalType)), default=0)


def on_line(value: Column, kind: T.DataType, scale: int = 0) -> Column:
    """A value as a whole number, in the same order; null for null. Beyond the line's ends it is refused."""
    if isinstance(kind, T.DateType):
        number = F.unix_date(value).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, (T.DecimalType, T.IntegralType)):
        number = (value.cast(f"decimal(38,{scale})") * F.lit(10**scale).cast("decimal(19,0)")).cast("long") if scale else value.cast("long")
    else:
        raise TypeError(f"{kind.simpleString()} is not on a line of whole numbers; cast it to a decimal")
    return F.when(number.between(LEAST, MOST), number).when(number.isNotNull(), F.raise_error(F.lit("value beyond 2^62")))


def nodes(lower: Column, upper: Column, bits: int = 1, most: int = 1 << TOP) -> Column:
    """The dyadic nodes (k, i) of the numbers from ``lower`` to ``upper``, both included. A level is ``bits`` binary
    digits: more of them mean fewer levels, and more nodes of each. No interval has more than ``most`` numbers, so there
    are no levels of larger nodes."""
    top = (most.bit_length() - 1) // bits

    def ends(k: Column) -> tuple[Column, Column]:
        # The first node that begins at or after lower, and the first one that does not end by upper.
        digits = (k * bits).cast("int")
        low = -F.call_function("shiftright", -lower, digits)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), digits) - 1
        return low, F.call_function("shiftright", upper, digits) + (upper.bitwiseAND(mask) == mask).cast("long")

    def run(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    def at(k: Column) -> Column:
        low, high = ends(k)
        over, under = ends(k + 1)
        above = (k < top) & (over < under)  # nodes of the next level take what is between
        own = F.when(above, F.concat(run(low, over * (1 << bits)), run(under * (1 << bits), high))).otherwise(run(low, high))
        return F.transform(own, lambda i: F.struct(k.alias("k"), i.alias("i")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), at))


def _placed(rows: DataFrame, lower: Column, upper: Column, kinds: Sequence[T.DataType], bounds: str | tuple[Column, Column]) -> DataFrame:
    """``rows`` with _lo and _hi, the least and greatest number in the interval; empty ones are left out."""
    scale = _scale(kinds)
    lo, hi = on_line(lower, kinds[0], scale), on_line(upper, kinds[1], scale)
    inside = bounds if isinstance(bounds, tuple) else (F.lit(bounds[0] == "["), F.lit(bounds[1] == "]"))
    lo = F.coalesce(lo + F.when(inside[0], 0).otherwise(1), F.lit(LEAST))
    hi = F.coalesce(hi - F.when(inside[1], 0).otherwise(1), F.lit(MOST))
    return rows.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")


def _held(placed: DataFrame, numbers: DataFrame, rows: int) -> tuple[DataFrame, list[int], int]:
    """``placed`` (with _lo, _hi; a table of ``rows`` rows) with _k and _i of each of its nodes, the levels in use, and
    the binary digits of a level: few where the intervals are many, more where the numbers that meet them (_at of
    ``numbers``) are. Intervals are cut to the span of the numbers, so one without a bound has no more levels than that."""
    least, most, asked = numbers.agg(F.min("_at"), F.max("_at"), F.count("_at")).first()
    bits = min((1, 2, 4), key=lambda b: (asked + rows * ((1 << b) - 1)) / b)
    cut = placed.withColumns({"_cl": F.greatest("_lo", F.lit(least).cast("long")), "_ch": F.least("_hi", F.lit(most).cast("long"))})
    # Nodes are slow to find, and a table of intervals may be one small file: it is dealt out, and they are found once.
    cut = cut.filter("_cl <= _ch" if asked else "false").repartition(max(1, ceil(rows / DEALT)))
    cut = cut.withColumn("_node", F.explode(nodes(F.col("_cl"), F.col("_ch"), bits, most - least + 1 if asked else 1)))
    cut = materialize(cut.select(*all_columns(placed), F.col("_node.k").alias("_k"), F.col("_node.i").alias("_i")), "nodes")
    levels = sorted(r["_k"] for r in cut.select("_k").distinct().collect())  # at most one a level
    return cut, levels or [0], bits


def _at_levels(numbers: DataFrame, levels: Sequence[int], bits: int) -> DataFrame:
    asked = numbers.withColumn("_k", F.explode(F.array(*map(F.lit, levels))))
    return asked.withColumn("_i", F.expr(f"shiftright(_at, _k * {bits})"))


def _met(points: DataFrame, placed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``points`` (with _at) and ``placed`` (with _lo, _hi) whose interval holds the point."""
    # Written with ids, since the pieces of a large node's rows have to be the same whenever they are made.
    points = materialize(points.filter("_at IS NOT NULL").withColumn("_pid", F.monotonically_increasing_id()), "points")
    placed = materialize(placed.withColumn("_rid", F.monotonically_increasing_id()), "intervals")
    held, levels, bits = _held(placed, points, placed.count())
    return paired(_at_levels(points, levels, bits), held, [*on, "_k", "_i"], "_pid", "_rid").drop("_k", "_i", "_pid", "_rid")


#: Name of a total: the aggregate over rows, and the function that makes one of several such values. The function does
#: not see nulls (sum, min, max, bit_or, ...).
Totals = Mapping[str, tuple[Column, Callable[[str], Column]]]


def _total(df: DataFrame, by: Sequence[str], totals: Totals) -> DataFrame:
    return df.groupBy(*by).agg(*(combine(name).alias(name) for name, (_, combine) in totals.items()))


def _held_totals(numbers: DataFrame, placed: DataFrame, on: Sequence[str], keys: Sequence[str], totals: Totals) -> DataFrame:
    """(keys, totals): for each interval the totals of the numbers in it. ``numbers``: on, _at, totals."""
    numbers = materialize(numbers.filter("_at IS NOT NULL"), "numbers")
    placed = materialize(placed.select(*dict.fromkeys([*on, *keys]), "_lo", "_hi"), "intervals")
    held, levels, bits = _held(placed, numbers, placed.count())
    at_node = _total(_at_levels(numbers, levels, bits), [*on, "_k", "_i"], totals)
    return _total(held.join(at_node.hint("merge"), [*on, "_k", "_i"]), keys, totals)


def range_totals(
    points: DataFrame, point: Column, ranges: DataFrame, lower: Column, upper: Column, keys: Sequence[str], totals: Totals, bounds: str = "[)", on: Sequence[str] = ()
) -> DataFrame:
    """What a ``range_join`` grouped by ``keys`` of the ranges gives, without making its pairs: points are totalled for
    each value, then for each dyadic node, and a range takes the totals of its nodes."""
    asked, placed = _on_one_line(points, point, ranges, lower, upper, bounds)
    numbers = asked.groupBy(*on, "_at").agg(*(own.alias(name) for name, (own, _) in totals.items()))
    return _held_totals(numbers, placed, on, keys, totals)


def _on_one_line(points: DataFrame, point: Column, ranges: DataFrame, lower: Column, upper: Column, bounds: str) -> tuple[DataFrame, DataFrame]:
    """The points with _at, the ranges with _lo and _hi."""
    kinds = [points.select(point).schema[0].dataType, *(ranges.select(c).schema[0].dataType for c in (lower, upper))]
    common = _common(kinds)
    asked = points.withColumn("_at", on_line(point, kinds[0], _scale(kinds)))
    return asked, _placed(ranges, lower.cast(common), upper.cast(common), [common] * 2, bounds)


def range_join(points: DataFrame, point: Column, ranges: DataFrame, lower: Column, upper: Column, bounds: str = "[)", on: Sequence[str] = ()) -> DataFrame:
    """Points joined to the ranges that hold them, with all columns of both. A null bound is unbounded, a null point is
    in no range. ``on`` names columns that also have to be equal."""
    asked, placed = _on_one_line(points, point, ranges, lower, upper, bounds)
    return _met(asked, placed, on).drop("_at", "_lo", "_hi")


def _common(kinds: Sequence[T.DataType]) -> T.DataType:
    """The type in which values are compared: a null literal takes the others' type."""
    real = [k for k in kinds if not isinstance(k, T.NullType)]
    scale = _scale(real)
    return T.DecimalType(38, scale) if scale else real[0]


def _ranges_on_one_line(left: DataFrame, left_range: Column, right: DataFrame, right_range: Column) -> list[DataFrame]:
    """Both sides with the least and greatest number of their ranges: _llo and _lhi, _rlo and _rhi."""
    kinds = [df.select(r).schema[0].dataType[end].dataType for df, r in ((left, left_range), (right, right_range)) for end in ("lower", "upper")]
    common = _common(kinds)
    return [
        _placed(df.filter(r.isNotNull()), r["lower"].cast(common), r["upper"].cast(common), [common] * 2, (r["lower_inc"], r["upper_inc"])).withColumnsRenamed({"_lo": f"_{s}lo", "_hi": f"_{s}hi"})
        for df, r, s in ((left, left_range, "l"), (right, right_range, "r"))
    ]


def overlap_join(left: DataFrame, left_range: Column, right: DataFrame, right_range: Column, on: Sequence[str] = ()) -> DataFrame:
    """Rows whose ranges (structs of ``range_value``) share a value: of two such ranges, one holds the other's first
    value. Null and empty ranges meet none."""
    placed = _ranges_on_one_line(left, left_range, right, right_range)
    starts_in_right = _met(placed[0].withColumn("_at", F.col("_llo")), placed[1].withColumnsRenamed({"_rlo": "_lo", "_rhi": "_hi"}), on)
    # Equal starts are found once: here the left range begins before the right one.
    after = placed[0].withColumn("_lo", F.col("_llo") + 1).withColumnRenamed("_lhi", "_hi").filter("_lo <= _hi")
    starts_in_left = _met(placed[1].withColumn("_at", F.col("_rlo")), after, on)
    first = starts_in_right.drop("_at", "_lo", "_hi", "_llo", "_lhi")
    second = starts_in_left.drop("_at", "_lo", "_hi", "_llo", "_rlo", "_rhi")
    return first.unionByName(second)


def overlap_totals(left: DataFrame, left_range: Column, right: DataFrame, right_range: Column, keys: Sequence[str], totals: Totals, on: Sequence[str] = ()) -> DataFrame:
    """What an ``overlap_join`` grouped by ``keys`` of the right side gives (totals are of the left side), without making
    its pairs. A right range takes the totals of the left ones that begin in it, from its nodes, and of those that
    begin before its first number and hold it, from the nodes of that number."""
    one, two = _ranges_on_one_line(left, left_range, right, right_range)
    alike = one.groupBy(*on, "_llo", "_lhi").agg(*(own.alias(name) for name, (own, _) in totals.items()))
    alike = materialize(alike, "alike")
    begun = _total(alike.withColumnRenamed("_llo", "_at"), [*on, "_at"], totals)
    inside = _held_totals(begun, two.withColumnsRenamed({"_rlo": "_lo", "_rhi": "_hi"}), on, keys, totals)
    starts = materialize(two.select(*dict.fromkeys([*on, *keys]), F.col("_rlo").alias("_at")), "starts")
    before = alike.select(*on, *totals, (F.col("_llo") + 1).alias("_lo"), F.col("_lhi").alias("_hi")).filter("_lo <= _hi")
    held, levels, bits = _held(before, starts, alike.count())
    at_node = _total(held, [*on, "_k", "_i"], totals)
    across = _total(_at_levels(starts, levels, bits).join(at_node.hint("merge"), [*on, "_k", "_i"]), keys, totals)
    return _total(inside.unionByName(across), keys, totals)


BLOCK = 2048
Inequality = tuple[str, str, str]


def _blocks(df: DataFrame, columns: Sequence[str], block: int, side: str) -> DataFrame:
    """``df`` without nulls in the columns, with its block: runs of the first column's order, cut once more by the
    second column's."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    row = F.struct(*all_columns(df)).alias("_whole")
    keyed = df.select(row, *(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)), F.monotonically_increasing_id().alias("_id"))
    keyed = materialize(keyed, "unsorted")
    order = [F.col("_v0"), F.col("_id")]
    if len(set(columns)) == 1:
        placed = global_ordinal(keyed, order, "_n").withColumn("_block", F.expr(f"(_n - 1) div {block}"))
        return materialize(placed.drop("_n", "_id"), f"blocks-{side}")
    strips = global_ordinal(keyed, order, "_n").withColumn("_strip", F.expr(f"(_n - 1) div {16 * block}")).drop("_n")
    placed = numbered(strips, ["_strip"], [F.col("_v1"), F.col("_id")], "_n")
    return materialize(placed.withColumn("_block", F.expr(f"_strip * 16 + (_n - 1) div {block}")).drop("_strip", "_n", "_id"), f"blocks-{side}")


def inequality_join(left: DataFrame, right: DataFrame, inequalities: Sequence[Inequality], block: int = BLOCK) -> DataFrame:
    """Rows for which every inequality (left column, one of < <= > >=, right column) holds, as structs ``left`` and
    ``right``. Columns may be of any type with an order; null satisfies nothing."""
    if not inequalities or any(op not in ("<", "<=", ">", ">=") for _, op, _ in inequalities):
        raise ValueError("inequalities are < <= > >=")
    one = _blocks(left, [a for a, _, _ in inequalities], block, "left")
    two = _blocks(right, [b for _, _, b in inequalities], block, "right")
    number = range(len(inequalities))
    known = [
        df.groupBy("_block").agg(*(f(f"_v{i}").alias(f"_{name}{i}_{s}") for i in number for name, f in (("min", F.min), ("max", F.max)))).withColumnRenamed("_block", f"_{s}")
        for df, s in ((one, "a"), (two, "b"))
    ]
    known = [materialize(k, "bounds") for k in known]

    def ends(i: int, op: str) -> tuple[str, str]:
        """The bounds that decide whether two blocks may have a pair."""
        return (f"_min{i}_a", f"_max{i}_b") if op in ("<", "<=") else (f"_max{i}_a", f"_min{i}_b")

    op = inequalities[0][1]
    own, other = ends(0, op)
    values = known[0].select(F.col(own).alias("_v")).union(known[1].select(F.col(other).alias("_v"))).distinct()
    ranks = global_ordinal(values, [F.col("_v")], "_rank")
    at = known[1].join(ranks, F.col(other) == F.col("_v")).withColumn("_point", F.col("_rank")).drop("_v", "_rank")
    held = known[0].join(ranks, F.col(own) == F.col("_v")).drop("_v")
    none, rank = F.lit(None).cast("long"), F.col("_rank")
    lower, upper = (rank, none) if op in ("<", "<=") else (none, rank)
    bounds = "[]" if "=" in op else "()"
    pairs = range_join(at, F.col("_point"), held, lower, upper, bounds)
    possible = [F.expr(f"{a} {o} {b}") for i, (_, o, _) in enumerate(inequalities) for a, b in [ends(i, o)]]
    pairs = pairs.filter(reduce(lambda x, y: x & y, possible)).select("_a", "_b")
    met = pairs.join(one.select(F.col("_block").alias("_a"), F.col("_whole").alias("left"), *(F.col(f"_v{i}").alias(f"_l{i}") for i in number)), "_a")
    met = met.join(two.select(F.col("_block").alias("_b"), F.col("_whole").alias("right"), *(F.col(f"_v{i}").alias(f"_r{i}") for i in number)), "_b")
    return met.filter(reduce(lambda x, y: x & y, (F.expr(f"_l{i} {o} _r{i}") for i, (_, o, _) in enumerate(inequalities)))).select("left", "right")


def inequality_totals(left: DataFrame, right: DataFrame, inequalities: Sequence[Inequality], keys: Sequence[str], totals: Totals) -> DataFrame:
    """What an ``inequality_join`` of two inequalities grouped by ``keys`` of the right side gives (totals are of the left
    side), without making its pairs. The first inequality gives a right row the dyadic nodes of the left ranks it allows;
    in each node both sides are put in the second one's order, and a right row takes the totals of the rows before it."""
    if len(inequalities) != 2 or any(op not in ("<", "<=", ">", ">=") for _, op, _ in inequalities):
        raise ValueError("two inequalities of < <= > >=")
    (a0, op, b0), (a1, then, b1) = inequalities
    known = lambda df, *names: df.filter(reduce(lambda x, y: x & y, (F.col(quoted(c)).isNotNull() for c in names)))
    alike = known(left, a0, a1).groupBy(F.col(quoted(a0)).alias("_v0"), F.col(quoted(a1)).alias("_v1"))
    alike = materialize(alike.agg(*(own.alias(name) for name, (own, _) in totals.items()), F.count(F.lit(1)).alias("_pairs")), "alike")
    asked = known(right, b0, b1).select(F.col(quoted(b0)).alias("_v0"), F.col(quoted(b1)).alias("_v1"), F.struct(*map(quoted, keys)).alias("_keys"))
    asked = materialize(asked, "asked")
    ranks = global_ordinal(alike.select("_v0").union(asked.select("_v0")).distinct(), [F.col("_v0")], "_at").hint("merge")
    points = materialize(alike.join(ranks, "_v0").drop("_v0"), "points")
    none, at = F.lit(None).cast("long"), F.col("_at")
    lower, upper = (none, at) if op in ("<", "<=") else (at, none)
    placed = _placed(asked.join(ranks, "_v0").drop("_v0"), lower, upper, [T.LongType()] * 2, "[]" if "=" in op else "()").drop("_at")
    placed = materialize(placed, "intervals")
    held, levels, bits = _held(placed, points, placed.count())
    total = {**totals, "_pairs": (F.count(F.lit(1)), F.sum)}
    # Of equal values the points come first if they count.
    first = int("=" in then)
    both = _at_levels(points, levels, bits).drop("_at").withColumn("_turn", F.lit(1 - first))
    both = both.unionByName(held.drop("_lo", "_hi").withColumn("_turn", F.lit(first)), allowMissingColumns=True)
    order = [F.col("_v1").asc() if then in ("<", "<=") else F.col("_v1").desc(), F.col("_turn")]
    met = segment_totals(both, ["_k", "_i"], order, {name: combine for name, (_, combine) in total.items()}, F.col("_keys").isNotNull(), ["_keys"])
    out = _total(met, ["_keys"], total).filter("_pairs > 0")
    return out.select(*(F.col("_keys")[c].alias(c) for c in keys), *totals)
