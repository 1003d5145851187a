"""Deriving columns and routing rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import diff as D
from .ordering import global_ordinal
from .routing import MAXVALUE, MINVALUE, Partition, Partitioning, overlaps, portable_hash, route_partitions  # noqa: F401


def apply_defaults(df: DataFrame, defaults: Mapping[str, str | Column], presence: str | None = None) -> DataFrame:
    """Fill absent values: a column the frame lacks, or, with a ``presence`` map column (column -> given), a value
    that was not given. An explicit null stays null. A string is an SQL expression, a Column is used as it is."""
    out = df
    for name, default in defaults.items():
        value = F.expr(default) if isinstance(default, str) else default
        if name not in df.columns:
            out = out.withColumn(name, value)
        elif presence is not None:
            given = F.coalesce(F.col(presence)[name], F.lit(False))
            out = out.withColumn(name, F.when(given, F.col(name)).otherwise(value))
    return out


def generated_column(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """``df`` with a stored generated column; a frame that already carries it tries to write it and is refused."""
    if name in df.columns:
        raise ValueError(f"column {name} is generated and cannot be written")
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


@dataclass(frozen=True)
class Sequence_:
    start: int = 1
    increment: int = 1
    minimum: int = 1
    maximum: int = 2**63 - 1
    cycle: bool = False


def sequence_value(ordinal: Column, seq: Sequence_) -> Column:
    """The value of the 1-based draw. After the first pass from ``start``, a cycle restarts at the minimum (at the
    maximum if it descends); without a cycle a draw beyond the bound is null."""
    k, step = ordinal - 1, seq.increment
    up = step > 0
    first = ((seq.maximum - seq.start) if up else (seq.start - seq.minimum)) // abs(step) + 1
    value = F.lit(seq.start) + k * step
    if not seq.cycle:
        return F.when(k < first, value)
    again = (seq.maximum - seq.minimum) // abs(step) + 1
    base = seq.minimum if up else seq.maximum
    wrapped = F.lit(base) + F.pmod(k - first, F.lit(again)) * step
    return F.when(k < first, value).otherwise(wrapped)


def sequence_assign(df: DataFrame, order: list[Column], name: str, seq: Sequence_) -> DataFrame:
    """``df`` with the sequence's values in the given total order; null marks an overflow."""
    numbered = global_ordinal(df, order, "_ordinal")
    return numbered.withColumn(name, sequence_value(F.col("_ordinal"), seq)).drop("_ordinal")


def identity_column(df: DataFrame, name: str, order: list[Column], seq: Sequence_, always: bool = False) -> DataFrame:
    """``df`` with column ``name`` filled and ``identity_violation``. BY DEFAULT draws a value only for rows without
    one; ALWAYS draws for every row, and a given value is a violation."""
    given = F.col(name).isNotNull()
    if always:
        drawn = sequence_assign(df.withColumn("_given", given), order, "_drawn", seq)
        return drawn.withColumn(name, F.col("_drawn")).withColumn("identity_violation", F.col("_given")).drop("_drawn", "_given")
    drawn = sequence_assign(df.filter(~given), order, "_drawn", seq)
    filled = drawn.withColumn(name, F.col("_drawn")).drop("_drawn")
    return df.filter(given).unionByName(filled).withColumn("identity_violation", F.lit(False))


def conform(df: DataFrame, contract: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """(frame, extra columns): the contract's columns in its order and types; values that do not cast are null, missing
    columns are null."""
    columns = [
        (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in contract.items()
    ]
    return df.select(*columns), [c for c in df.columns if c not in contract]


def inheritance_scan(parent: tuple[str, DataFrame], children: Sequence[tuple[str, DataFrame]], only: bool = False) -> DataFrame:
    """The parent's columns over the parent and, unless ``only``, all its descendants, with ``origin``."""
    name, frame = parent
    out = frame.withColumn("origin", F.lit(name))
    for label, child in [] if only else children:
        out = out.unionByName(child.select(*frame.columns).withColumn("origin", F.lit(label)))
    return out


def pack(name: str, *columns: str) -> Column:
    return F.struct(*columns).alias(name)


def unpack(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != name), f"{name}.*")


# Range values: structs of lower, upper, lower_inc, upper_inc; a null bound is unbounded, a null struct no range.


def range_value(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    """A range; a lower bound above the upper one is refused."""
    refused = F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound"))
    return F.struct(
        F.when(lower > upper, refused).otherwise(lower).alias("lower"),
        upper.alias("upper"),
        F.lit(bounds[0] == "[").alias("lower_inc"),
        F.lit(bounds[1] == "]").alias("upper_inc"),
    )


def range_empty(r: Column) -> Column:
    """Whether no value is in the range; null for null."""
    touching = F.coalesce(r["lower"] == r["upper"], F.lit(False)) & ~(r["lower_inc"] & r["upper_inc"])
    return F.when(r.isNotNull(), touching)


def range_contains(r: Column, value: Column) -> Column:
    """Null for a null range or value; an empty range holds nothing."""
    above = r["lower"].isNull() | (value > r["lower"]) | (r["lower_inc"] & (value == r["lower"]))
    below = r["upper"].isNull() | (value < r["upper"]) | (r["upper_inc"] & (value == r["upper"]))
    return F.when(r.isNotNull() & value.isNotNull(), ~range_empty(r) & above & below)


def range_overlaps(a: Column, b: Column) -> Column:
    """Null for a null range; an empty range overlaps none."""

    def starts_before_end(x: Column, y: Column) -> Column:
        touching = (x["lower"] == y["upper"]) & x["lower_inc"] & y["upper_inc"]
        return x["lower"].isNull() | y["upper"].isNull() | (x["lower"] < y["upper"]) | touching

    met = ~range_empty(a) & ~range_empty(b) & starts_before_end(a, b) & starts_before_end(b, a)
    return F.when(a.isNotNull() & b.isNotNull(), met)


def range_length(r: Column) -> Column:
    """Upper minus lower bound; null where a bound is missing or the range is empty."""
    return F.when(~range_empty(r), r["upper"] - r["lower"])


def index_order(name: str, descending: bool = False, nulls: str | None = None) -> Column:
    """A sort key with PostgreSQL's default null placement: ascending puts nulls last, descending first."""
    first = (nulls or ("FIRST" if descending else "LAST")).upper() == "FIRST"
    c = F.col(name)
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def ordered_scan(df: DataFrame, order: Sequence[Column], covering: Sequence[str], limit: int | None = None) -> DataFrame:
    """The covering columns in index order; a limit keeps each task's best rows only."""
    out = df.orderBy(*order)
    return (out if limit is None else out.limit(limit)).select(*covering)


@dataclass(frozen=True)
class RowTrigger:
    """BEFORE ROW: on ``events`` (insert, update, delete), if a column of ``of`` changed (updates) and ``when`` holds,
    the columns in ``assign`` get new values. Expressions see the structs ``new`` and ``old``."""

    name: str
    events: tuple[str, ...]
    assign: Mapping[str, str]
    of: tuple[str, ...] = ()
    when: str = "true"


def change_events(diff: DataFrame) -> DataFrame:
    """The rows of a diff as changes: event, new, old; unchanged rows are no change."""
    event = F.when(F.col("change") == D.ADDED, "insert").when(F.col("change") == D.CHANGED, "update").when(F.col("change") == D.REMOVED, "delete")
    return diff.select("*", event.alias("event")).filter("event IS NOT NULL").withColumnsRenamed({"desired": "new", "actual": "old"})


def row_trigger(changes: DataFrame, trigger: RowTrigger) -> DataFrame:
    """``changes`` with ``new`` rewritten and ``fired``."""
    fires = F.col("event").isin(list(trigger.events)) & F.coalesce(F.expr(trigger.when), F.lit(False))
    if trigger.of:
        moved = F.lit(False)
        for c in trigger.of:
            moved = moved | ~F.col("new")[c].eqNullSafe(F.col("old")[c])
        fires = fires & ((F.col("event") != "update") | moved)
    kind = changes.schema["new"].dataType
    fields = []
    for f in kind.fields:
        own = F.col("new")[f.name]
        if f.name in trigger.assign:
            own = F.when(F.col("fired"), F.expr(trigger.assign[f.name]).cast(f.dataType)).otherwise(own)
        fields.append(own.alias(f.name))
    marked = changes.withColumn("fired", F.coalesce(fires, F.lit(False)))
    return marked.withColumn("new", F.when(F.col("new").isNotNull(), F.struct(*fields)))


def statement_trigger(changes: DataFrame) -> DataFrame:
    """One row per event kind of the batch."""
    return changes.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
