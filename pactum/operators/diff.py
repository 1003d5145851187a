"""Keyed snapshot comparison: classify, explain and order the differences of two snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED, CHANGED, UNCHANGED, REMOVED, SKIPPED = "Added", "Changed", "Unchanged", "Removed", "Skipped"


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; a diff is only defined where this is empty on both sides."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def same(a: Column, b: Column, is_map: bool = False) -> Column:
    """Null-safe equality; maps are compared without regard to the order of their entries."""
    if is_map:
        a, b = F.array_sort(F.map_entries(a)), F.array_sort(F.map_entries(b))
    return a.eqNullSafe(b)


def compared_columns(df: DataFrame, keys: Sequence[str], ignore: Iterable[str] = ()) -> list[str]:
    skip = {*keys, *ignore}
    return [c for c in df.columns if c not in skip]


def snapshot_diff(
    desired: DataFrame,
    actual: DataFrame,
    keys: Sequence[str],
    ignore: Iterable[str] = (),
    skip: Column | None = None,
    checked: bool | None = None,
) -> DataFrame:
    """Keys, ``change``, and both rows as structs ``desired`` and ``actual``.

    The sides meet in one full outer join on null-safe keys; presence is told by a marker, never by null data.
    ``ignore`` names columns that are not compared. ``skip`` is a predicate over the key columns: rows outside
    management are reported as Skipped.

    A diff is not defined where a side repeats a key. Such a row raises once ``change`` is worked out: the rows of a
    key are counted where the join has brought them together, without a shuffle or a job of its own. ``checked=True``
    refuses the sides before, in a job for each; ``checked=False`` leaves the check out.
    """
    if checked:
        for name, df in (("desired", desired), ("actual", actual)):
            if not duplicate_keys(df, keys).isEmpty():
                raise ValueError(f"the {name} snapshot repeats a key")
    kinds = dict(desired.dtypes)
    # One column for the whole key: its nulls are equal, and the join and the count are dealt out alike.
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    sides = []
    for df, side, name in ((desired, "d", "desired"), (actual, "a", "actual")):
        own = df.select(key.alias(f"_{side}_key"), F.lit(True).alias(f"_{side}"), F.struct(*desired.columns).alias(name))
        if checked is None:
            own = own.withColumn(f"_{side}_n", F.count(F.lit(1)).over(Window.partitionBy(f"_{side}_key")))
        sides.append(own)
    equal = F.lit(True)
    for c in compared_columns(desired, keys, ignore):
        equal = equal & same(F.col("desired")[c], F.col("actual")[c], kinds[c].startswith("map"))
    change = (
        F.when(F.col("_a").isNull(), ADDED).when(F.col("_d").isNull(), REMOVED).when(equal, UNCHANGED).otherwise(CHANGED)
    )
    if checked is None:
        for side, name in (("d", "desired"), ("a", "actual")):
            change = F.when(F.col(f"_{side}_n") > 1, F.raise_error(F.lit(f"the {name} snapshot repeats a key"))).otherwise(change)
    joined = sides[0].join(sides[1], F.col("_d_key") == F.col("_a_key"), "full_outer")
    either = F.coalesce("_d_key", "_a_key")
    merged = joined.select(*(either[f"k{i}"].alias(k) for i, k in enumerate(keys)), change.alias("change"), "desired", "actual")
    if skip is not None:
        merged = merged.withColumn("change", F.when(skip, SKIPPED).otherwise(F.col("change")))
    return merged


def diff_summary(diff: DataFrame, *by: str, totals: bool = False) -> DataFrame:
    """Rows of each class within ``by``; classes without rows do not appear. With ``totals`` also of each class in all
    and of all rows, from the same aggregate: ``summed`` names the columns that a row is summed over (null there)."""
    count = F.count(F.lit(1)).alias("n")
    if not totals:
        return diff.groupBy("change", *by).agg(count)
    names = ("change", *by)
    over = F.concat_ws(",", *(F.when(F.grouping(c) == 1, F.lit(c)) for c in names)).alias("summed")
    return diff.rollup(*names).agg(count, over)


# Type names that mean the same, as PostgreSQL defines them.
TYPE_ALIASES = {
    "bool": "boolean",
    "char": "character",
    "decimal": "numeric",
    "float4": "real",
    "float8": "double precision",
    "int": "integer",
    "int2": "smallint",
    "int4": "integer",
    "int8": "bigint",
    "timestamptz": "timestamp with time zone",
    "timetz": "time with time zone",
    "varchar": "character varying",
}


def canonical_type(name: Column) -> Column:
    """A type name with its alias resolved; one ``[]`` and a ``(...)`` modifier are kept."""
    text = F.rtrim(name)
    is_array = text.endswith("[]")
    body = F.rtrim(F.regexp_replace(text, r"\[\]$", ""))
    base = F.rtrim(F.regexp_extract(body, r"^[^(]*", 0))
    modifier = F.regexp_extract(body, r"\(.*$", 0)
    aliases = F.create_map(*(F.lit(x) for pair in TYPE_ALIASES.items() for x in pair))
    return F.concat(F.coalesce(aliases[base], base), modifier, F.when(is_array, "[]").otherwise(""))


def normalized(value: Column, kind, ignore: Iterable[str] = (), canonical: Iterable[str] = ()) -> Column:
    """``value`` of Spark type ``kind`` without the fields named in ``ignore``, at any depth, with the string fields
    named in ``canonical`` as canonical types and maps as sorted entries, ready for null-safe comparison."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in ignore]
        if not kept:
            return F.lit(True)
        fields = []
        for f in kept:
            own = value[f.name]
            if f.name in canonical and isinstance(f.dataType, T.StringType):
                own = canonical_type(own)
            else:
                own = normalized(own, f.dataType, ignore, canonical)
            fields.append(own.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalized(x, kind.elementType, ignore, canonical))
    if isinstance(kind, T.MapType):
        return F.array_sort(
            F.transform(
                F.map_entries(value),
                lambda e: F.struct(e["key"].alias("key"), normalized(e["value"], kind.valueType, ignore, canonical).alias("value")),
            )
        )
    return value


def normalized_equal(a: Column, b: Column, kind, ignore: Iterable[str] = (), canonical: Iterable[str] = ()) -> Column:
    return normalized(a, kind, ignore, canonical).eqNullSafe(normalized(b, kind, ignore, canonical))


def identity_key(kind: Column, schema: Column, name: Column, args: Column | None = None, schemaless: Iterable[str] = ()) -> Column:
    """Struct (kind, schema, name). With ``args`` (array of mode, name, type) the name becomes its identity signature:
    arguments that only go out are left out, mode IN is silent, types are canonical. The schema of a ``schemaless``
    kind is blank."""
    if args is not None:
        inward = F.filter(args, lambda a: ~F.coalesce(a["mode"], F.lit("IN")).isin("OUT", "TABLE"))
        shown = F.transform(
            inward,
            lambda a: F.concat_ws(
                " ", F.when(a["mode"] != "IN", a["mode"]), a["name"], canonical_type(a["type"])
            ),
        )
        name = F.concat(name, F.lit("("), F.array_join(shown, ", "), F.lit(")"))
    blank = F.when(kind.isin(list(schemaless)), F.lit("")).otherwise(F.coalesce(schema, F.lit("")))
    return F.struct(kind.alias("kind"), blank.alias("schema"), name.alias("name"))


def changed_fields(diff: DataFrame, keys: Sequence[str], ignore: Iterable[str] = ()) -> DataFrame:
    """One row for each field that differs in a Changed row: keys, field, old_value, new_value (as text)."""
    fields = [f for f in diff.schema["desired"].dataType.fields if f.name not in {*keys, *ignore}]
    entries = [
        F.when(
            ~same(F.col("desired")[f.name], F.col("actual")[f.name], f.dataType.typeName() == "map"),
            F.struct(
                F.lit(f.name).alias("field"),
                F.col("actual")[f.name].cast("string").alias("old_value"),
                F.col("desired")[f.name].cast("string").alias("new_value"),
            ),
        )
        for f in fields
    ]
    changed = diff.filter(F.col("change") == CHANGED)
    return changed.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("_f")).select(*keys, "_f.*")


def options_delta(new: Column, old: Column) -> Column:
    """Array of (action, key, value): ADD for new keys, SET for changed ones, DROP for gone ones, sorted by key.
    Null maps count as empty."""
    empty = F.expr("CAST(map() AS map<string,string>)")
    both = F.map_zip_with(
        F.coalesce(new, empty),
        F.coalesce(old, empty),
        lambda k, n, o: F.struct(
            F.when(F.map_contains_key(F.coalesce(old, empty), k), F.when(F.map_contains_key(F.coalesce(new, empty), k), F.when(~n.eqNullSafe(o), "SET")).otherwise("DROP"))
            .otherwise("ADD")
            .alias("action"),
            n.alias("value"),
        ),
    )
    entries = F.filter(F.map_entries(both), lambda e: e["value"]["action"].isNotNull())
    return F.array_sort(
        F.transform(
            entries,
            lambda e: F.struct(e["key"].alias("key"), e["value"]["action"].alias("action"), e["value"]["value"].alias("value")),
        )
    )


def keep_redacted(old: Column, new: Column, secret: str = "password") -> Column:
    """``old`` without the secret where ``new`` does not carry it, so that a redacted option is never dropped."""
    empty = F.expr("CAST(map() AS map<string,string>)")
    hidden = ~F.map_contains_key(F.coalesce(new, empty), secret)
    return F.when(hidden, F.map_filter(old, lambda k, _: k != secret)).otherwise(old)


def child_reconcile(desired: DataFrame, actual: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """(parent, name, action): DROP what is gone or changed, then ADD what is missing or changed."""
    diff = snapshot_diff(desired, actual, [*parent, name]).filter(F.col("change") != UNCHANGED)
    actions = (
        F.when(F.col("change") == ADDED, F.array(F.lit("ADD")))
        .when(F.col("change") == REMOVED, F.array(F.lit("DROP")))
        .otherwise(F.array(F.lit("DROP"), F.lit("ADD")))
    )
    return diff.select(*parent, name, F.explode(actions).alias("action"))


def existence_key(tag: Column) -> Column:
    """The coarse key: text before the first parenthesis; overloads share it."""
    return F.rtrim(F.substring_index(tag, "(", 1))


def existence_check(desired: DataFrame, actual: DataFrame, tag: str) -> DataFrame:
    """``desired`` with ``coarse_key`` and ``change``: Undiffable if the key exists in ``actual``, else Added."""
    there = actual.select(existence_key(F.col(tag)).alias("coarse_key")).distinct().withColumn("_there", F.lit(True))
    keyed = desired.withColumn("coarse_key", existence_key(F.col(tag)))
    return (
        keyed.join(there, "coarse_key", "left")
        .withColumn("change", F.when(F.col("_there"), "Undiffable").otherwise(ADDED))
        .drop("_there")
    )


def append_only_compatible(new: Column, old: Column) -> Column:
    """Whether ``old`` is an unchanged start of ``new``; an unknown (null) side is compatible."""
    starts = (F.size(new) >= F.size(old)) & F.slice(new, F.lit(1), F.size(old)).eqNullSafe(old)
    return F.when(new.isNull() | old.isNull(), F.lit(True)).when(F.size(old) == 0, F.lit(True)).otherwise(starts)


def appended_tail(new: Column, old: Column) -> Column:
    return F.slice(new, F.size(old) + 1, F.greatest(F.size(new) - F.size(old), F.lit(0)))


def shared_order_preserved(new: Column, old: Column) -> Column:
    """Whether the members of both arrays come in the same relative order."""
    return F.array_intersect(new, old) == F.array_intersect(old, new)


RESOLUTIONS = ("in_place", "or_replace", "rebuild")


def classify_resolution(changes: DataFrame, rules: DataFrame, keys: Sequence[str], default: str = "rebuild") -> DataFrame:
    """(keys, resolution): the severest resolution of a key's changed fields. ``rules``: (field, resolution), a small
    table of the contract; a field without a rule gets ``default``."""
    severity = F.array_position(F.array(*map(F.lit, RESOLUTIONS)), F.coalesce("resolution", F.lit(default)))
    ranked = changes.join(rules, "field", "left").withColumn("_s", severity)
    worst = ranked.groupBy(*keys).agg(F.max("_s").alias("_s"))
    return worst.select(*keys, F.element_at(F.array(*map(F.lit, RESOLUTIONS)), F.col("_s").cast("int")).alias("resolution"))


def destructive_gate(plan: DataFrame, destructive: Column, allow: bool) -> tuple[DataFrame, DataFrame]:
    """(included, excluded): destructive rows are held back unless allowed."""
    held = F.coalesce(destructive, F.lit(False)) & F.lit(not allow)
    return plan.filter(~held), plan.filter(held)


def gate_counts(plan: DataFrame, destructive: Column, allow: bool) -> DataFrame:
    held = F.coalesce(destructive, F.lit(False))
    return plan.agg(
        F.count_if(~held | F.lit(allow)).alias("included"),
        F.count_if(held & F.lit(not allow)).alias("excluded"),
        F.count_if(held & F.lit(allow)).alias("included_destructive"),
        (F.count_if(held & F.lit(not allow)) == 0).alias("may_apply"),
    )


def plan_phases(diff: DataFrame, desired_ordinal: Column, actual_ordinal: Column) -> DataFrame:
    """``diff`` without unchanged rows, with (phase, rank): removals by descending actual ordinal, removals without an
    ordinal next, then additions and changes by desired ordinal. The total order is (phase, rank, key)."""
    gone = F.col("change") == REMOVED
    phase = F.when(gone & actual_ordinal.isNotNull(), 0).when(gone, 1).otherwise(2)
    rank = F.when(phase == 0, -actual_ordinal).when(phase == 2, desired_ordinal).otherwise(F.lit(0))
    kept = diff.filter(F.col("change").isin(ADDED, CHANGED, REMOVED))
    return kept.withColumn("phase", phase).withColumn("rank", F.coalesce(rank.cast("long"), F.lit(0)))


def converges(desired: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (differences): rows that still differ once the diff of the two has been applied; 0 if it converges."""
    from .merge import merge_update

    applied = merge_update(actual, desired, keys, prune=True)
    again = snapshot_diff(desired, applied, keys)
    return again.agg(F.count_if(F.col("change") != UNCHANGED).alias("differences"))
