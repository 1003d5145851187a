"""Merging, stitching and resolving keyed records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize, quoted, scratch
from ..sources.keyed_table import BUCKETS, KeyedTable
from . import diff as D
from .scan import gathered_pieces, numbered


def merge_update(
    target: DataFrame, source: DataFrame, keys: Sequence[str], prune: bool = False, ignored: DataFrame | None = None
) -> DataFrame:
    """The target after writing new and changed source rows. Stale rows (not in the source) stay unless ``prune``;
    keys in ``ignored`` are neither written nor pruned."""
    return merged_states(target, source, keys, prune, ignored).filter("state <> 'pruned'").select("row.*")


def merged_states(
    target: DataFrame, source: DataFrame, keys: Sequence[str], prune: bool = False, ignored: DataFrame | None = None
) -> DataFrame:
    """(keys, state, row): state is written, kept, stale, pruned or ignored."""
    diff = D.snapshot_diff(source, target, keys)
    if ignored is not None:
        mark = ignored.select(*keys).distinct().withColumn("_ignored", F.lit(True))
        on = [diff[k].eqNullSafe(mark[k]) for k in keys]
        diff = diff.join(mark, on, "left").select(*(diff[c] for c in diff.columns), "_ignored")
    else:
        diff = diff.withColumn("_ignored", F.lit(False))
    left_alone = F.coalesce("_ignored", F.lit(False))
    state = (
        F.when(left_alone, "ignored")
        .when(F.col("change").isin(D.ADDED, D.CHANGED), "written")
        .when(F.col("change") == D.UNCHANGED, "kept")
        .otherwise("pruned" if prune else "stale")
    )
    row = F.when(left_alone | (F.col("change") == D.REMOVED), F.col("actual")).otherwise(F.col("desired"))
    out = diff.select(*keys, state.alias("state"), row.alias("row"))
    return out.filter("row IS NOT NULL")  # an ignored key that the target lacks is not written


def merge_counts(target: DataFrame, source: DataFrame, keys: Sequence[str], prune: bool = False) -> DataFrame:
    states = merged_states(target, source, keys, prune)
    return states.agg(
        F.count_if(F.col("state") == "written").alias("written"),
        F.count_if(F.col("state").isin("stale", "pruned")).alias("stale"),
        F.count_if(F.col("state") == "pruned").alias("pruned"),
    )


def staged_merge(
    path: str, source: DataFrame, keys: Sequence[str], prune: bool = False, buckets: int | None = None, ignored: DataFrame | None = None
) -> dict[str, int]:
    """Merge ``source`` into the keyed table that is stored at ``path`` (``sources.keyed_table``), and return the counts
    of written, kept, stale, pruned and ignored rows and of rewritten buckets, with the version that has the result.

    Only buckets with a written or pruned row are rewritten, so a second merge of the same source writes no version.
    Without ``prune`` only the buckets of the source's keys are read. A table that is not there yet is made, with
    ``buckets`` buckets; for a table that was made with another number, ``buckets`` deals it out anew first. Other key
    columns or other columns than the table's are refused, as are repeated keys in the source. Readers of a version are
    not disturbed; a writer that lost the race for the next version gets ``VersionConflict`` and may begin again.
    """
    spark = source.sparkSession
    stored = KeyedTable(spark, path)
    manifest = stored.manifest() if stored.exists() else stored.create(source.schema, keys, buckets or BUCKETS)
    columns = stored.schema(manifest).names
    if manifest["keys"] != list(keys) or sorted(columns) != sorted(source.columns):
        raise ValueError(f"the table has keys {manifest['keys']} and columns {columns}")
    if buckets and manifest["first_buckets"] != buckets:
        manifest = stored.rebucket(buckets)
    with scratch(spark):
        source = source.select(*(F.col(f"`{c}`") for c in columns))
        wanted = set(manifest["buckets"])
        if not prune:
            source = materialize(source, "merge-source")
            wanted = {r["_b"] for r in source.select(stored.bucket(manifest).alias("_b")).distinct().collect()}  # a row a bucket
        target = stored.read(manifest=manifest, buckets=wanted)
        states = merged_states(target, source, keys, prune, ignored).select("state", "row.*")
        states = materialize(states.withColumn("_bucket", stored.bucket(manifest)), "merge")
        told = states.groupBy("_bucket", "state").agg(F.count(F.lit(1)).alias("n")).collect()  # a few rows a bucket
        counts = dict.fromkeys(("written", "kept", "stale", "pruned", "ignored"), 0)
        for r in told:
            counts[r["state"]] += r["n"]
        counts["stale"] += sum(b["rows"] for name, b in manifest["buckets"].items() if name not in wanted)
        touched = {r["_bucket"] for r in told if r["state"] in ("written", "pruned")}
        if touched:
            rows = states.filter(F.col("state") != "pruned")
            if len(touched) < len({r["_bucket"] for r in told}):  # else every row lies in a touched bucket
                rows = rows.filter(F.col("_bucket").isin(sorted(touched)))
            rows = rows.drop("state", "_bucket")
            manifest = stored.rewrite(manifest, rows, touched)
    return {"rewritten": len(touched), **counts, "version": manifest["version"]}


def overlay_last_non_null(base: DataFrame, patches: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: each field is the last non-null one by ``order``, the base coming first. Keys that only the
    patches have are inserted. ``max_by`` over the non-null values combines before the shuffle."""
    fields = [c for c in base.columns if c not in keys]
    missing = [c for c in fields if c not in patches.columns]
    later = patches.select(*keys, *(c for c in fields if c not in missing), F.struct(F.lit(1).alias("f"), F.col(order).alias("o")).alias("_o"))
    for c in missing:
        later = later.withColumn(c, F.lit(None).cast(base.schema[c].dataType))
    kind = patches.schema[order].dataType
    first = base.select(*keys, *fields, F.struct(F.lit(0).alias("f"), F.lit(None).cast(kind).alias("o")).alias("_o"))
    rows = first.unionByName(later)
    # A null ordering key is not considered, which leaves out exactly the rows that do not carry the field.
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in fields]
    return rows.groupBy(*keys).agg(*last)


#: Rows of one key that may be gathered in one array.
GATHERED = 1_000_000


def bounded(df: DataFrame, keys: Sequence[str], limit: int = GATHERED) -> DataFrame:
    """``df``, which fails where a key has more than ``limit`` rows. The count is a window over the keys, which spills,
    so it fails before anything is gathered; a following ``groupBy`` of the keys needs no other shuffle."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*(F.col(quoted(k)) for k in keys)))
    refused = F.raise_error(F.concat(F.lit("a key has "), F.col("_n"), F.lit(f" rows, more than {limit}: gather them in pieces")))
    # The filter is not known to be true, so it is not left out.
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > limit, refused.cast("boolean")).otherwise(True)).drop("_n")


def children_pieces(parents: DataFrame, children: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, size: int = 10_000) -> DataFrame:
    """Parents with ``piece`` (from 1) and an ordered array of at most ``size`` children: a row for each piece, one with
    an empty array for a parent without children. No task holds more than a piece of a parent's children."""
    rest = [c for c in children.columns if c not in keys and c not in order]
    values = [F.col(quoted(c)) for c in (*order, *rest)]
    nested = gathered_pieces(children.dropna(subset=list(keys)), keys, values[: len(order)], values, name, size, ties=values[len(order) :])
    joined = parents.join(nested, list(keys), "left")
    none = F.array().cast(nested.schema[name].dataType)
    return joined.withColumns({"piece": F.coalesce("piece", F.lit(1)), name: F.coalesce(quoted(name), none)})


def attach_children(parents: DataFrame, children: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children (empty if none). A parent with more than ``GATHERED`` children is
    refused; ``children_pieces`` takes any number."""
    rest = [c for c in children.columns if c not in keys and c not in order]
    matching = children.dropna(subset=list(keys))  # no parent has a null key, which may stand often
    nested = bounded(matching, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    joined = parents.join(nested, list(keys), "left")
    kind = nested.schema[name].dataType
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def orphans(parents: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    return children.join(parents.select(*keys), list(keys), "left_anti")


def resolve_first_of(children: DataFrame, key: str, parents: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """``children`` with ``resolved_from``, the first of the named parents that has the key; null if none has.
    ``parents``: (name, table, key column) in order of priority."""
    out = children
    names = []
    for i, (label, parent, column) in enumerate(parents):
        mark = parent.select(F.col(column).alias(f"_k{i}")).distinct().withColumn(f"_in{i}", F.lit(label))
        out = out.join(mark, out[key] == mark[f"_k{i}"], "left").drop(f"_k{i}")
        names.append(f"_in{i}")
    return out.withColumn("resolved_from", F.coalesce(*names)).drop(*names)


def resolve_exact_else_unambiguous(refs: DataFrame, objects: DataFrame, full: str, base: str, id_: str) -> DataFrame:
    """``refs`` with ``resolved``: the object with the same full name, else the only one with the same base name."""
    exact = objects.groupBy(F.col(full).alias("_full")).agg(F.min(id_).alias("_exact"))
    only = objects.groupBy(F.col(base).alias("_base")).agg(F.min(id_).alias("_only"), F.count(F.lit(1)).alias("_n"))
    only = only.filter("_n = 1").drop("_n")
    joined = refs.join(exact, refs[full] == exact["_full"], "left").join(only, refs[base] == only["_base"], "left")
    return joined.withColumn("resolved", F.coalesce("_exact", "_only")).drop("_full", "_base", "_exact", "_only")


def group_nested(rows: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str], name: str) -> DataFrame:
    """One record per key with its rows' values as an array in arrival order. A key with more than ``GATHERED`` rows is
    refused; ``scan.gathered_pieces`` takes any number."""
    listed = F.array_sort(F.collect_list(F.struct(seq, *values)))
    pick = (lambda x: x[values[0]]) if len(values) == 1 else (lambda x: F.struct(*(x[v].alias(v) for v in values)))
    return bounded(rows, keys).groupBy(*keys).agg(F.transform(listed, pick).alias(name))


def inject_defaults(df: DataFrame, container: DataFrame, on: Column, columns: Sequence[str], fallback: Mapping[str, Column], presence: str | None = None) -> DataFrame:
    """Fill absent values from the container's column of the same name, then from the global ``fallback``; explicit
    values win. The container is joined on its key, at most one row each. With ``presence``, a map column (column ->
    given), an explicit null is a value and stays; without it null counts as absent."""
    box = container.select(*(F.col(c).alias(f"_c_{c}") for c in container.columns))
    joined = df.join(box, on, "left")
    for c in columns:
        own = [F.col(c)] + ([F.col(f"_c_{c}")] if c in container.columns else []) + ([fallback[c]] if c in fallback else [])
        value = F.coalesce(*own)
        if presence is not None:
            value = F.when(F.coalesce(F.col(presence)[c], F.lit(False)), F.col(c)).otherwise(value)
        joined = joined.withColumn(c, value)
    return joined.select(*df.columns)


def round_trip(text: Column, schema: str, allowed: Sequence[str]) -> Column:
    """The JSON document reprinted through ``schema`` without nulls, or null if it is malformed, holds a key that is
    not ``allowed`` or a key twice, or holds a value that the schema's type cannot carry."""
    own = F.try_parse_json(text).try_cast("map<string,variant>")
    known = F.forall(F.map_keys(own), lambda k: k.isin(list(allowed)))
    parsed = F.from_json(text, schema)
    lost = F.lit(False)
    for k in allowed:
        lost = lost | (own[k].isNotNull() & ~F.is_variant_null(own[k]) & parsed[k].isNull())
    return F.when(own.isNotNull() & known & ~lost, F.to_json(parsed))


def redact(options: Column, secrets: Sequence[str]) -> Column:
    """The option map without secrets; null if nothing is left."""
    kept = F.map_filter(options, lambda k, _: ~k.isin(list(secrets)))
    return F.when(F.size(kept) > 0, kept)


def number_duplicates(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``unique_name``: the first of equal names keeps it, later ones get _1, _2, ..., leaving out numbers
    that a literal name already has.

    The n-th repeat takes the n-th number that is free. With the taken numbers in order, the j-th one, t, has t - j free
    ones below; so where repeats and taken numbers are merged by n and t - j, a repeat's place in the merged order is
    its number. All three numberings come from range sorts that split a name with many rows.
    """
    ranked = numbered(df, [name], [F.col(c) for c in order], "_n")
    pattern = r"^(.*)_([1-9][0-9]{0,8})$"
    literal = df.select(F.regexp_extract(name, pattern, 1).alias("_base"), F.regexp_extract(name, pattern, 2).try_cast("long").alias("_t"))
    repeated = ranked.filter("_n = 2").select(F.col(name).alias("_base"))
    taken = literal.filter("_t IS NOT NULL").distinct().join(repeated, "_base", "left_semi")
    taken = numbered(taken, ["_base"], [F.col("_t")], "_j")
    repeats = ranked.filter("_n > 1").select(F.col(name).alias("_base"), (F.col("_n") - 1).alias("_at"), F.lit(0).alias("_kind"), F.col("_n").alias("_tie"))
    merged = repeats.unionByName(taken.select("_base", (F.col("_t") - F.col("_j")).alias("_at"), F.lit(1).alias("_kind"), F.col("_j").alias("_tie")))
    places = numbered(merged, ["_base"], [F.col("_at"), F.col("_kind"), F.col("_tie")], "_k").filter("_kind = 0")
    places = places.select(F.col("_base").alias("_name"), F.col("_tie").alias("_number"), "_k")
    joined = ranked.join(places, ranked[name].eqNullSafe(places["_name"]) & (ranked["_n"] == places["_number"]), "left")
    unique = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("_k").cast("string")))
    return joined.withColumn("unique_name", unique).drop("_n", "_k", "_name", "_number")


def glob_to_regex(pattern: str) -> str:
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def pattern_exclude(df: DataFrame, column: str, patterns: Sequence[str], listed: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows whose column matches none of the glob patterns and whose key is not listed."""
    out = df
    for p in patterns:
        out = out.filter(~F.coalesce(F.col(column).rlike(glob_to_regex(p)), F.lit(False)))
    return out.join(listed.select(key).distinct(), key, "left_anti") if listed is not None else out


def quarantine(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose JSON parses, with ``parsed``; the others with ``reason``."""
    full = f"{schema}, _corrupt_record STRING"
    tried = df.withColumn("parsed", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("parsed._corrupt_record").isNotNull()
    missing = F.col(column).isNull()
    good = tried.filter(~broken & ~missing).withColumn("parsed", F.col("parsed").dropFields("_corrupt_record"))
    bad = tried.filter(broken | missing).withColumn("reason", F.when(missing, "missing").otherwise("malformed")).drop("parsed")
    return good, bad
