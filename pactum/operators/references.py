"""What a statement that deletes rows does to all tables that reference them, along branches and cycles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .views import recursive_view

ACTIONS = ("NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT")


@dataclass(frozen=True)
class Table:
    """``key`` is what others reference; a table that none references needs none."""

    rows: DataFrame
    key: str | None = None


@dataclass(frozen=True)
class Link:
    """``child.column`` holds keys of ``parent``, which may be the child itself."""

    child: str
    column: str
    parent: str
    on_delete: str = "NO ACTION"
    default: Any = None
    nullable: bool = True


def _levels(links: Sequence[Link], names: Sequence[str]) -> list[tuple[list[str], bool]]:
    """The tables in the order in which deletes reach them, those of one cycle together, and whether they are one."""
    above = {n: {x.parent for x in links if x.child == n and x.on_delete == "CASCADE"} for n in names}
    while any(not above[p] <= above[n] for n in names for p in above[n]):
        above = {n: reduce(set.union, (above[p] for p in above[n]), above[n]) for n in names}
    out: list[tuple[list[str], bool]] = []
    for n in sorted(names, key=lambda n: (len(above[n]), n)):
        if not any(n in group for group, _ in out):
            circle = [m for m in names if m in above[n] and n in above[m]]
            out.append((circle or [n], bool(circle)))
    return out


def propagate_deletes(tables: Mapping[str, Table], links: Sequence[Link], deleted: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """For each table its rows after the keys in ``deleted`` (table -> one column) went, with ``outcome``: kept, deleted,
    updated (a reference was set to null or its default) or violation. Deleted rows keep their values.

    A table may have several children, several parents and several references to one parent, and may reference itself,
    directly or through others. NO ACTION is met if the referencing row goes in the same statement; RESTRICT is not.
    A default that is no key that stays in the parent is a violation, as is null where the column is not nullable. A
    null reference refers to nothing; null keys are ignored; repeated keys count once.

    Tables without a cycle take one join for each reference. A cycle is followed by ``recursive_view`` over its edges,
    a round for each step of the longest way, each with the plan of one join. Only table names are handled on the driver.
    """
    for x in links:
        if x.on_delete not in ACTIONS:
            raise ValueError(f"ON DELETE {x.on_delete} is not defined")
        if tables[x.parent].key is None:
            raise ValueError(f"{x.parent} is referenced and has no key")
    for name in deleted:
        if tables[name].key is None:
            raise ValueError(f"rows of {name} cannot be deleted by key")
    gone: dict[str, DataFrame] = {}  # _gone, the keys that go, of each table that is referenced or deleted from
    for group, circular in _levels(links, list(tables)):
        cascades = [x for x in links if x.child in group and x.on_delete == "CASCADE" and tables[x.child].key]
        seeds = {n: _seed(n, tables, [x for x in cascades if x.child == n and x.parent in gone], gone, deleted) for n in group}
        if circular:
            gone |= _followed(tables, [x for x in cascades if x.parent in group], {n: s for n, s in seeds.items() if s is not None})
        else:
            gone |= {n: materialize(s.distinct(), "gone") for n, s in seeds.items() if s is not None}
    return {n: _report(n, t, [x for x in links if x.child == n], tables, gone, deleted) for n, t in tables.items()}


def _seed(name: str, tables: Mapping[str, Table], cascades: Sequence[Link], gone: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame]) -> DataFrame | None:
    """The table's keys that go by the statement itself or with parents that are already known."""
    own = tables[name]
    parts = []
    if own.key is not None:
        kind = own.rows.schema[own.key].dataType
        if name in deleted:
            parts.append(deleted[name].toDF("_gone").select(F.col("_gone").cast(kind)))
        for x in cascades:
            lost = own.rows.select(F.col(own.key).alias("_key"), F.col(x.column).alias("_ref"))
            lost = lost.join(gone[x.parent], F.col("_ref") == F.col("_gone"), "left_semi")
            parts.append(lost.select(F.col("_key").alias("_gone")))
    return reduce(DataFrame.unionByName, parts).filter("_gone IS NOT NULL") if parts else None


def _followed(tables: Mapping[str, Table], cascades: Sequence[Link], seeds: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The keys that go along a cycle of tables, which are told apart by name; keys travel as text."""
    if not seeds:
        return {}
    edges = [
        tables[x.child].rows.select(
            F.lit(x.parent).alias("_from_table"),
            F.col(x.column).cast("string").alias("_from"),
            F.lit(x.child).alias("table"),
            F.col(tables[x.child].key).cast("string").alias("key"),
        )
        for x in cascades
    ]
    edges = materialize(reduce(DataFrame.unionByName, edges).filter("_from IS NOT NULL AND key IS NOT NULL"), "edges")
    first = [s.select(F.lit(n).alias("table"), F.col("_gone").cast("string").alias("key")) for n, s in seeds.items()]

    def step(fresh: DataFrame) -> DataFrame:
        met = fresh.select(F.col("table").alias("_from_table"), F.col("key").alias("_from"))
        return met.join(edges, ["_from_table", "_from"]).select("table", "key")

    found = materialize(recursive_view(reduce(DataFrame.unionByName, first), step), "gone")
    kinds = {x.child: tables[x.child] for x in cascades}
    return {
        n: found.filter(F.col("table") == n).select(F.col("key").cast(t.rows.schema[t.key].dataType).alias("_gone"))
        for n, t in kinds.items()
    }


def _report(name: str, own: Table, links: Sequence[Link], tables: Mapping[str, Table], gone: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame]) -> DataFrame:
    rows = own.rows
    no = F.lit(False)
    goes = restricted = broken = changed = no
    values: dict[str, Column] = {}

    def marked(keys: DataFrame, column: Column, label: str) -> DataFrame:
        there = keys.select(F.col("_gone").alias(label))
        return rows.join(there, column == F.col(label), "left")

    if name in deleted:
        rows = marked(gone[name], F.col(own.key), "_own")
        goes = F.col("_own").isNotNull()
    for i, x in enumerate(links):
        if x.parent not in gone:
            continue
        rows = marked(gone[x.parent], F.col(x.column), f"_lost{i}")
        lost = F.col(f"_lost{i}").isNotNull()
        if x.on_delete == "CASCADE":
            goes = goes | lost
        elif x.on_delete == "RESTRICT":
            restricted = restricted | lost
        elif x.on_delete == "NO ACTION":
            broken = broken | lost
        else:
            kind = own.rows.schema[x.column].dataType
            value = F.lit(x.default if x.on_delete == "SET DEFAULT" else None).cast(kind)
            if x.on_delete == "SET DEFAULT" and x.default is not None:
                parent = tables[x.parent]
                stays = parent.rows.select(F.col(parent.key).alias("_stays")).filter(F.col("_stays") == F.lit(x.default)).distinct()
                stays = stays.join(gone[x.parent], F.col("_stays") == F.col("_gone"), "left_anti").limit(1)  # one key
                rows = rows.join(F.broadcast(stays.select(F.lit(True).alias(f"_stays{i}"))), F.lit(True), "left")
                broken = broken | lost & F.col(f"_stays{i}").isNull()
            elif not x.nullable:
                broken = broken | lost
            changed = changed | lost
            values[x.column] = F.when(lost, value).otherwise(values.get(x.column, F.col(x.column)))
    outcome = (
        F.when(restricted, "violation").when(goes, "deleted").when(broken, "violation").when(changed, "updated").otherwise("kept")
    )
    applied = outcome == "updated"
    return rows.select(
        *(F.when(applied, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in own.rows.columns),
        outcome.alias("outcome"),
    )
