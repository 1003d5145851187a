"""Partition routing by a search in sorted bounds.

The partitions of a table are one constant array, sorted by their lower bounds (RANGE) or values (LIST), or laid out by
remainder (HASH); a row finds its place by binary search, so 10,000 partitions cost 14 comparisons and the plan holds
one literal. A key may have several columns, compared in order, and a partition may be partitioned again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _End:
    def __init__(self, side: int):
        self.side = side

    def __repr__(self) -> str:
        return "MINVALUE" if self.side < 0 else "MAXVALUE"


MINVALUE, MAXVALUE = _End(-1), _End(1)


def portable_hash(*keys: Column) -> Column:
    """The first 60 bits of the MD5 of the keys as text: the same number on every engine. Null counts as no text."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Partition:
    """LIST: ``values``. RANGE: ``lower`` (inclusive) and ``upper`` (exclusive), a tuple for several key columns, None
    for unbounded; ``MINVALUE`` and ``MAXVALUE`` may stand for a column. HASH: ``modulus`` and ``remainder``. ``parts``
    partitions it again."""

    name: str
    values: tuple = ()
    lower: object = None
    upper: object = None
    modulus: int | None = None
    remainder: int = 0
    parts: Partitioning | None = None

    def bound(self, side: str, width: int) -> tuple:
        given = getattr(self, side)
        if given is None:
            return (MINVALUE if side == "lower" else MAXVALUE,) * width
        given = given if isinstance(given, tuple) else (given,)
        if len(given) != width:
            raise ValueError(f"partition {self.name} has {len(given)} bounds for {width} key columns")
        return given


@dataclass(frozen=True)
class Partitioning:
    """How a table is partitioned: kind (LIST, RANGE, HASH), key columns, partitions and the default one's name."""

    kind: str
    keys: tuple[str, ...]
    partitions: tuple[Partition, ...] = field(default_factory=tuple)
    default: str | None = None


def _order(bound: tuple) -> tuple:
    """A bound in the order of rows: MINVALUE before and MAXVALUE after all values."""
    return tuple((v.side, 0) if isinstance(v, _End) else (0, v) for v in bound)


def overlaps(partitions: Sequence[Partition], kind: str) -> list[tuple[str, str]]:
    """Pairs of partitions that could take the same row, neighbours in order; none if there is no such pair."""
    if kind == "LIST":
        owner: dict = {}
        return [(owner[v], p.name) for p in partitions for v in dict.fromkeys(p.values) if owner.setdefault(v, p.name) != p.name]
    if kind == "RANGE":
        width = max((len(b) for p in partitions for b in (p.lower, p.upper) if isinstance(b, tuple)), default=1)
        spans = sorted(((_order(p.bound("lower", width)), _order(p.bound("upper", width)), p.name) for p in partitions), key=lambda s: s[:2])
        if wrong := [name for low, high, name in spans if low >= high]:
            raise ValueError(f"empty range of partition {wrong[0]}")
        return [(a[2], b[2]) for a, b in zip(spans, spans[1:]) if a[1] > b[0]]
    found = []
    for i, a in enumerate(partitions):
        found += [(a.name, b.name) for b in partitions[i + 1 :] if (a.remainder - b.remainder) % gcd(a.modulus, b.modulus) == 0]
    return found


def _text(value) -> object:
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _not_above(df: DataFrame, items: Column, size: int, above, name: str) -> DataFrame:
    """``df`` with the number of sorted items that are not ``above`` the row: a binary search, one projection a step,
    so that each step is worked out once and in generated code."""
    out = df.withColumn(name, F.lit(0))
    for bit in reversed([1 << i for i in range(size.bit_length())]):
        after = F.col(name) + bit
        out = out.withColumn(name, F.when((after <= size) & ~above(F.get(items, after - 1)), after).otherwise(F.col(name)))
    return out


def _located(df: DataFrame, how: Partitioning, name: str) -> DataFrame:
    """``df`` with the innermost partition that takes a row, the default's name if none does, else null."""
    if clash := overlaps(how.partitions, how.kind):
        raise ValueError(f"overlapping partitions: {clash}")
    if not how.partitions:
        return df.withColumn(name, F.lit(how.default).cast("string"))
    kinds = [df.schema[k].dataType.simpleString() for k in how.keys]
    keys, place, item = [F.col(k) for k in how.keys], f"{name}_place", f"{name}_item"
    if how.kind == "HASH":
        modulus = lcm(*(p.modulus for p in how.partitions))
        names = [None] * modulus
        for p in how.partitions:
            names[p.remainder :: p.modulus] = [p.name] * len(names[p.remainder :: p.modulus])
        found = F.get(F.from_json(F.lit(json.dumps(names)), "array<string>"), F.pmod(portable_hash(*keys), F.lit(modulus)).cast("int"))
    elif how.kind == "LIST":
        if len(keys) != 1:
            raise ValueError("LIST takes one key column")
        known = sorted((v, p.name) for p in how.partitions for v in p.values if v is not None)
        nulls = next((p.name for p in how.partitions if None in p.values), None)
        items = F.from_json(F.lit(json.dumps([{"v": _text(v), "n": n} for v, n in known])), f"array<struct<v: {kinds[0]}, n: string>>")
        # The last item that is not above the key is the key's own, if there is one.
        df = _not_above(df, items, len(known), lambda x: x["v"] > keys[0], place).withColumn(item, F.get(items, F.col(place) - 1))
        found = F.when(keys[0].isNull(), F.lit(nulls)).when(F.col(item)["v"] == keys[0], F.col(item)["n"])
    elif how.kind == "RANGE":
        width = len(keys)
        bound = "struct<" + ", ".join(f"s{i}: int, v{i}: {kind}" for i, kind in enumerate(kinds)) + ">"

        def entry(ends: tuple) -> dict:
            out = {}
            for i, v in enumerate(ends):
                out |= {f"s{i}": v.side, f"v{i}": None} if isinstance(v, _End) else {f"s{i}": 0, f"v{i}": _text(v)}
            return out

        ordered = sorted(how.partitions, key=lambda p: _order(p.bound("lower", width)))
        text = json.dumps([{"a": entry(p.bound("lower", width)), "b": entry(p.bound("upper", width)), "n": p.name} for p in ordered])
        items = F.from_json(F.lit(text), f"array<struct<a: {bound}, b: {bound}, n: string>>")
        own = F.struct(*(c for i, k in enumerate(keys) for c in (F.lit(0).alias(f"s{i}"), k.alias(f"v{i}"))))
        df = _not_above(df, items, len(ordered), lambda x: x["a"] > own, place).withColumn(item, F.get(items, F.col(place) - 1))
        complete = reduce(lambda x, y: x & y, (k.isNotNull() for k in keys))
        found = F.when(complete & (own < F.col(item)["b"]), F.col(item)["n"])
    else:
        raise ValueError(f"unknown partitioning {how.kind}")
    df = df.withColumn(name, found).drop(place, item)
    inner: dict[Partitioning, list[str]] = {}
    for p in how.partitions:
        if p.parts:
            inner.setdefault(p.parts, []).append(p.name)
    for i, below in enumerate(inner):
        df = _located(df, below, f"{name}_{i}")
    out = F.col(name)
    for i, names in enumerate(inner.values()):
        out = F.when(F.col(name).isin(names), F.col(f"{name}_{i}")).otherwise(out)
    out = F.when(F.col(name).isNotNull(), out).otherwise(F.lit(how.default))
    return df.withColumn(name, out).drop(*(f"{name}_{i}" for i in range(len(inner))))


def route_partitions(df: DataFrame, keys: str | Sequence[str], kind: str, partitions: Sequence[Partition], default: str | None = None) -> DataFrame:
    """``df`` with ``partition``, the innermost one that takes the row; null marks a violation: no partition takes it
    and there is no default. A null in a RANGE key goes to the default."""
    how = Partitioning(kind, (keys,) if isinstance(keys, str) else tuple(keys), tuple(partitions), default)
    return _located(df, how, "partition")
