"""Views: named queries, recursion, check options and refreshed copies."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import all_columns, delete_path, discard, list_names, materialize, shared_folder
from . import checks


def define_view(spark: SparkSession, name: str, query: str | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Register a query under a name, its output columns renamed by position."""
    df = spark.sql(query) if isinstance(query, str) else query
    if columns is not None:
        if len(columns) > len(df.columns):
            raise ValueError("more names than columns")
        df = df.toDF(*columns, *df.columns[len(columns) :])
    df.createOrReplaceTempView(name)
    return df


BUCKETS, RUNS = 8, 8


class _Seen:
    """The rows of a recursion so far, in buckets by their hash. A round adds a run of buckets; once ``runs`` of a size
    are there they are merged into one of the next size, so a lookup reads few files whatever the number of rounds."""

    def __init__(self, spark: SparkSession, buckets: int, runs: int):
        self.spark, self.buckets, self.limit = spark, buckets, runs
        self.runs: list[tuple[int, DataFrame, set[str]]] = []

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*all_columns(rows)), F.lit(self.buckets)).cast("int"))

    def stored(self, rows: DataFrame) -> tuple[DataFrame, set[str]]:
        """``rows`` (with _bucket) written, and the buckets that have any: the folders tell, without a job."""
        out = materialize(rows, "recursion", by=("_bucket",))
        return out, {n for n in list_names(self.spark, out.scratch_path) if n.startswith("_bucket=")}

    def known(self, buckets: set[str]) -> DataFrame | None:
        """The rows in these buckets, as one scan."""
        paths = [f"{run.scratch_path}/{b}" for _, run, held in self.runs for b in sorted(held & buckets)]
        if not paths:
            return None
        schema = self.runs[0][1].drop("_bucket").schema
        return self.spark.read.schema(schema).parquet(*paths)

    def add(self, run: DataFrame, held: set[str]) -> None:
        self.runs.append((0, run, held))
        size = 0
        while len(alike := [r for r in self.runs if r[0] == size]) >= self.limit:
            paths = [f"{r.scratch_path}/{b}" for _, r, h in alike for b in sorted(h)]
            rows = self.dealt(self.spark.read.schema(run.drop("_bucket").schema).parquet(*paths)).repartition("_bucket")
            merged = self.stored(rows)
            self.runs = [r for r in self.runs if r[0] != size] + [(size + 1, *merged)]
            self.merged_away(alike)
            size += 1

    def merged_away(self, runs: list) -> None:
        discard(*(r for _, r, _ in runs))

    def rows(self) -> DataFrame:
        return self.known({b for _, _, held in self.runs for b in held})


def recursive_view(seed: DataFrame, step: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """The seed's rows and those that ``step`` derives from the newest ones, until none is new (UNION semantics),
    however many rounds that takes. Rows that a round derives are looked up in their own buckets only, and each round's
    plan is that of ``step`` and one scan: neither grows with the rounds."""
    spark = seed.sparkSession
    seen = _Seen(spark, buckets, runs)
    columns = seed.columns
    fresh, held = seen.stored(seen.dealt(seed.distinct()))
    if not held:
        return fresh.drop("_bucket")
    while held:
        # The round's input stays as it is even if its run is merged away meanwhile: step reads it before that.
        derived, met = seen.stored(seen.dealt(step(fresh.drop("_bucket")).toDF(*columns).distinct()))
        seen.add(fresh, held)
        known = seen.known(met)
        rows = derived.drop("_bucket")
        fresh, held = seen.stored(seen.dealt(rows if known is None else rows.subtract(known)))
        discard(derived)
    discard(fresh)
    return seen.rows()


@dataclass(frozen=True)
class View:
    """A filter over a table or another view. ``option`` is None, LOCAL or CASCADED."""

    name: str
    predicate: Column
    base: View | None = None
    option: str | None = None


def check_option(view: View) -> Column:
    """What a new row must satisfy. CASCADED takes in the predicates of all views below; LOCAL its own and those of
    the views below that set an option themselves. A predicate that is null makes the row invisible and fails."""

    def collected(v: View | None, cascaded: bool) -> list[Column]:
        if v is None:
            return []
        cascaded = cascaded or v.option == "CASCADED"
        own = [v.predicate] if cascaded or v.option == "LOCAL" else []
        return own + collected(v.base, cascaded)

    held = F.lit(True)
    for p in collected(view, False):
        held = held & F.coalesce(p, F.lit(False))
    return held


def check_option_violations(rows: DataFrame, view: View) -> DataFrame:
    return rows.filter(~check_option(view))


_copies: dict[tuple[int, str], list[str]] = {}


def refresh_materialized(query: DataFrame, name: str, unique: Sequence[str] = (), keep: int = 2) -> DataFrame:
    """Recompute a materialized view: written to a new path in the shared folder, checked for uniqueness there, and
    only then registered under its name. The old copy is never overwritten while it may be read; of the session's
    copies of a view the ``keep`` newest stay, older ones are deleted."""
    spark = query.sparkSession
    path = f"{shared_folder(spark)}/materialized-{name}-{uuid.uuid4().hex}"
    query.write.parquet(path)
    fresh = spark.read.schema(query.schema).parquet(path)
    if unique and not checks.check_unique(fresh, list(unique)).isEmpty():
        delete_path(spark, path)
        raise ValueError(f"materialized view {name} breaks its unique index")
    fresh.createOrReplaceTempView(name)
    copies = _copies.setdefault((id(spark), name), [])
    copies.append(path)
    while len(copies) > max(keep, 1):
        delete_path(spark, copies.pop(0))
    return fresh
