"""Publications and subscriptions: change feeds, filtered and applied, in batches and streams.

A feed has a key, an operation (insert, update, delete, truncate), a commit ordinal that is unique and increasing, and
payload columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import last_before
from ..plans.session import materialize, scratch, shared_folder
from ..sources.keyed_table import KeyedTable

PIECE_ROWS, PIECES = 1_000_000, 64

def publish(feed: DataFrame, operations: Sequence[str], tables: Sequence[str] | None = None, op: str = "op", table: str = "table_name") -> DataFrame:
    """The part of a feed that a publication carries; also on a stream."""
    out = feed.filter(F.col(op).isin(list(operations)))
    return out if tables is None else out.filter(F.col(table).isin(list(tables)))


def last_truncate(feed: DataFrame, ordinal: str, op: str = "op") -> int | None:
    return feed.filter(F.col(op) == "truncate").agg(F.max(ordinal)).first()[0]


def _operations(feed: DataFrame, key: str, ordinal: str, op: str, initial: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """(key, _ord, _op, payload) of what comes after the last truncate, ``initial`` rows as inserts, and the payload's names."""
    payload = [c for c in feed.columns if c not in (key, ordinal, op)]
    cut = last_truncate(feed, ordinal, op)
    rows = feed.filter(F.col(op) != "truncate").select(key, F.col(ordinal).cast("long").alias("_ord"), F.col(op).alias("_op"), *payload)
    if initial is not None:
        rows = rows.unionByName(initial.select(key, F.lit(-1).cast("long").alias("_ord"), F.lit("insert").alias("_op"), *payload))
    if cut is not None:
        rows = rows.filter(F.col("_ord") > cut)
    return rows, payload


def fold_feed(feed: DataFrame, key: str, ordinal: str, op: str = "op", initial: DataFrame | None = None) -> DataFrame:
    """Final state and conflicts of a feed applied in commit order per key.

    One row per key: (key, payload columns of the last write, present, conflicts, skipped). An insert of a present row
    is a conflict and changes nothing; an update or delete of a missing row is skipped; a truncate, whatever its key,
    clears every row before it. ``initial`` are the rows copied first. Whether a row is present before an operation
    depends on the key's last insert, delete or truncate only; that is carried along the segments of a range sort, so
    that a key with many operations is not one task's.
    """
    rows, payload = _operations(feed, key, ordinal, op, initial)
    toggle = F.when(F.col("_op").isin("insert", "delete"), F.col("_op"))
    marked = last_before(rows, [key], [F.col("_ord")], toggle, "_was").withColumn("_there", F.coalesce(F.col("_was") == "insert", F.lit(False)))
    writes = ((F.col("_op") == "insert") & ~F.col("_there")) | ((F.col("_op") == "update") & F.col("_there"))
    alive = F.max_by(F.col("_op"), F.when(F.col("_op").isin("insert", "delete"), F.col("_ord"))) == "insert"
    return marked.groupBy(key).agg(
        *(F.max_by(c, F.when(writes, F.col("_ord"))).alias(c) for c in payload),
        F.coalesce(alive, F.lit(False)).alias("present"),
        F.count_if((F.col("_op") == "insert") & F.col("_there")).alias("conflicts"),
        F.count_if(F.col("_op").isin("update", "delete") & ~F.col("_there")).alias("skipped"),
    )


def subscribed_state(feed: DataFrame, key: str, ordinal: str, op: str = "op", initial: DataFrame | None = None) -> DataFrame:
    """The rows of the target after the whole feed: (key, payload columns), as ``fold_feed`` has them where present.

    A row is there if an insert comes after its key's last delete. The first such insert wrote it, or the last update,
    if that is later. So aggregates tell it, and no rows are sorted by their order. The last deletes are joined to the
    operations by merge; a key with more than ``PIECE_ROWS`` operations is dealt out in ``PIECES`` pieces there.
    """
    rows, payload = _operations(feed, key, ordinal, op, initial)
    deletes = rows.groupBy(key).agg(F.max(F.when(F.col("_op") == "delete", F.col("_ord"))).alias("_gone"), F.count(F.lit(1)).alias("_n"))
    deletes = materialize(deletes, "deletes")
    hashed = F.xxhash64(key)
    large = [r["h"] for r in deletes.filter(F.col("_n") > PIECE_ROWS).select(hashed.alias("h")).collect()]  # at most rows / PIECE_ROWS
    pieces = F.when(hashed.isin(large), F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    deletes = deletes.select(F.col(key).alias("_of"), "_gone", F.explode(pieces).alias("_in"))
    piece = F.when(hashed.isin(large), F.pmod(F.xxhash64("_ord"), F.lit(PIECES)).cast("int")).otherwise(0)
    writes = rows.filter(F.col("_op").isin("insert", "update")).withColumn("_piece", piece)
    since = writes.join(
        deletes.hint("merge"),
        writes[key].eqNullSafe(deletes["_of"]) & (F.col("_piece") == F.col("_in")) & (F.col("_gone").isNull() | (F.col("_ord") > F.col("_gone"))),
    )
    inserted, updated = (F.when(F.col("_op") == name, F.col("_ord")) for name in ("insert", "update"))
    written = F.struct(F.lit(0), *(F.col(c).alias(f"p{i}") for i, c in enumerate(payload)))
    found = since.groupBy(key).agg(
        F.min(inserted).alias("_first"), F.max(updated).alias("_last"), F.min_by(written, inserted).alias("_own"), F.max_by(written, updated).alias("_later")
    )
    row = F.when(F.col("_last") > F.col("_first"), F.col("_later")).otherwise(F.col("_own"))
    return found.filter(F.col("_first").isNotNull()).select(key, *(row[f"p{i}"].alias(c) for i, c in enumerate(payload)))


class StreamSubscriber:
    """A subscription to a feed that arrives as a stream: durable, found again by its name, each batch applied once.

    The state is a keyed table (``sources.keyed_table``), dealt into buckets by the feed's key, that holds three kinds of
    rows: ``now``, the present row of a key; ``base``, its row as of the horizon; and ``op``, the operations since then.
    A micro-batch reads and rewrites the buckets of its keys only: their operations are joined by the new ones, and
    their rows of now are folded again. The version that a batch makes carries the batch's number, so a batch that is
    replayed after a failure is left out, and one that failed before its version was in place is applied whole. A
    truncate concerns all buckets. Batches may bring operations in any order, as long as none is at or below the
    horizon, which only ``compact`` moves: up to there operations are folded into the base and dropped.

    ``name`` finds the subscription again in the shared folder; without one it is new. ``schema`` is that of the feed,
    needed before any batch has come. Whether it is enabled is part of the stored state.
    """

    def __init__(self, spark, key: str, ordinal: str, op: str = "op", schema=None, enabled: bool | None = None, name: str | None = None, buckets: int = 16):
        self.spark, self.key, self.ordinal, self.op, self.schema, self.buckets = spark, key, ordinal, op, schema, buckets
        self.table = KeyedTable(spark, f"{shared_folder(spark)}/subscription-{name or uuid.uuid4().hex}")
        self.first_enabled = enabled
        if self.table.exists() and enabled is not None:
            self.enabled = enabled

    # Stored state --------------------------------------------------------------------------------------------------

    def _manifest(self, schema=None) -> dict:
        if self.table.exists():
            return self.table.manifest()
        schema = schema or self.schema
        if schema is None:
            raise ValueError("no batch has come yet, and the feed's schema is not known")
        own = T.StructType([T.StructField("_kind", T.StringType()), *(T.StructField(f.name, f.dataType) for f in schema.fields)])
        meta = {"batch": -1, "enabled": self.first_enabled is not False, "horizon": None, "truncated": None}
        return self.table.create(own, [self.key, "_kind", self.ordinal], self.buckets, by=[self.key], meta=meta)

    @property
    def enabled(self) -> bool:
        return self.table.manifest()["meta"]["enabled"] if self.table.exists() else self.first_enabled is not False

    @enabled.setter
    def enabled(self, value: bool) -> None:
        self.first_enabled = value
        if self.table.exists():
            manifest = self.table.manifest()
            if manifest["meta"]["enabled"] != value:
                self.table.commit(manifest | {"meta": manifest["meta"] | {"enabled": value}})

    # Batches -------------------------------------------------------------------------------------------------------

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch, unless its number has been applied. A disabled subscription takes none."""
        manifest = self._manifest(batch.schema)
        meta = manifest["meta"]
        if not meta["enabled"] or batch_id <= meta["batch"]:
            return
        with scratch(self.spark):
            ops = batch.select(F.lit("op").alias("_kind"), *batch.columns)
            if meta["horizon"] is not None:
                ops = ops.filter(F.col(self.ordinal) > meta["horizon"])
            ops = materialize(ops, "batch")
            truncate = F.col(self.op) == "truncate"
            found = ops.groupBy(self.table.bucket(manifest).alias("b"), F.coalesce(truncate, F.lit(False)).alias("cut"))
            found = found.agg(F.max(self.ordinal).alias("last")).collect()  # two rows a bucket
            cuts = [c for c in (*(r["last"] for r in found if r["cut"]), meta["truncated"]) if c is not None]
            after = meta | {"batch": batch_id, "truncated": max(cuts, default=None)}
            if after["truncated"] != meta["truncated"]:
                touched = set(manifest["buckets"])
            else:
                touched = {r["b"] for r in found if not r["cut"]}
            rows = self._advanced(self.table.read(manifest=manifest, buckets=touched), ops.filter(~truncate), after)
            self.table.rewrite(manifest, rows, touched, after, once=True)

    def _advanced(self, held: DataFrame, ops: DataFrame, meta: dict) -> DataFrame:
        """The rows of the touched buckets with ``ops`` applied. A row of the base stands at the horizon. An operation that
        was sent before is the same row again: it changes nothing in the fold, and the rewrite keeps one. The operations
        held are read again where they lie; only the rows of now are written aside."""
        kept = held.filter("_kind <> 'now'").unionByName(ops)
        if meta["truncated"] is not None:
            horizon = F.lit(-1 if meta["horizon"] is None else meta["horizon"])
            kept = kept.filter(F.coalesce(F.col(self.ordinal), horizon) > meta["truncated"] - F.when(F.col("_kind") == "base", 1).otherwise(0))
        base = None if meta["horizon"] is None else kept.filter("_kind = 'base'").drop("_kind", self.ordinal, self.op)
        now = subscribed_state(kept.filter("_kind = 'op'").drop("_kind"), self.key, self.ordinal, self.op, base)
        now = now.select(F.lit("now").alias("_kind"), "*")
        for name in (self.ordinal, self.op):
            now = now.withColumn(name, F.lit(None).cast(kept.schema[name].dataType))
        return kept.unionByName(materialize(now, "now"))

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # Reading -------------------------------------------------------------------------------------------------------

    def state(self, version: int | None = None) -> DataFrame:
        """The target's rows, of the newest or an earlier version. Nothing is folded here."""
        manifest = self._manifest() if version is None else self.table.manifest(version)
        return self.table.read(manifest=manifest).filter("_kind = 'now'").drop("_kind", self.ordinal, self.op)

    def compact(self, below: int) -> None:
        """Move the horizon: operations up to ordinal ``below`` are folded into the base and dropped. The caller knows
        that no other one up to there is still to come."""
        manifest = self._manifest()
        with scratch(self.spark):
            held = materialize(self.table.read(manifest=manifest), "held")
            ops = held.filter(F.col("_kind") == "op")
            early = ops.filter(F.col(self.ordinal) <= below).drop("_kind")
            initial = held.filter("_kind = 'base'").drop("_kind", self.ordinal, self.op)
            base = subscribed_state(early, self.key, self.ordinal, self.op, initial).select(F.lit("base").alias("_kind"), "*")
            for name in (self.ordinal, self.op):
                base = base.withColumn(name, F.lit(None).cast(held.schema[name].dataType))
            rows = held.filter("_kind = 'now'").unionByName(ops.filter(F.col(self.ordinal) > below)).unionByName(base)
            horizon = max(below, manifest["meta"]["horizon"] if manifest["meta"]["horizon"] is not None else below)
            self.table.rewrite(manifest, materialize(rows, "compacted"), manifest["buckets"], manifest["meta"] | {"horizon": horizon})


def operation(event: Column, mapping: dict[str, str]) -> Column:
    """An event type as an operation of a feed."""
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return names[event]
