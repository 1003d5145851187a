"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are cut into blocks of ``block_rows``, and each slot takes one block. The
target is a fluid mix: every source that is not used up is served at once, in proportion to its exact weight. A block
is released in the slot in which the fluid mix begins with it and due by the end of the slot in which it ends; each
slot takes the released block that is due first. A source is then never a whole block ahead of or behind its target,
whatever the number of slots and sources. When a source runs out, the others go on with their weights scaled up.
No row is dropped or repeated. Windows are worked out in whole numbers, without rounding.

The slots are scheduled by segments, each by a task of its own. The state at a border T follows from T alone: take
the first slot in which a block that is under way at T is released, count as done there the blocks under way that are
due first, and run up to T. No block's window then holds both borders of that run, so what is placed before T and
what remains after T both fit their slots (by counting the windows inside any interval), and neighbouring segments
agree. The driver and the tasks hold one entry for each source and none for each block.

A source's ranks come from counts per hash bucket and a row number within the bucket, so that a source with a third of
all rows is ranked by many tasks; rows without an id, or with one that is repeated, are dealt out by their texts.

Defined results: a null source is a source of its own. ``lane`` numbers the sources by size, from LANES - 1 on all
alike; it is a label and decides nothing. Ties are ordered by id, then text hash; rows that repeat both are
interchangeable. Extra columns are ignored by ``mix_report`` and carried by ``mixed``. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import all_columns, map_arrow, materialize, table

LANES = 64
BLOCK_ROWS = 32
BUCKET_ROWS = 20_000
TEMPERATURE = 0.5
SEGMENT = 1 << 14


def target_weights(counts: list[int], temperature: float = TEMPERATURE) -> list[float]:
    return [c**temperature for c in counts]


class Fluid:
    """The fluid mix of sources with ``blocks`` (at least one) at ``weights`` (above 0), and its schedule in slots."""

    def __init__(self, blocks: list[int], weights: list[float]):
        ratios = [Fraction(w) for w in weights]
        scale = math.lcm(*(r.denominator for r in ratios))
        self.blocks, self.weights = blocks, [int(r * scale) for r in ratios]
        self.total = sum(blocks)
        used_up = [Fraction(b, w) for b, w in zip(blocks, self.weights)]  # in virtual time, which serves w in 1
        order = sorted(range(len(blocks)), key=used_up.__getitem__)
        self.ends = [used_up[i] for i in order]
        self.ended, self.active = [0], [sum(self.weights)]
        for i in order:
            self.ended.append(self.ended[-1] + blocks[i])
            self.active.append(self.active[-1] - self.weights[i])
        self.slots = [self.ended[e] + v * self.active[e] for e, v in enumerate(self.ends)]

    def _time(self, i: int, block: int) -> tuple[int, int]:
        """Floor and ceiling of the slot at which the fluid mix has served ``block`` blocks of source i."""
        e = bisect_left(self.ends, Fraction(block, self.weights[i])) if len(self.ends) > 1 else 0
        whole, rest = divmod(block * self.active[e], self.weights[i])
        return self.ended[e] + whole, self.ended[e] + whole + (rest > 0)

    def release(self, i: int, block: int) -> int:
        return self._time(i, block)[0]

    def due(self, i: int, block: int) -> int:
        return self._time(i, block + 1)[1]

    def served(self, slot: int) -> list[Fraction]:
        """Blocks of each source that the fluid mix has served before ``slot``."""
        if slot >= self.total:
            return [Fraction(b) for b in self.blocks]
        e = bisect_left(self.slots, slot)
        virtual = Fraction(slot - self.ended[e], self.active[e])
        return [min(Fraction(b), w * virtual) for b, w in zip(self.blocks, self.weights)]

    def run(
        self, done: list[int], begin: int, end: int, goal: list[int] | None = None
    ) -> Iterator[tuple[int, int, int]]:
        """(slot, source, block) from ``begin`` to ``end``; ``done`` is carried on, to ``goal`` by the end if given."""
        limit = goal or self.blocks
        waiting = [(self.release(i, n), i) for i, n in enumerate(done) if n < limit[i]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int]] = []  # (deadline, source)
        for slot in range(begin, end):
            while waiting and waiting[0][0] <= slot:
                _, i = heapq.heappop(waiting)
                due = self.due(i, done[i])
                heapq.heappush(ready, (min(due, end) if goal else due, i))
            _, i = heapq.heappop(ready)
            yield slot, i, done[i]
            done[i] += 1
            if done[i] < limit[i]:
                heapq.heappush(waiting, (self.release(i, done[i]), i))

    def done_at(self, slot: int) -> list[int]:
        """Blocks of each source placed before ``slot``, from ``slot`` alone."""
        served = self.served(slot)
        started = [i for i, x in enumerate(served) if x.denominator > 1]
        if not started:
            return [int(x) for x in served]
        begin = min(self.release(i, math.floor(served[i])) for i in started)
        served = self.served(begin)
        done = [math.floor(x) for x in served]
        started = [i for i, x in enumerate(served) if x.denominator > 1]
        for i in sorted(started, key=lambda i: (self.due(i, done[i]), i))[: begin - sum(done)]:
            done[i] += 1
        for _ in self.run(done, begin, slot):
            pass
        return done

    def segment(self, begin: int, end: int) -> tuple[list[int], Iterator[tuple[int, int, int]]]:
        """Blocks placed before ``begin``, and (slot, source, block) of the slots from there to ``end``."""
        done = self.done_at(begin)
        return list(done), self.run(done, begin, end, self.done_at(end))


class Schedule:
    """The slots of all blocks of sources with ``counts`` rows; sources without weight come after all others."""

    def __init__(self, counts: list[int], weights: list[float], block_rows: int, segment: int = SEGMENT):
        self.counts, self.block_rows = counts, block_rows
        self.parts: list[tuple[list[int], Fluid, int, int]] = []  # sources, fluid mix, slots and rows before it
        self.segments: list[tuple[int, int, int]] = []  # part, first and one past last slot in it
        slots = rows = 0
        for weighted in (True, False):
            own = [i for i, w in enumerate(weights) if (w > 0) == weighted]
            if own:
                fluid = Fluid([-(-counts[i] // block_rows) for i in own], [weights[i] if weighted else 1 for i in own])
                n = len(self.parts)
                self.segments += [(n, t, min(t + segment, fluid.total)) for t in range(0, fluid.total, segment)]
                self.parts.append((own, fluid, slots, rows))
                slots += fluid.total
                rows += sum(counts[i] for i in own)

    def blocks(self, number: int) -> Iterator[tuple[int, int, int, int]]:
        """(source, block, slot, position of its first row) of a segment."""
        part, begin, end = self.segments[number]
        own, fluid, slots, rows = self.parts[part]
        before, placed = fluid.segment(begin, end)
        rows += sum(min(n * self.block_rows, self.counts[i]) for n, i in zip(before, own))
        for slot, k, block in placed:
            yield own[k], block, slots + slot, rows
            rows += min(self.block_rows, self.counts[own[k]] - block * self.block_rows)


def _lanes(docs: DataFrame) -> list[tuple]:
    """[(source, rows)], the largest first; one row for each source reaches the driver."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r["source"], r["n"]) for r in counts), key=lambda s: (-s[1], s[0] is not None, s[0] or ""))


def _placed_blocks(spark: SparkSession, schedule: Schedule) -> DataFrame:
    """_lane, _block, _slot and _first, the position of the block's first row, worked out by a task per segment."""
    shared = spark.sparkContext.broadcast(schedule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                columns = list(zip(*shared.value.blocks(number)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    ["_lane", "_block", "_slot", "_first"],
                )

    n = len(schedule.segments)
    return map_arrow(spark.range(0, n, 1, max(1, n)), run, "_lane int, _block bigint, _slot bigint, _first bigint")


def _scheduled(
    docs: DataFrame, weights: dict[str | None, float] | None, block_rows: int, seed: int
) -> DataFrame:
    """``docs`` (doc_id, source, _tie and more) with _lane, _weight, _block, _slot and _position (dense, 0-based).

    Within its lane a row has a dense rank in hash order: the start of its bucket and its number there. The slots of
    the blocks that a bucket reaches come with the bucket, so that whole rows are dealt out once.
    """
    spark = docs.sparkSession
    lanes = _lanes(docs)
    counts = [n for _, n in lanes]
    total = sum(counts)
    targets = target_weights(counts) if weights is None else [weights.get(s, 0.0) for s, _ in lanes]
    share = [t / sum(targets) for t in targets] if sum(targets) else [1 / len(targets) for _ in targets]
    known = spark.createDataFrame(
        [(s, i, share[i]) for i, (s, _) in enumerate(lanes)], "_source string, _lane int, _weight double"
    )
    bits = max(4, math.ceil(math.log2(total / BUCKET_ROWS))) if total else 4
    rows = docs.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "_tie")).withColumn(
        "_bucket", F.shiftright("_hash", 64 - bits)
    )
    sizes = rows.groupBy("_lane", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_lane").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        sizes.select("_lane", "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts"
    )
    reached = starts.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("_start") / block_rows), F.floor((F.col("_start") + F.col("_n") - 1) / block_rows))),
    )
    placed = reached.join(_placed_blocks(spark, Schedule(counts, share, block_rows)), ["_lane", "_block"])
    buckets = placed.groupBy("_lane", "_bucket", "_start").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_slot", "_first"))).alias("_blocks")
    )
    own = Window.partitionBy("_lane", "_bucket").orderBy("_hash", "doc_id", "_tie")
    rows = rows.withColumn("_row", F.row_number().over(own) - 1).join(buckets, ["_lane", "_bucket"])
    rank = F.col("_start") + F.col("_row")
    nth = F.floor(rank / block_rows) - F.floor(F.col("_start") / block_rows)
    place = F.col("_blocks")[nth.cast("int")]
    return rows.select(
        *docs.columns,
        "_lane",
        "_weight",
        place["_block"].alias("_block"),
        place["_slot"].alias("_slot"),
        (place["_first"] + F.pmod(rank, F.lit(block_rows))).alias("_position"),
    )


def mix_report(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 7
) -> DataFrame:
    """doc_id, source, lane, weight, block, slot, position of every row. Without ``weights`` a source's target is its
    row count to the power TEMPERATURE; a source that ``weights`` does not name comes last."""
    own = docs.select("doc_id", "source", F.xxhash64("text").alias("_tie"))
    rows = _scheduled(own, weights, block_rows, seed)
    return rows.select(
        "doc_id",
        "source",
        F.least("_lane", F.lit(LANES - 1)).alias("lane"),
        F.col("_weight").alias("weight"),
        F.col("_block").alias("block"),
        F.col("_slot").alias("slot"),
        F.col("_position").alias("position"),
    )


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 7
) -> DataFrame:
    """All rows of ``docs``, in the order of the mix: partitions are ranges of positions, sorted."""
    own = docs.select("doc_id", "source", F.xxhash64("text").alias("_tie"), F.struct(*all_columns(docs)).alias("_whole"))
    rows = _scheduled(own, weights, block_rows, seed)
    return rows.repartitionByRange("_position").sortWithinPartitions("_position").select("_whole.*")


def placed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 7
) -> DataFrame:
    """doc_id, lang, source, text and position of every row: the place that ``mixed`` gives it, from the rows alone."""
    own = docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("_tie"))
    rows = _scheduled(own, weights, block_rows, seed)
    return rows.select("doc_id", "lang", "source", "text", F.col("_position").alias("position"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
