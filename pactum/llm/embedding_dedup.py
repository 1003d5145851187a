"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine verification, components.

1. Equal vectors of a label are one class with a weight. A class has one signature of ``bits`` signs in each of
   ``tables`` tables. ``bits`` is the logarithm of the number of rows, so that an unrelated vector shares a bucket about
   once a table whatever the size of the input; ``tables`` is then so large that a pair at the threshold shares no
   bucket with probability ``MISS`` at most. Closer pairs are missed far less often.
2. Balls. In buckets of more than ``BLOCK`` classes, those within half the threshold's angle of one leader are all
   linked with each other, so they are counted by the weight of their ball and never paired. The leader of a class is
   the smallest that it meets in a bucket of two tables, or that leader's own leader where it is near enough.
3. A bucket is compared as one block, a larger one as pairs of blocks of about ``BLOCK`` classes, dealt out over the
   cluster. Cosines are taken from whole vectors in double precision. A pair counts in the first table that it shares,
   so links are counted without being listed, and a block returns one row for each linked class: the weight of its
   links, and the smallest class that it is connected with there.
4. Components of these connections by hooking and doubling, every round written to the shared folder.

No bucket, block or group of copies is capped. Work that stays quadratic: pairs of *different* balls and of classes
without a ball that share a bucket, in blocks.

Defined results: a vector that is null, empty, zero, or holds a null, infinite or NaN component links with nothing, as do
rows with a null label; so do vectors of different lengths. A row is a node: rows that repeat an id and a vector link
with each other, rows that repeat an id with different vectors are separate. A row without an id links with nothing
and has no component, but is kept. Extra columns are ignored by the report and carried by ``deduplicated``. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import all_columns, map_arrow, materialize, scratch, table
from .jaccard_join import components
from .worker_state import held

COSINE = 0.98
MISS = 0.001
BLOCK = 128
SMALL = 16  # groups up to here are compared by shifts of the whole batch, larger ones by a matrix product each
SEED = 11
MARGIN = 1e-6  # radians that the bound of a ball stays below half the threshold's angle


def table_plan(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for so many rows."""
    bits = max(8, math.ceil(math.log2(max(rows, 2))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def valid() -> F.Column:
    """Rows that can link: an id, a label, and a vector of finite components, not all of them zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(there & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _scaled(x):
    """Rows divided by a power of two, so that no square overflows; it changes no cosine."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _by_length(lists) -> Iterator[tuple]:
    """(rows, matrix) for each length of the vectors in a list column."""
    import numpy as np

    ends = lists.offsets.to_numpy()
    flat, sizes, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends), ends[:-1] - ends[0]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _scaled(flat[starts[at][:, None] + np.arange(size)])


def _planes(size: int, number: int, seed: int):
    import numpy as np

    return np.random.default_rng([seed, size]).standard_normal((size, number))


def with_signatures(classes: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """``classes`` (cid, label, id, weight, embedding) with ``size`` and ``sigs``, one signature a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sigs, sizes = np.zeros((batch.num_rows, tables), np.int64), np.zeros(batch.num_rows, np.int32)
            for at, x in _by_length(batch.column("embedding")):
                size = x.shape[1]
                planes = held("embedding_dedup", (size, bits, tables, seed), lambda n=size: _planes(n, bits * tables, seed))
                signs = (x @ planes > 0).reshape(len(at), tables, bits)
                sigs[at], sizes[at] = signs @ (np.int64(1) << np.arange(bits)), size
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
            out = [pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(sigs.ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "size", "sigs"])

    return map_arrow(classes, run, f"{classes.schema.toDDL()}, size int, sigs array<bigint>")


BUCKET = ("label", "size", "t", "sig")


def _members(vectors: DataFrame) -> DataFrame:
    """(bucket, cid, m) of buckets that two or more classes share; m of them."""
    entries = vectors.select("label", "size", F.posexplode("sigs").alias("t", "sig"), "cid")
    shared = entries.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return materialize(entries.join(shared, list(BUCKET)), "members")


def _balls(vectors: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(cid, ball) of classes in large buckets that are within half the threshold's angle of their leader."""
    sigs = vectors.select("cid", "sigs")
    finer = members.filter(F.col("m") > BLOCK).join(sigs, "cid").withColumn("next", F.expr("sigs[(t + 1) % size(sigs)]"))
    finer = finer.select(*BUCKET, "next", "cid")
    leads = finer.groupBy(*BUCKET, "next").agg(F.min("cid").alias("lead"))
    led = materialize(finer.join(leads, [*BUCKET, "next"]).groupBy("cid").agg(F.min("lead").alias("lead")), "led")
    own = vectors.select("cid", "embedding")
    pairs = led.join(led.select(F.col("cid").alias("lead"), F.col("lead").alias("above")), "lead")
    pairs = pairs.join(own, "cid")
    for name in ("lead", "above"):
        pairs = pairs.join(own.select(F.col("cid").alias(name), F.col("embedding").alias(f"_{name}")), name)
    near = math.cos(math.acos(cosine) / 2 - MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ball = np.full(batch.num_rows, -1, np.int64)
            for name in ("lead", "above"):
                to = batch.column(name).to_numpy()
                # Leader and follower share a bucket, so their lengths are the same.
                for (at, x), (_, y) in zip(_by_length(batch.column("embedding")), _by_length(batch.column(f"_{name}"))):
                    cosines = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    close = at[cosines >= near]
                    ball[close] = to[close]
            keep = pa.array(ball >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(ball)], ["cid", "ball"]).filter(keep)

    return materialize(map_arrow(pairs, run, "cid bigint, ball bigint"), "balls")


PAIR = (*BUCKET, "i", "j")


def _dealt(members: DataFrame, balls: DataFrame) -> DataFrame:
    """(pair of blocks, side, cid, ball): who is compared with whom. Side 0: all with each other, else 1 with 2.

    A block holds classes of one ball or of none that matters; two blocks of one ball are never paired."""
    light = members.filter(F.col("m") <= BLOCK).select(*BUCKET, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "cid")
    light = light.join(balls, "cid", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    heavy = members.filter(F.col("m") > BLOCK).join(balls, "cid", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    units = heavy.groupBy(*BUCKET, "ball").agg(F.count(F.lit(1)).alias("n"))
    # Small balls of a bucket go with the classes without one; the comparison itself leaves out pairs within a ball.
    unit = F.when(F.col("n") > BLOCK // 2, F.col("ball")).otherwise(F.lit(-1))
    units = materialize(units.withColumn("unit", unit), "units")
    sizes = units.groupBy(*BUCKET, "unit").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    blocks = sizes.select(*BUCKET, "unit", "parts", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    number = F.xxhash64("unit", "part").alias("i")
    blocks = blocks.select(*BUCKET, "unit", number)
    one = blocks.select(*BUCKET, F.col("unit").alias("u"), "i")
    two = blocks.select(*BUCKET, F.col("unit").alias("v"), F.col("i").alias("j"))
    met = one.join(two, list(BUCKET)).filter("(i < j AND (u = -1 OR u <> v)) OR (i = j AND u = -1)").select(*PAIR)
    placed = heavy.join(units.select(*BUCKET, "ball", "unit"), [*BUCKET, "ball"]).join(sizes, [*BUCKET, "unit"])
    placed = placed.withColumn("block", F.xxhash64("unit", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")))
    placed = placed.select(*BUCKET, "block", "cid", "ball")
    first = met.select(*PAIR, F.when(F.col("i") == F.col("j"), 0).otherwise(1).alias("side"), F.col("i").alias("block"))
    second = met.filter("i <> j").select(*PAIR, F.lit(2).alias("side"), F.col("j").alias("block"))
    sides = first.unionByName(second).join(placed, [*BUCKET, "block"]).drop("block")
    wide = light.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")})
    return wide.unionByName(sides)


def _linked(group, side, x, norm, sigs, t, ball, cosine):
    """Row numbers (a, b) of the linked pairs of a batch of whole groups."""
    import numpy as np

    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    own = np.repeat(sizes, sizes)
    found = []
    small = int(min(SMALL, sizes.max()))
    for k in range(1, small):
        a = np.flatnonzero((group[k:] == group[:-k]) & (own[k:] <= SMALL))
        found.append((a, a + k, np.einsum("ij,ij->i", x[a], x[a + k]) / (norm[a] * norm[a + k])))
        found[-1] = tuple(part[found[-1][2] >= cosine] for part in found[-1][:2])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        at = np.arange(start, start + size)
        left, right = (at, at) if side[start] == 0 else (at[side[at] == 1], at[side[at] == 2])
        hit = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right]) >= cosine
        a, b = (z for z in np.nonzero(np.triu(hit, 1) if side[start] == 0 else hit))
        found.append((left[a], right[b]))
    a = np.concatenate([z[0] for z in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([z[1] for z in found]) if found else np.empty(0, np.int64)
    fits = ((side[a] == 0) | (side[a] != side[b])) & ((ball[a] != ball[b]) | (ball[a] < 0))
    earlier = ((sigs[a] == sigs[b]) & (np.arange(sigs.shape[1]) < t[a][:, None])).any(axis=1)
    return a[fits & ~earlier], b[fits & ~earlier]


def _compared(dealt: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """(cid, n, to) of the classes that have links in a pair of blocks: their weight, and the smallest class there
    that the links reach."""
    rows = dealt.join(vectors.select("cid", "weight", "embedding", "sigs"), "cid")
    rows = rows.repartition(*PAIR).sortWithinPartitions(*PAIR)

    def links(rows: pa.Table) -> pa.RecordBatch:
        import numpy as np

        column = lambda name: rows.column(name).to_numpy()
        key = np.stack([column(c).astype(np.int64) for c in PAIR])
        group = np.cumsum(np.r_[0, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        cid, weight, side, ball, t = (column(c) for c in ("cid", "weight", "side", "ball", "t"))
        sigs = rows.column("sigs").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        lists = rows.column("embedding").combine_chunks()
        a, b = [], []
        for at, x in _by_length(lists):  # rows of a group have one length
            found = _linked(group[at], side[at], x, np.linalg.norm(x, axis=1), sigs[at], t[at], ball[at], cosine)
            a.append(at[found[0]])
            b.append(at[found[1]])
        a, b = np.concatenate(a), np.concatenate(b)
        n, to = np.zeros(rows.num_rows, np.int64), cid.copy()
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
        before = None
        while before is None or (before != to).any():
            before = to.copy()
            least = np.minimum(to[a], to[b])
            np.minimum.at(to, a, least)
            np.minimum.at(to, b, least)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(n[at]), pa.array(to[at])], ["cid", "n", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            last = [rows.column(c)[-1].as_py() for c in PAIR]
            same = np.all([rows.column(c).to_numpy() == v for c, v in zip(PAIR, last)], axis=0)
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield links(rows.slice(0, cut).combine_chunks())
            rest = rows.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield links(rest)

    return map_arrow(rows, run, "cid bigint, n bigint, to bigint")


def near_rows(rows: DataFrame, cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """(vec_id, label, embedding, n_links, component_id, kept) of every row of ``rows``."""
    with scratch(rows.sparkSession) as paths:
        good = rows.filter(valid()).select("vec_id", "label", "embedding")
        bits, tables = table_plan(rows.count(), cosine, miss)
        classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
        classes = classes.select(F.monotonically_increasing_id().alias("cid"), "label", "id", "weight", "embedding")
        vectors = materialize(with_signatures(classes, bits, tables, seed), "vectors")
        members = _members(vectors)
        balls = _balls(vectors, members, cosine)
        found = materialize(_compared(_dealt(members, balls), vectors, cosine), "links")
        weights = vectors.select("cid", "id", "weight")
        in_ball = balls.join(weights, "cid")
        whole = in_ball.groupBy("ball").agg(F.sum("weight").alias("all"), F.min("cid").alias("to"))
        in_ball = in_ball.join(whole, "ball").select("cid", (F.col("all") - F.col("weight")).alias("n"), "to")
        linked = found.unionByName(materialize(in_ball, "in-ball"))
        comp = components(linked.select(F.col("cid").alias("x"), F.col("to").alias("y")))
        comp = comp.select(F.col("id").alias("cid"), "comp")
        least = weights.join(comp, "cid").groupBy("comp").agg(F.min("id").alias("component"))
        places = comp.join(least, "comp").join(linked.groupBy("cid").agg(F.sum("n").alias("n")), "cid").select("cid", "n", "component")
        told = vectors.select("cid", "label", "embedding", "id", "weight").join(places, "cid", "left").select(
            "label",
            "embedding",
            (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        seen = good.join(told, ["label", "embedding"]).select("vec_id", "label", "embedding", "n_links", "component_id")
        alone = rows.filter(~valid()).select("vec_id", "label", "embedding", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = seen.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
        out = materialize(out, "near-vectors")
        paths.remove(out.scratch_path)
    return out


def near_report(rows: DataFrame, cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, label)."""
    return near_rows(rows, cosine, miss, seed).select("vec_id", "n_links", "component_id", "kept")


def deduplicated(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``rows`` that are kept, with all their columns; a repeated row once."""
    gone = near_rows(rows, cosine).filter("NOT kept").select("vec_id", "label", "embedding").distinct()
    own = rows.select("vec_id", "label", "embedding", valid().alias("_valid"), F.struct(*all_columns(rows)).alias("_row"))
    own = own.filter("_valid").join(gone, ["vec_id", "label", "embedding"], "left_anti").dropDuplicates(["vec_id", "label", "embedding"])
    return own.select("_row.*").unionByName(rows.filter(~valid()))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(table(spark, sf_dir, "embeddings"))


SQL_OP11 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp ON comp.x = e.vec_id LEFT JOIN degree ON degree.x = e.vec_id
"""
