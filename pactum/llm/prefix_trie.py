"""The prefix trie of conversations: ROLLUP over positional turn ids, in blocks of columns.

A turn's id is 128 bits of the digest of (role, text) and the length of the text. A conversation is one row of ``BLOCK``
turn-id columns for each ``BLOCK`` turns; a row's key is the node at which its block begins, so a long conversation goes
on in further rows, keyed by the prior block's node. One ROLLUP over the columns aggregates all prefixes of all blocks
together, each level combined before the shuffle, so that a prefix that a third of all conversations share costs one
row a task; ``grouping_id`` tells a row's depth. A node is known by the XOR of two 64-bit hashes of (position, turn id)
over its turns, which its parent, its children and the next block find without a walk.

Sums over a subtree come from a second ROLLUP: what a node adds is laid on its smallest member, at the node's position,
and a conversation's row carries the sums from each position to its end. A subtree's sum is then the sum over the
members of its top, from the top's position on.

Turns are numbered from a range sort, and states along one conversation are combined in blocks (``operators.scan``), so
a conversation may hold any share of all turns. The digest of the conversations that end at a node is sequential by its
definition: sorted ids are joined to pieces in many tasks, and a task reads a node's pieces one after the other.

Defined results: rows without conv_id are left out. Turns with the same number come in order of role, then text, and
count each. ``%`` keeps the sign of a negative conv_id. Extra columns are ignored. An empty table has no conversation,
and gives no node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import numbered, running_state
from ..plans.session import map_arrow, materialize, scratch, table

BLOCK = 8
FAMILY = 5  # conversations of a family begin with the turns of its first one
HEADS = 9  # they share fewer turns than this
PIECE = 1000  # ids in a piece of a digest's input
SLOTS = range(1, BLOCK + 1)
TURNS = [f"t{i}" for i in SLOTS]


def turn_id(role: Column, text: Column) -> Column:
    """24 bytes: 128 bits of a digest, then the bytes of the text as a number."""
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 16, "0")))


def shared_head(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sizes): (conv_id, pos, turn) from 1, and (conv_id, size) of every conversation, those without turns too."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.col("turn").alias("at"), role.alias("role"), text.alias("text"))
    own = numbered(rows, ["conv_id"], [F.col("at").asc_nulls_first()], "pos", ties=[F.col("role"), F.col("text")])
    own = materialize(own.select("conv_id", "pos", turn_id(F.col("role"), F.col("text")).alias("turn")), "turns")
    given = own.groupBy("conv_id").agg(F.max("pos").alias("given"))
    plan = given.withColumns({"h": shared_head(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    plan = plan.join(given.toDF("base", "_base_given"), "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("_base_given", F.lit(0))))
    plan = plan.withColumn("size", F.col("head") + F.greatest(F.col("given") - F.col("h"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "base", "h", "head", "size"), "plan")
    first = own.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    heads = plan.select("conv_id", "base", "h").join(first, "base").filter("pos <= h").select("conv_id", "pos", "turn")
    rest = own.filter(F.col("pos") > shared_head(F.col("conv_id"))).join(plan.select("conv_id", "h", "head"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "turn")
    return heads.unionByName(rest), plan.select("conv_id", "size")


def _marks(pos: Column, turn: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at its position; null for no turn."""
    there = turn.isNotNull()
    return F.when(there, F.xxhash64(pos, turn)), F.when(there, F.xxhash64(turn, pos))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def positional(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, block, size, k1, k2, x1, x2, t1..): a row for each block of a conversation, at least one. (k1, k2) is
    the node at which the block begins, (x1, x2) what its turns add."""
    slot, block = F.expr(f"(pos - 1) % {BLOCK} + 1"), F.expr(f"(pos - 1) div {BLOCK}")
    one, two = _marks(F.col("pos"), F.col("turn"))
    marked = turns.select("conv_id", block.alias("block"), slot.alias("slot"), "turn", one.alias("m1"), two.alias("m2"))
    # A conversation without turns has one row, without a turn id.
    none = sizes.filter("size = 0").select("conv_id", *(F.lit(None).cast(kind).alias(c) for c, kind in marked.dtypes[1:])).fillna(0, ["block"])
    picked = [F.max(F.when(F.col("slot") == i, F.col("turn"))).alias(f"t{i}") for i in SLOTS]
    added = [F.coalesce(F.bit_xor(m), F.lit(0).cast("long")).alias(x) for m, x in (("m1", "x1"), ("m2", "x2"))]
    rows = marked.unionByName(none).groupBy("conv_id", "block").agg(*picked, *added)
    rows = materialize(rows.join(sizes, "conv_id"), "blocks")
    long = rows.filter(F.col("size") > BLOCK).select("conv_id", "block", (F.col("block") + 1).alias("_n"), "x1", "x2")
    both = F.struct(F.col("x1").alias("a"), F.col("x2").alias("b"))
    upto = running_state(long, ["conv_id"], "_n", both, lambda p, q: F.struct(_xor(p["a"], q["a"]).alias("a"), _xor(p["b"], q["b"]).alias("b")), "_upto")
    keys = upto.select("conv_id", "block", _xor(F.col("_upto.a"), F.col("x1")).alias("k1"), _xor(F.col("_upto.b"), F.col("x2")).alias("k2"))
    return materialize(rows.join(keys, ["conv_id", "block"], "left").fillna(0, ["k1", "k2"]), "positional")


def _rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """One row for each node: depth, n1, n2, block, d (columns of its block), turn (the last one), and ``aggregates``."""
    columns = ", ".join(TURNS)
    rolled = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {columns}, {BLOCK} - bit_count(grouping_id()) AS d, {aggregates} FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({columns})",
        rows=rows,
    )
    last = F.get(F.array(*TURNS), F.col("d") - 1)
    # The empty prefix of a later block is the last node of the prior one; a missing turn begins no node.
    found = rolled.withColumn("turn", F.when(F.col("d") > 0, last)).filter("turn IS NOT NULL OR (d = 0 AND block = 0)")
    marks = [_marks(F.col("block") * BLOCK + i, F.col(f"t{i}")) for i in SLOTS]  # columns beyond the depth are null here
    zero = F.lit(0).cast("long")
    n1, n2 = (reduce(_xor, (F.coalesce(m[k], zero) for m in marks), F.col(f"k{k + 1}")) for k in (0, 1))
    return found.withColumns({"depth": F.col("block") * BLOCK + F.col("d"), "n1": n1, "n2": n2}).drop("k1", "k2", *TURNS)


NODE = ["depth", "n1", "n2"]


def _subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over the subtree of each node."""
    values = {"leaf": F.col("leaf"), "saved": F.col("saved")}
    laid = [F.sum(F.when(F.col("d") == i, v)).alias(f"{name}{i}") for name, v in values.items() for i in (0, *SLOTS)]
    own = nodes.groupBy("conv_id", "block").agg(*laid)
    # Members that are the smallest of no node add nothing to any subtree.
    some = nodes.select("conv_id").distinct()
    wide = rows.select("conv_id", "block", "size", "k1", "k2", *TURNS).join(some, "conv_id", "left_semi")
    wide = wide.join(own, ["conv_id", "block"], "left").fillna(0, [f"{name}{i}" for name in values for i in (0, *SLOTS)])
    whole = {f"{name}_all": reduce(lambda a, b: a + b, (F.col(f"{name}{i}") for i in (0, *SLOTS))) for name in values}
    wide = materialize(wide.withColumns(whole), "laid")
    long = wide.filter(F.col("size") > BLOCK).select("conv_id", "block", "leaf_all", "saved_all", F.expr(f"(size - 1) div {BLOCK} + 1 - block").alias("_n"))
    both = F.struct(F.col("leaf_all").alias("a"), F.col("saved_all").alias("b"))
    onward = running_state(long, ["conv_id"], "_n", both, lambda p, q: F.struct((p["a"] + q["a"]).alias("a"), (p["b"] + q["b"]).alias("b")), "_on")
    later = onward.select("conv_id", "block", (F.col("_on.a") - F.col("leaf_all")).alias("leaf_on"), (F.col("_on.b") - F.col("saved_all")).alias("saved_on"))
    wide = wide.join(later, ["conv_id", "block"], "left").fillna(0, ["leaf_on", "saved_on"])
    ahead = {}
    for name in values:
        total = F.col(f"{name}_on")
        for i in (*reversed(SLOTS), 0):
            total = total + F.col(f"{name}{i}")
            ahead[f"{name}_from{i}"] = total
    wide = wide.select("block", "k1", "k2", *TURNS, *(c.alias(n) for n, c in ahead.items()))
    sums = ", ".join(f"array({', '.join(f'sum({name}_from{i})' for i in (0, *SLOTS))}) AS {name}" for name in values)
    return _rolled(wide, sums).select(*NODE, F.get("leaf", F.col("d")).alias("n_leaves"), F.get("saved", F.col("d")).alias("saved_tokens"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the digest of the ids in ascending order, joined by commas."""
    schema = "depth bigint, n1 bigint, n2 bigint, first bigint, ids string"
    names = [c.split()[0] for c in schema.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in NODE])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            starts = [0, *new.tolist(), batch.num_rows] if batch.num_rows else [0]
            cuts = [(a, min(a + PIECE, z)) for start, z in zip(starts, starts[1:]) for a in range(start, z, PIECE)]
            ids = batch.column("conv_id").to_pylist()
            at = pa.array([a for a, _ in cuts], pa.int64())
            joined = pa.array([",".join(map(str, ids[a:z])) for a, z in cuts], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in NODE), batch.column("conv_id").take(at), joined], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, digest = None, None

        def told(nodes: list) -> pa.RecordBatch:
            columns = [pa.array([n[i] for n, _ in nodes], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in nodes], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if node != at:
                    if at:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield told(done)
        if at:
            yield told([(at, digest.hexdigest())])

    ordered = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    parts = map_arrow(ordered.select(*NODE, "conv_id"), pieces, schema)
    parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return map_arrow(parts, digests, "depth bigint, n1 bigint, n2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    with scratch(conversations.sparkSession) as paths:
        rows = positional(*rebuilt(conversations))
        nodes = _rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs")
        one, two = _marks(F.col("depth"), F.col("turn"))
        up = {"up1": F.when(F.col("depth") > 0, _xor(F.col("n1"), one)), "up2": F.when(F.col("depth") > 0, _xor(F.col("n2"), two))}
        size = F.conv(F.hex(F.substring("turn", 17, 8)), 16, 10).cast("long")
        nodes = materialize(nodes.withColumns({**up, "bytes": F.coalesce(size, F.lit(0))}).drop("turn"), "nodes")
        below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("n1"), F.col("up2").alias("n2"))
        nodes = nodes.join(below.agg(F.count(F.lit(1)).alias("n_children")), NODE, "left").fillna(0, ["n_children"])
        own = {"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}
        nodes = materialize(nodes.withColumns(own), "nodes")
        sums = _subtree_sums(rows, nodes)
        ends = rows.filter(f"size <= (block + 1) * {BLOCK}").select(
            F.col("size").alias("depth"), _xor(F.col("k1"), F.col("x1")).alias("n1"), _xor(F.col("k2"), F.col("x2")).alias("n2"), "conv_id"
        )
        told = nodes.join(sums, NODE).join(_end_digests(ends), NODE, "left")
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("up1"), F.col("n2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
        out = told.join(parents, ["depth", "up1", "up2"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
        )
        out = materialize(out, "trie")
        paths.remove(out.scratch_path)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL_OP13 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS x
  FROM (SELECT DISTINCT conv_id FROM t)
), c AS (SELECT conv_id, xor(x, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM crc),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, {'r': t.role, 't': t.text} AS x FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, {'r': t.role, 't': t.text} FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), l AS (
  SELECT c.conv_id, coalesce(g.turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list(x ORDER BY part, pos) AS turns FROM r GROUP BY 1) g ON g.conv_id = c.conv_id
), p AS (SELECT conv_id, len(turns) AS n, depth, turns[1:depth] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM l)),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends,
         (count(*) - 1) * coalesce(strlen(path[depth].t), 0) AS saved
  FROM p GROUP BY path, depth
), k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
s AS (
  SELECT path[1:d] AS path, d AS depth, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.path, n.saved, k.n_children IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS d FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth) GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.path = n.path AND s.depth = n.depth LEFT JOIN k ON k.path = n.path AND k.depth = n.depth
LEFT JOIN n up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1]
"""
