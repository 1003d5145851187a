"""Divergence of sources: a K-squared quadtree over the counts of terms by group, priced exactly.

Groups (lang, source) are the rows of one matrix for each language, its kept terms the columns, in descending order of
their count, so that the sparse part of the matrix lies together. The matrix is cut into tiles of ``GROUPS`` rows and
``TERMS`` columns: the upper levels of a quadtree, of which only tiles with a count are stored. A task takes two tiles of
one stripe of columns (or one tile with itself) and builds the lower levels of both: a quadrant is kept where it holds
a count, K = 2 ways each. Both trees are walked together from the top: a pair of quadrants that are both zero ends
there, any other is split, down to the single cells, where the two groups' prices meet. Columns that end in zero
quadrants, at any level, cost the same for a pair of groups whatever the term is; they are priced at the end, as
their number times the price of one.

Prices: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)), in whole numbers: decimals for p, 64
bits for f, as p is at most 10^9 + 1.

Terms are counted in one pass that sends one row for each (group, term) of a batch of documents, with occurrences and
documents; a document is one row of the input, whatever its id.

Defined results: null text, lang or source is the empty string. A group without any kept term is still a group. A
language without kept terms has pairs of value 0 and no terms. Repeated rows are documents of their own. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import global_ordinal
from ..plans.session import for_workers, map_arrow, materialize, scratch, table

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
GROUPS, TERMS = 32, 1024  # rows and columns of a tile, powers of two
KEPT_TERMS = 10
HELD = 400_000  # (group, term) entries that a worker gathers before it sends them


def _letters() -> bytes:
    """Bytes of a term stay (A-Z in lower case), all others become blanks; bytes of other scripts are all kept."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and the documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        letters, names = _letters(), ["lang", "source", "term", "n", "docs"]
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                k = len(n)
                columns = [pa.array([lang] * k, pa.binary()), pa.array([source] * k, pa.binary()), pa.array(n.keys(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names)
            held.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), Counter(text.translate(letters).split())
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    plain = docs.select(*(F.coalesce(c, F.lit("")).cast("binary").alias(c) for c in ("text", "lang", "source")))
    partial = map_arrow(plain, run, "lang binary, source binary, term binary, n bigint, docs bigint")
    totals = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return totals.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "docs")


def priced(n: str, total: str, terms: str) -> F.Column:
    """p of a count among ``total`` occurrences of ``terms`` kept terms; null where there are none."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(19,0))) div CAST(nullif({total} + 2 * {terms}, 0) AS DECIMAL(29,0))")


def distance(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tree(cells):
    """Levels of a quadtree over a square matrix of marks, the single cells first: a quadrant is marked if it holds one."""
    levels = [cells]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append(m.reshape(len(m) // 2, 2, m.shape[1] // 2, 2).any(axis=(1, 3)))
    return levels


def joint_walk(a, b, same: bool) -> tuple:
    """(g, h, t) of the cells of two matrices of marks (rows, terms) that a walk over both trees ends at: pairs of rows
    g of a and h of b, with g < h if the two are the ``same`` matrix, and a term that one of them has."""
    import numpy as np

    # The top of the tree is a row of squares, each as wide as the matrix is high.
    one, two = _tree(a), _tree(b)
    width = a.shape[1] // len(a)
    g, h, t = (np.zeros(width, np.int64), np.zeros(width, np.int64), np.arange(width))
    for level in range(len(one) - 1, -1, -1):
        held = one[level][g, t] | two[level][h, t]
        if same:
            held &= g <= h if level else g < h
        g, h, t = g[held], h[held], t[held]
        if level:
            step = np.indices((2, 2, 2)).reshape(3, -1)
            g, h, t = ((2 * z[:, None] + s).ravel() for z, s in zip((g, h, t), step))
    return g, h, t


def _tile_sums(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums over the cells of two tiles of a stripe. Rows of ``t`` below 0 carry a group's price of a count of 0."""
    import numpy as np

    side, g, t, p = (rows.column(c).to_numpy() for c in ("side", "g", "t", "p"))
    same = not side.any()
    marks, prices = np.zeros((2, GROUPS, TERMS), bool), np.zeros((2, GROUPS, TERMS), np.int64)
    zero, cell = t < 0, t >= 0
    prices[side[zero], g[zero] % GROUPS] = p[zero][:, None]
    prices[side[cell], g[cell] % GROUPS, t[cell]] = p[cell]
    marks[side[cell], g[cell] % GROUPS, t[cell]] = True
    there = np.zeros((2, GROUPS), bool)
    there[side[zero], g[zero] % GROUPS] = True
    other = 0 if same else 1
    x, y, at = joint_walk(marks[0], marks[other], same)
    real = there[0, x] & there[other, y]  # the last tile may have fewer groups
    x, y, at = x[real], y[real], at[real]
    one, two = prices[0, x, at], prices[other, y, at]
    place, sums = x * GROUPS + y, np.zeros(GROUPS * GROUPS, np.int64)
    np.add.at(sums, place, (one - two) ** 2 // (one + two))
    leaves = np.bincount(place, minlength=GROUPS * GROUPS)
    hit = np.flatnonzero(leaves)
    lang, _, a, b = (k.as_py() for k in key)
    columns = [pa.array([lang] * len(hit), pa.string()), a * GROUPS + hit // GROUPS, b * GROUPS + hit % GROUPS, leaves[hit], sums[hit]]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["lang", "g", "h", "leaves", "total"])


def _leaf_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, leaves, total): for groups g < h of a language, the columns at whose cells the walk ends, and the
    sum of their prices. ``cells``: lang, g, term (from 0), p; ``groups``: lang, g, zero (price of a count of 0)."""
    tile = F.expr(f"CAST(g div {GROUPS} AS int)")
    placed = cells.select(
        "lang", F.expr(f"CAST(term div {TERMS} AS int)").alias("stripe"), tile.alias("tile"), "g", (F.col("term") % TERMS).cast("int").alias("t"), "p"
    )
    placed = materialize(placed, "cells")
    heads = groups.select("lang", tile.alias("tile"), "g", F.lit(-1).alias("t"), F.col("zero").alias("p"))
    tiles = placed.select("lang", "stripe", "tile").distinct()
    last = groups.groupBy("lang").agg(F.max(tile).alias("last"))
    # A tile meets all tiles of its language, also those without a cell in its stripe; two such never meet.
    met = tiles.join(last, "lang").select("lang", "stripe", "tile", F.explode(F.expr("sequence(0, last)")).alias("other"))
    met = met.select("lang", "stripe", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")).distinct()
    first = met.select("*", F.lit(0).alias("side"), F.col("a").alias("tile"))
    sides = first.unionByName(met.filter("a <> b").select("*", F.lit(1).alias("side"), F.col("b").alias("tile")))
    columns = ("lang", "stripe", "a", "b", "side", "g", "t", "p")
    rows = sides.join(placed, ["lang", "stripe", "tile"]).select(*columns)
    rows = rows.unionByName(sides.join(heads, ["lang", "tile"]).select(*columns))
    for_workers(rows.sparkSession)
    schema = "lang string, g bigint, h bigint, leaves bigint, total bigint"
    sums = rows.groupBy("lang", "stripe", "a", "b").applyInArrow(_tile_sums, schema)
    return sums.groupBy("lang", "g", "h").agg(F.sum("leaves").alias("leaves"), F.sum("total").alias("total"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, kept_terms: int = KEPT_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the divergence of a group from each other source of its
    language. Part ``term``: the ``kept_terms`` terms that set a group apart from its language most."""
    with scratch(docs.sparkSession) as paths:
        counts = materialize(term_counts(docs), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all"))
        kept = kept.filter(F.col("d") >= least).select("lang", "term", "all")
        kept = global_ordinal(kept, [F.col("lang"), F.col("all").desc(), F.col("term")], "_place")
        langs = kept.groupBy("lang").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
        langs = materialize(langs, "langs")
        kept = kept.join(langs, "lang").select(
            "lang", F.col("term").alias("item"), (F.col("_place") - F.col("_first")).alias("term"), priced("all", "lang_total", "terms").alias("q")
        )
        own = materialize(counts.select("lang", "source", F.col("term").alias("item"), "n").join(kept, ["lang", "item"]), "kept-counts")
        totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # One row for each group of a language: its divergence has the square of that.
        named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        numbered = named.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        groups = numbered.join(totals, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
        groups = groups.fillna(0, ["total", "terms"]).withColumn("none", F.lit(0))
        groups = materialize(groups.select("lang", "source", "g", "total", "terms", priced("none", "total", "terms").alias("zero")), "groups")
        cells = own.join(groups, ["lang", "source"]).withColumn("p", priced("n", "total", "terms"))
        sums = _leaf_sums(cells.select("lang", "g", "term", "p"), groups.select("lang", "g", "zero"))
        sums = sums.union(sums.select("lang", "h", "g", "leaves", "total"))
        others = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("zero").alias("other_zero"))
        empty = F.coalesce(distance("zero", "other_zero"), F.lit(0)) * (F.col("terms") - F.col("leaves"))
        pairs = groups.select("lang", "source", "g", "zero", "terms").join(others, "lang").filter("g <> h")
        pairs = pairs.join(sums, ["lang", "g", "h"], "left").fillna(0, ["leaves", "total"])
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("total") + empty).alias("value"))
        apart = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", distance("p", "q").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).alias("rank")
        out = pairs.select("*", rank).unionByName(apart.select("*", rank).filter(F.col("rank") <= kept_terms))
        out = materialize(out, "divergence")
        paths.remove(out.scratch_path)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL_OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
