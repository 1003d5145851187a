"""Equal joins whose groups of pairs are cut into cells.

A key with many rows on both sides makes a group of pairs that no shuffle by the key can divide, and what a task has to
make is told by the pairs, not by the rows it reads. So the pairs of every key are counted first. The rows of a large
key are dealt into pieces of about ``CELL`` on each side, every piece of one side meets every piece of the other one in
a cell of its own, and there are as many parts as the pairs need.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 4096
#: Pairs and rows of a part, on average.
PAIRS, ROWS = 1 << 22, 1 << 19
MOST_PARTS = 20_000


def paired(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, cell: int = CELL) -> DataFrame:
    """The inner join of two frames on the columns ``on``, with all columns of both. The ids are unique for the rows of a
    key, and the same whenever the frames are read: a row's piece is told by the id. Nothing is broadcast but the large
    keys, of which there is at most one for each ``cell`` rows."""
    sizes = [df.groupBy(*on).agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "_p"), (right, "_r"))]
    sizes = sizes[0].join(sizes[1].hint("merge"), list(on))
    told = sizes.agg(F.sum(F.col("_p").cast("double") * F.col("_r")), F.sum(F.col("_p") + F.col("_r")), F.coalesce(F.max(F.greatest("_p", "_r")), F.lit(0))).first()
    parts = min(MOST_PARTS, max(1, ceil((told[0] or 0) / PAIRS), ceil((told[1] or 0) / ROWS)))
    keys = list(on)
    if told[2] > cell:
        pieces = lambda n: F.ceil(F.col(n) / cell).cast("int")
        large = F.broadcast(sizes.filter((F.col("_p") > cell) | (F.col("_r") > cell)).select(*on, pieces("_p").alias("_own_p"), pieces("_r").alias("_own_r")))

        def cut(df: DataFrame, own: str, other: str, id_: str, mine: str, theirs: str) -> DataFrame:
            known = df.join(large, list(on), "left").withColumn(mine, F.pmod(F.xxhash64(id_), F.coalesce(own, F.lit(1))).cast("int"))
            return known.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_own_p", "_own_r")

        left = cut(left, "_own_p", "_own_r", left_id, "_cell_p", "_cell_r")
        right = cut(right, "_own_r", "_own_p", right_id, "_cell_r", "_cell_p")
        keys += ["_cell_p", "_cell_r"]
    met = left.repartition(parts, *keys).join(right.repartition(parts, *keys).hint("merge"), keys)
    return met.drop("_cell_p", "_cell_r")
