"""User functions, aggregates and operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cells import paired
from ..plans.session import materialize


def scalar_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str, strict: Sequence[str] = ()) -> None:
    """A temporary SQL function. ``parameters`` may carry defaults; a null in a ``strict`` parameter makes the result
    null. For several signatures of one name see ``overloads``."""
    guard = " OR ".join(f"{p} IS NULL" for p in strict)
    text = f"CASE WHEN {guard} THEN NULL ELSE {body} END" if strict else body
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {text}")


def table_function(spark: SparkSession, name: str, parameters: str, returns: str, query: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({returns}) RETURN {query}")


def running(value: Column, partition: Sequence[str], order: Sequence[Column]) -> Column:
    """A window-flagged sum: the total of the rows so far."""
    return F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def moving(aggregate: Callable[[Column], Column], value: Column, partition: Sequence[str], order: Sequence[Column], rows: int) -> Column:
    """An aggregate over the last ``rows`` rows."""
    return aggregate(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(1 - rows, 0))


def user_aggregate(values: Column, order: Column, initial: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column], strict: bool = True) -> Column:
    """An aggregate from a transition, an initial state and a final function, folded in the order given. A strict
    transition does not see nulls. A group's rows are gathered, so it is for bounded groups; ``scan.ordered_fold`` folds
    groups of any size in order, and ``two_level`` combines states in any order."""
    gathered = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    inputs = F.transform(gathered, lambda x: x["v"])
    if strict:
        inputs = F.filter(inputs, lambda x: x.isNotNull())
    return F.aggregate(inputs, initial, step, final)


def two_level(df: DataFrame, keys: Sequence[str], partial: Sequence[Column], combine: Sequence[Column], salts: int = 16, salt_by: Sequence[str] = ()) -> DataFrame:
    """Partial states per key and salt, then combined per key: a hot key is spread over ``salts`` tasks and no group
    is gathered. ``combine`` works on the partial columns."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*(salt_by or df.columns)), F.lit(salts)))
    return salted.groupBy(*keys, "_salt").agg(*partial).groupBy(*keys).agg(*combine)


def hypothetical_rank(df: DataFrame, keys: Sequence[str], value: Column, v: Column) -> DataFrame:
    """The rank and dense rank ``v`` would have among the values of each group."""
    return df.groupBy(*keys).agg(
        (F.count_if(value < v) + 1).alias("rank"), (F.count_distinct(F.when(value < v, value)) + 1).alias("dense_rank")
    )


def collated(column: Column, collation: str = "UTF8_LCASE") -> Column:
    return F.collate(column, collation)


def operator_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """A join on a user operator that a key function makes hashable. The pairs of a frequent key are cut into cells, and
    there are as many parts as the pairs need (``operators.cells``)."""
    one = left.withColumns({"_key": left_key, "_pid": F.monotonically_increasing_id()}).filter("_key IS NOT NULL")
    two = right.withColumns({"_key": right_key, "_rid": F.monotonically_increasing_id()}).filter("_key IS NOT NULL")
    # Written with ids, since the pieces of a frequent key's rows have to be the same whenever they are made.
    return paired(materialize(one, "operands"), materialize(two, "operands"), ["_key"], "_pid", "_rid").drop("_key", "_pid", "_rid")


def operator_laws(pairs: DataFrame, op: Callable[[Column, Column], Column], commutator: Callable[[Column, Column], Column], negator: Callable[[Column, Column], Column], a: str, b: str) -> DataFrame:
    """One row: pairs on which ``a op b = b commutator a`` or ``a op b = not (a negator b)`` does not hold."""
    x, y = F.col(a), F.col(b)
    return pairs.agg(
        F.count_if(~op(x, y).eqNullSafe(commutator(y, x))).alias("commutator_breaks"),
        F.count_if(~op(x, y).eqNullSafe(~negator(x, y))).alias("negator_breaks"),
    )
