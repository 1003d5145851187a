"""Exact deduplication by 128-bit content hash, with the bytes compared inside every hash group.

Native: DataFrame functions only. Two texts are equal when they are identical once every ASCII white-space
character is deleted. Of equal texts, the row with the most code points in its original text stays, and of
those the smallest ``doc_id``.

Defined results: a null text counts as empty, so null, empty and blank texts form one group. A null ``doc_id``
loses against any other. Rows that repeat the kept ``doc_id`` with an equal text are all reported as kept;
``deduplicated`` keeps one of them. Extra columns are ignored by ``dedup_report`` and carried by
``deduplicated``. An empty table gives an empty report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import all_columns, materialize, table

WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha_prefix(norm: Column, sha: Column) -> Column:
    """The first 128 bits of the SHA-256 that the report carries anyway."""
    return F.unhex(F.substring(sha, 1, 32))


def _rows(docs: DataFrame, hash128: Callable[[Column, Column], Column]) -> DataFrame:
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
        .select("doc_id", F.length("_text").cast("long").alias("_len"), normalised(F.col("_text")).alias("_norm"))
        .withColumn("_sha", F.sha2(F.col("_norm"), 256))
        .withColumn("_h", hash128(F.col("_norm"), F.col("_sha")))
    )


def _best() -> Column:
    """Longest original text, then the smallest id; null ids last."""
    return F.min(F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i")))


def dedup_report(docs: DataFrame, hash128: Callable[[Column, Column], Column] = sha_prefix) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Copies collapse in the map-side half of the aggregate, so a text that a third of all rows repeat costs one
    row per map task; the join back is a plain equi-join on the hash, which adaptive execution splits when one
    hash is hot. Each hash group gathers its *distinct* texts, one unless 128 bits have collided; groups with
    more are grouped again by their whole text.
    """
    rows = _rows(docs, hash128)
    groups = materialize(
        rows.groupBy("_h")
        .agg(F.collect_set("_norm").alias("_texts"), F.count(F.lit(1)).alias("group_size"), _best().alias("_best"))
        .select("_h", "group_size", F.size("_texts").alias("_distinct"), F.col("_best.i").alias("keep_id")),
        "dedup-groups",
    )
    narrow = rows.select("doc_id", "_h", "_sha")
    single = groups.filter("_distinct = 1").select("_h", "group_size", "keep_id")
    found = narrow.join(single, "_h").select("doc_id", "keep_id", "group_size", "_sha")
    if not groups.filter("_distinct > 1").isEmpty():
        clashing = groups.filter("_distinct > 1").select("_h")
        apart = rows.join(clashing, "_h", "left_semi")
        exact = apart.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("_best"))
        found = found.unionByName(
            apart.join(exact, ["_h", "_norm"]).select(
                "doc_id", F.col("_best.i").alias("keep_id"), "group_size", "_sha"
            )
        )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a repeated kept row stays once."""
    kept = dedup_report(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("_sha")).distinct()
    own = docs.select(
        "doc_id",
        F.sha2(normalised(F.col("text")), 256).alias("_sha"),
        F.length(F.coalesce("text", F.lit(""))).alias("_len"),
        F.struct(*all_columns(docs)).alias("_row"),
    )
    joined = own.join(kept, own["doc_id"].eqNullSafe(kept["doc_id"]) & (own["_sha"] == kept["_sha"]), "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        longest = Window.partitionBy("doc_id", "_sha").orderBy(F.col("_len").desc())
        joined = joined.withColumn("_n", F.row_number().over(longest)).filter("_n = 1")
    return joined.select("_row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


SQL_OP7 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
