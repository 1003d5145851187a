"""Collations of a locale: equality, uniqueness and order of strings as people of a place see them.

Spark compares collated strings with ICU, also in shuffles, aggregates and range sorts. As in PostgreSQL, a collation is
deterministic unless said otherwise: strings that only it holds equal stay different for equality and uniqueness, and
come in the order of their bytes. One that is not deterministic may leave out accents and case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import global_ordinal


@dataclass(frozen=True)
class Collation:
    """``locale`` as ``fr_CA.utf8``; ``C`` and ``POSIX`` compare bytes, an empty one is the root of all locales."""

    locale: str = ""
    accents: bool = True
    case: bool = True
    deterministic: bool = True

    def __post_init__(self):
        if self.deterministic and not (self.accents and self.case):
            raise ValueError("a collation that leaves out accents or case is not deterministic")

    def resolved(self, spark: SparkSession) -> str:
        """The name that Spark has for it: the language in that country, else the language."""
        suffix = ("" if self.case else "_CI") + ("" if self.accents else "_AI")
        plain = self.locale.split(".")[0].split("@")[0]
        if plain in ("C", "POSIX"):
            if suffix:
                raise ValueError("bytes have no accents or case")
            return "UTF8_BINARY"
        if not plain:
            return f"UNICODE{suffix}"
        language, _, country = plain.replace("-", "_").partition("_")
        known = {r["NAME"] for r in spark.sql("SELECT NAME FROM collations()").collect()}  # a fixed list of Spark
        names = [language.lower()]
        if country and language.lower() in known:
            names.insert(0, f"{language.lower()}_{spark.sparkContext._jvm.java.util.Locale(language, country).getISO3Country()}")
        for name in names:
            if name in known:
                return f"{name}{suffix}"
        raise ValueError(f"no collation for locale {self.locale}")

    def key(self, spark: SparkSession, column: Column) -> Column:
        """What equal strings share: a key to group, join and be unique by."""
        return column if self.deterministic else F.collate(column, self.resolved(spark))

    def order(self, spark: SparkSession, column: Column) -> list[Column]:
        """Sort keys; strings that compare alike come in the order of their bytes."""
        return [F.collate(column, self.resolved(spark)), column]


def unique_violations(df: DataFrame, column: str, collation: Collation) -> DataFrame:
    """(example, n): groups of rows that are equal under the collation; the example is the first by its bytes. Nulls are
    distinct."""
    key = collation.key(df.sparkSession, F.col(column))
    rows = df.filter(F.col(column).isNotNull()).select(key.alias("_k"), F.col(column).alias("_v"))
    return rows.groupBy("_k").agg(F.min("_v").alias("example"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("_k")


def collated_ordinal(df: DataFrame, column: str, collation: Collation, ties: list[Column], name: str = "ordinal") -> DataFrame:
    """``df`` with a dense number in the collation's order, from a range sort; ``ties`` make the order total."""
    return global_ordinal(df, [*collation.order(df.sparkSession, F.col(column)), *ties], name)
