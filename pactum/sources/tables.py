"""Foreign tables, seed files and generated fixtures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import derive
from ..plans.session import quoted


def overlaid(*layers: Mapping[str, str]) -> dict[str, tuple[str, int]]:
    """The options in force, each with the number of the layer that gave it: later layers win. Names are those of a
    data source, so their case does not count."""
    found: dict[str, tuple[str, int]] = {}
    for number, layer in enumerate(layers):
        found |= {name.lower(): (value, number) for name, value in layer.items()}
    return found


def _loaded(spark: SparkSession, wrapper: str, contract: Mapping[str, str], options: tuple[Mapping[str, str], ...]) -> DataFrame:
    """What the source holds. A CSV file without a header has no names: its columns are the declared ones in order."""
    given = {name: value for name, (value, _) in overlaid(*options).items()}
    path = given.pop("path", None)
    reader = spark.read.format(wrapper).options(**given)
    if wrapper == "csv" and given.get("header", "false").lower() != "true":
        reader = reader.schema(", ".join(f"{quoted(c)} STRING" for c in contract))
    return reader.load(path) if path else reader.load()


def foreign_table(spark: SparkSession, wrapper: str, contract: Mapping[str, str], *options: Mapping[str, str]) -> DataFrame:
    """A table behind a data source. Option maps overlay each other in the order server, user mapping, table; the
    declared columns are enforced by name. ``path`` names the place of file sources. A value that does not cast is
    null; ``foreign_columns`` tells which columns are missing, extra or of another type."""
    if wrapper == "json":
        # Declared names and types spare the pass that finds them out.
        given = {name: value for name, (value, _) in overlaid(*options).items()}
        path = given.pop("path", None)
        reader = spark.read.format(wrapper).options(**given).schema(", ".join(f"{quoted(c)} {t}" for c, t in contract.items()))
        return derive.conform(reader.load(path) if path else reader.load(), contract)[0]
    return derive.conform(_loaded(spark, wrapper, contract, options), contract)[0]


def foreign_columns(spark: SparkSession, wrapper: str, contract: Mapping[str, str], *options: Mapping[str, str]) -> DataFrame:
    """(column_name, declared, found, state, lost): a row for each column of the declaration or the source. State is
    same, cast, missing or extra; ``lost`` counts values that the declared type cannot hold, in one pass over the
    columns to be cast."""
    source = _loaded(spark, wrapper, contract, options)
    found = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    declared = {c: T.DataType.fromDDL(t).simpleString() for c, t in contract.items()}
    rows = []
    for c in [*declared, *(c for c in found if c not in declared)]:
        state = "extra" if c not in declared else "missing" if c not in found else "same" if declared[c] == found[c] else "cast"
        rows.append((c, declared.get(c), found.get(c), state))
    cast = [c for c, _, _, state in rows if state == "cast"]
    lost = [F.count_if(F.col(quoted(c)).isNotNull() & F.col(quoted(c)).try_cast(contract[c]).isNull()).alias(c) for c in cast]
    counted = source.agg(*lost).first().asDict() if cast else {}
    schema = "column_name string, declared string, found string, state string, lost long"
    return spark.createDataFrame([(*row, counted.get(row[0], 0)) for row in rows], schema)


def seed_load(spark: SparkSession, path: str, contract: Mapping[str, str], null: str = "\\N") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a CSV file with a header; ``\\N`` is null. Bad rows keep their text in _corrupt_record."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in contract.items()), "_corrupt_record STRING"])
    rows = spark.read.csv(path, schema=schema, header=True, nullValue=null, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    good = rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, rows.filter(F.col("_corrupt_record").isNotNull())


def seed_write(df: DataFrame, path: str, null: str = "\\N") -> None:
    df.write.csv(path, header=True, nullValue=null)


def draw(salt: str, below: int, *keys: Column) -> Column:
    """A number 0..below-1 that depends on the keys and the salt only, however the rows are dealt out."""
    return F.pmod(derive.portable_hash(F.lit(salt), *keys), F.lit(below))


# Language and country parts of the generated locales.
LANGUAGES = "en de fr es it pt nl sv da fi pl cs".split()
COUNTRIES = "US GB DE FR ES".split()


def generate_users(base: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One user per key of ``base``, with nullable fields at fixed rates (45, 50 and 25 % null); of equal e-mail
    addresses the smallest key stays."""
    k = F.col(key)
    d = lambda salt, below: draw(f"{seed}:{salt}", below, k)
    pick = lambda items, salt: F.element_at(F.array(*map(F.lit, items)), (d(salt, len(items)) + 1).cast("int"))
    users = base.select(
        k.alias("id"),
        F.when(d("modified", 100) >= 45, F.date_add(F.lit("2020-01-01").cast("date"), d("day", 700).cast("int"))).alias("last_modified_at"),
        pick(("unverified", "verified", "suspended"), "state").alias("state"),
        F.concat(F.lit("user"), d("mail", 1_000_000), F.lit("@example.com")).alias("email"),
        F.concat_ws("-", pick(LANGUAGES, "language"), pick(COUNTRIES, "country")).alias("locale"),
        F.when(d("display", 100) >= 50, F.concat(F.lit("User "), k)).alias("display_name"),
        F.when(d("icon", 100) >= 25, d("oid", 100_000)).alias("icon"),
    )
    first = users.groupBy("email").agg(F.min("id").alias("id"))
    return users.join(first, ["email", "id"], "left_semi")


def generate_addresses(users: DataFrame, seed: int = 42) -> DataFrame:
    """0 to 2 addresses for each user."""
    n = draw(f"{seed}:addresses", 3, F.col("id")).cast("int")
    rows = users.filter(n > 0).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), n)).alias("number"))
    keys = (F.col("user_id"), F.col("number"))
    return rows.select(
        "user_id",
        "number",
        F.when(draw(f"{seed}:type", 2, *keys) == 0, "billing").otherwise("delivery").alias("type"),
        F.concat(draw(f"{seed}:house", 999, *keys) + 1, F.lit(" Main Street")).alias("address1"),
        F.when(draw(f"{seed}:region", 100, *keys) >= 25, F.concat(F.lit("Region "), draw(f"{seed}:r", 50, *keys))).alias("region"),
        F.lpad(draw(f"{seed}:postal", 100_000, *keys).cast("string"), 5, "0").alias("postal_code"),
    )
