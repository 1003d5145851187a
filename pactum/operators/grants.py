"""Grants, revocations and roles as data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .graph import reachable

# Privileges that each kind of object knows, and what an object of a section may be called.
LEGAL = {
    "columns": ("SELECT", "INSERT", "UPDATE", "REFERENCES"),
    "databases": ("CREATE", "CONNECT", "TEMPORARY"),
    "domains": ("USAGE",),
    "foreign_data_wrappers": ("USAGE",),
    "foreign_servers": ("USAGE",),
    "functions": ("EXECUTE",),
    "languages": ("USAGE",),
    "large_objects": ("SELECT", "UPDATE"),
    "schemata": ("CREATE", "USAGE"),
    "sequences": ("SELECT", "UPDATE", "USAGE"),
    "tables": ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER", "MAINTAIN"),
    "tablespaces": ("CREATE", "USAGE"),
    "types": ("USAGE",),
    "views": ("SELECT",),
}
_WORD, _DOTTED = r"[A-Za-z0-9_\-]+", r"[A-Za-z0-9_\-.]+"
NAMES = {
    "columns": rf"^{_WORD}\.{_WORD}\.{_WORD}$",
    "databases": r"^[A-Za-z_\-.]+$",
    "domains": rf"^{_WORD}\.{_WORD}$",
    "foreign_data_wrappers": rf"^{_DOTTED}$",
    "foreign_servers": rf"^{_DOTTED}$",
    "functions": rf"^{_WORD}\.{_WORD}\(.*\)$",
    "languages": rf"^{_DOTTED}$",
    "large_objects": r"^[0-9]+$",
    "schemata": rf"^{_WORD}$",
    "sequences": rf"^{_WORD}\.{_WORD}$",
    "tables": rf"^{_WORD}\.{_WORD}$",
    "tablespaces": rf"^{_WORD}$",
    "types": rf"^{_WORD}\.{_WORD}$",
    "views": rf"^{_WORD}\.{_WORD}$",
}
#: Other spellings of a privilege.
SAME = {"TEMP": "TEMPORARY", "ALL PRIVILEGES": "ALL"}
GRANTABLE = " WITH GRANT OPTION"


def plain_privilege(privilege: Column) -> Column:
    """A privilege without the grant marker, in its usual spelling."""
    bare = F.regexp_replace(privilege, f"{GRANTABLE}$", "")
    spelled = F.create_map(*(F.lit(x) for pair in SAME.items() for x in pair))
    return F.coalesce(spelled[bare], bare)


def explode_grants(statements: DataFrame) -> DataFrame:
    """Distinct (role, section, object, privilege). ``statements`` holds arrays roles, objects, privileges and columns
    (null: the whole object), section and grantable; a column privilege is of section columns and is keyed
    object.column; a grantable one carries the marker. Equal statements are one before they are taken apart."""
    lists = ("roles", "objects", "privileges", "columns")
    once = statements.select("section", "grantable", *(F.array_sort(F.array_distinct(c)).alias(c) for c in lists)).distinct()
    rows = (
        once.withColumn("role", F.explode("roles"))
        .withColumn("object", F.explode("objects"))
        .withColumn("privilege", F.explode("privileges"))
        .withColumn("column", F.explode_outer("columns"))
    )
    return rows.select(
        "role",
        F.when(F.col("column").isNull(), F.col("section")).otherwise("columns").alias("section"),
        F.concat_ws(".", "object", "column").alias("object"),
        F.when(F.col("grantable"), F.concat("privilege", F.lit(GRANTABLE))).otherwise(F.col("privilege")).alias("privilege"),
    ).distinct()


def cancel_pairs(entries: DataFrame, fields: Sequence[str], is_grant: str = "is_grant") -> DataFrame:
    """Entries without the revocations that a grant of the same batch equals in all ``fields``."""
    on = F.lit(True)
    granted = entries.filter(is_grant).select(*(F.col(f).alias(f"_g_{f}") for f in fields)).distinct()
    for f in fields:
        on = on & F.col(f).eqNullSafe(F.col(f"_g_{f}"))
    kept = entries.filter(~F.col(is_grant)).join(granted, on, "left_anti")
    return entries.filter(is_grant).unionByName(kept)


def aggregate_grants(entries: DataFrame) -> DataFrame:
    """(section, object, statements): an object's entries as an array of (is_grant, grantable, role, privilege),
    revocations first, sorted. ``entries``: role, section, object, privilege, is_grant."""
    marked = entries.withColumn("grantable", F.col("privilege").endswith(GRANTABLE)).withColumn(
        "privilege", F.regexp_replace("privilege", f"{GRANTABLE}$", "")
    )
    one = F.struct("is_grant", "grantable", "role", "privilege")
    return marked.groupBy("section", "object").agg(F.array_sort(F.collect_set(one)).alias("statements"))


def classify_roles(statements: DataFrame, reserved: str = "pg_") -> DataFrame:
    """(name, kind, created): one row per role that is not reserved; a role that may log in is a user; a role only
    met as a grantee is not created. ``statements``: name, login (boolean or null), creates."""
    return (
        statements.filter(~F.col("name").startswith(reserved))
        .groupBy("name")
        .agg(F.bool_or(F.coalesce("login", F.lit(False))).alias("_login"), F.bool_or("creates").alias("created"))
        .select("name", F.when(F.col("_login"), "user").otherwise("role").alias("kind"), "created")
    )


def membership_edges(statements: DataFrame) -> DataFrame:
    """Distinct (member, role) of the grants that no revocation takes back. ``statements``: arrays members and roles,
    is_grant."""
    pairs = statements.select("is_grant", F.explode("members").alias("member"), "roles").select(
        "is_grant", "member", F.explode("roles").alias("role")
    )
    revoked = pairs.filter("NOT is_grant").select("member", "role")
    return pairs.filter("is_grant").select("member", "role").distinct().join(revoked, ["member", "role"], "left_anti")


#: Memberships that are followed step by step; what lies further up is found by doubling.
STEPS = 64


def _sources(members: DataFrame, granted: DataFrame, steps: int = STEPS) -> DataFrame:
    """Distinct (role, source): the roles of ``granted`` (role) that each role has privileges from, itself included. Only
    pairs that end at such a role are made, a round for each membership on the way."""
    edges = materialize(members.select(F.col("member").alias("_member"), F.col("role").alias("_role")).dropna().distinct(), "members")
    total = fresh = materialize(granted.select("role", F.col("role").alias("source")).dropna().distinct(), "sources")
    found = [total]
    for _ in range(steps):
        below = fresh.join(edges.hint("merge"), F.col("role") == F.col("_role")).select(F.col("_member").alias("role"), "source").distinct()
        fresh = materialize(below.join(total.hint("merge"), ["role", "source"], "left_anti"), "sources")
        if fresh.isEmpty():
            return total
        found.append(fresh)
        total = reduce(DataFrame.unionByName, found)
    through = reachable(edges.select(F.col("_member").alias("src"), F.col("_role").alias("dst")))
    beyond = fresh.join(through.hint("merge"), F.col("role") == F.col("dst")).select(F.col("src").alias("role"), "source")
    return materialize(total.unionByName(beyond).distinct(), "sources")


def effective_lists(grants: DataFrame, revocations: DataFrame, members: DataFrame, steps: int = STEPS) -> DataFrame:
    """(role, section, object, privileges): what each role ends up with, as a sorted array. ALL is expanded to the
    section's list, revocations are taken away, and what a role has its members inherit, through any number of
    memberships. The privileges of a role on an object travel as one mask over the section's list; null is no role.

    Roles that have their privileges from the same roles are one class, told by the number of those and 128 bits of
    hashes; masks are put together once for each class and then given to its roles."""
    order = [(s, p, 1 << i) for s, ps in LEGAL.items() for i, p in enumerate(ps)]
    legal = F.broadcast(grants.sparkSession.createDataFrame(order, "section string, legal string, bit int"))
    listed = [(s, [(p, 1 << i) for i, p in sorted(enumerate(ps), key=lambda x: x[1])]) for s, ps in LEGAL.items()]
    lists = F.broadcast(grants.sparkSession.createDataFrame(listed, "section string, _list array<struct<p: string, bit: int>>"))
    key = ["role", "section", "object"]

    def masks(df: DataFrame, name: str) -> DataFrame:
        plain = plain_privilege(F.col("privilege"))
        return df.join(legal, "section").filter((plain == "ALL") | (plain == F.col("legal"))).groupBy(*key).agg(F.bit_or("bit").alias(name))

    own = masks(grants, "mask").join(masks(revocations, "taken"), key, "left")
    own = materialize(own.select(*key, F.expr("mask & ~coalesce(taken, 0)").alias("mask")).filter("mask <> 0"), "own")
    sources = _sources(members, own, steps)
    kind = F.struct(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(x), "source")).alias(f"h{x}") for x in (1, 2)))
    classes = materialize(sources.groupBy("role").agg(kind.alias("_class")), "classes")
    shown = classes.groupBy("_class").agg(F.min("role").alias("role"))
    parts = shown.join(sources.hint("merge"), "role").select("_class", "source").join(own.withColumnRenamed("role", "source").hint("merge"), "source")
    held = parts.groupBy("_class", "section", "object").agg(F.bit_or("mask").alias("mask")).join(lists, "section")
    names = F.transform(F.filter("_list", lambda x: F.col("mask").bitwiseAND(x["bit"]) != 0), lambda x: x["p"])
    held = materialize(held.select("_class", "section", "object", names.alias("privileges")), "held")
    return classes.join(held.hint("merge"), "_class").select(*key, "privileges")


def effective_privileges(grants: DataFrame, revocations: DataFrame, members: DataFrame) -> DataFrame:
    """(role, section, object, privilege): ``effective_lists``, a row for each privilege."""
    return effective_lists(grants, revocations, members).withColumn("privilege", F.explode("privileges")).drop("privileges")


def privilege_violations(entries: DataFrame) -> DataFrame:
    """Entries (role, section, object, privilege) that break a rule, with ``rule``: section, privilege or name."""
    known = F.broadcast(
        entries.sparkSession.createDataFrame(
            [(s, list(ps), NAMES.get(s)) for s, ps in LEGAL.items()], "section string, legal array<string>, name string"
        )
    )
    joined = entries.join(known, "section", "left")
    plain = plain_privilege(F.col("privilege"))
    rule = (
        F.when(F.col("legal").isNull(), "section")
        .when(~(F.array_contains("legal", plain) | (plain == "ALL")), "privilege")
        .when(F.col("name").isNotNull() & ~F.regexp_like(F.col("object"), F.col("name")), "name")
    )
    return joined.withColumn("rule", rule).filter("rule IS NOT NULL").drop("legal", "name")


def readable_columns(columns: Sequence[str], table: str, privileges: Iterable[tuple[str, str, str]]) -> list[str]:
    """The columns of ``table`` on which (section, object, privilege) entries give SELECT, in table order."""
    entries = set(privileges)
    if ("tables", table, "SELECT") in entries:
        return list(columns)
    return [c for c in columns if ("columns", f"{table}.{c}", "SELECT") in entries]


def project_for_role(df: DataFrame, table: str, privileges: DataFrame, role: str) -> DataFrame:
    """``df`` with only the columns the role may read. The driver reads that role's entries for this one table."""
    own = privileges.filter(
        (F.col("role") == role)
        & (F.col("privilege") == "SELECT")
        & (F.col("object").isin([table, *(f"{table}.{c}" for c in df.columns)]))
    )
    found = [(r["section"], r["object"], r["privilege"]) for r in own.select("section", "object", "privilege").distinct().collect()]
    return df.select(*readable_columns(df.columns, table, found))


def grant_marker(privilege: Column, grantable: Column) -> Column:
    return F.when(grantable, F.concat(privilege, F.lit(GRANTABLE))).otherwise(privilege)
