"""Queries of the merging and stitching operators (MRG), of dependency graphs (GRF) and of the global order (ORD)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merge as M
from ..operators.ordering import global_ordinal
from ..operators.scan import gathered_pieces
from ..plans.session import shared_folder, table
from ..sources.keyed_table import KeyedTable
from .pairs import SQL_PAIR, actual_orders, desired_orders, keyed_orders

KEY = ["o_orderkey"]
STORED_KEY = [*KEY, "copy"]


def _merged(prune: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ignored = actual_orders(spark, sf_dir).filter("o_orderkey % 77 = 0").select("o_orderkey")
        out = M.merge_update(actual_orders(spark, sf_dir), desired_orders(spark, sf_dir), KEY, prune, ignored)
        return out.select("o_orderkey", "o_totalprice", "o_orderstatus")

    return query


def _sql_merged(prune: bool) -> str:
    stale = "a.o_orderkey % 77 = 0" if prune else "true"
    return f"""WITH {SQL_PAIR}
SELECT o_orderkey, o_totalprice, o_orderstatus FROM desired WHERE o_orderkey % 77 <> 0 OR o_orderkey > 10000000 AND o_orderkey NOT IN (SELECT o_orderkey FROM actual WHERE o_orderkey % 77 = 0)
UNION ALL
SELECT o_orderkey, o_totalprice, o_orderstatus FROM actual a
WHERE {stale} AND o_orderkey NOT IN (SELECT o_orderkey FROM desired WHERE o_orderkey % 77 <> 0 OR o_orderkey > 10000000)"""


def mrg1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_counts(actual_orders(spark, sf_dir), desired_orders(spark, sf_dir), KEY, prune=True)


def mrg1_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after two merges of the same source, with what the second one wrote."""
    path = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    actual, desired = keyed_orders(spark, sf_dir)
    M.staged_merge(path, actual, STORED_KEY)
    M.staged_merge(path, desired, STORED_KEY, prune=True)
    again = M.staged_merge(path, desired, STORED_KEY, prune=True)
    return KeyedTable(spark, path).read().select(
        "o_orderkey", "o_totalprice", F.lit(again["written"] + again["pruned"]).alias("written"), F.lit(again["rewritten"]).alias("rewritten")
    )


def mrg1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is merged, dealt out anew and merged again, in small buckets that split: its rows in each version.
    The first version is read last, when the others are long there."""
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    stored = KeyedTable(spark, path)
    actual, desired = keyed_orders(spark, sf_dir)
    stored.create(actual.schema, STORED_KEY, buckets=4, split_rows=1000, by=KEY)
    even = desired.filter("o_orderkey % 2 = 0")
    states = [M.staged_merge(path, actual, STORED_KEY), M.staged_merge(path, even, STORED_KEY, buckets=16), M.staged_merge(path, desired, STORED_KEY, prune=True)]
    views = [stored.read(s["version"]).select("o_orderkey", "o_totalprice", F.lit(i).alias("step")) for i, s in enumerate(states)]
    return views[2].unionByName(views[1]).unionByName(views[0])


def mrg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    value = F.when(F.col("event_id") % 5 == 0, F.col("value"))
    patches = events.select("user_id", "event_id", kind.alias("event_type"), value.alias("value"))
    base = events.filter("user_id % 2 = 0").select("user_id").distinct()
    base = base.select("user_id", F.lit("base").alias("event_type"), F.lit(None).cast("double").alias("value"))
    return M.overlay_last_non_null(base, patches, ["user_id"], "event_id")


SQL_MRG2 = """
SELECT user_id, coalesce(max_by(event_type, event_id) FILTER (WHERE event_id % 3 <> 0), CASE WHEN user_id % 2 = 0 THEN 'base' END) AS event_type,
       max_by(value, event_id) FILTER (WHERE event_id % 5 = 0 AND value IS NOT NULL) AS value
FROM events GROUP BY user_id
"""


def mrg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    nested = M.attach_children(orders, lines, ["k"], ["l_linenumber", "l_partkey", "l_suppkey"], "lines")
    shown = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"]))
    return nested.select("k", F.array_join(shown, ",").alias("lines"))


SQL_MRG3 = """
SELECT o_orderkey AS k, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
"""


def mrg3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders in pieces of four; a customer without orders has one empty piece."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") - F.col("o_custkey") % 3).alias("k"), "o_orderkey", "o_orderstatus")
    nested = M.children_pieces(customers, orders, ["k"], ["o_orderkey"], "orders", size=4)
    shown = F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"]))
    return nested.select("k", F.col("piece").cast("long").alias("piece"), F.array_join(shown, ",").alias("orders"))


SQL_MRG3_PIECES = """
WITH o AS (SELECT o_custkey - o_custkey % 3 AS k, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey - o_custkey % 3 ORDER BY o_orderkey) AS n FROM orders)
SELECT c_custkey AS k, coalesce((n - 1) // 4 + 1, 1) AS piece, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY n), '') AS orders
FROM customer LEFT JOIN o ON k = c_custkey GROUP BY 1, 2
"""


def mrg3_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    return M.orphans(parents, lines, ["k"])


def mrg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3000).alias("ref"))
    customer = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0")
    supplier = table(spark, sf_dir, "supplier")
    return M.resolve_first_of(children, "ref", [("customer", customer, "c_custkey"), ("supplier", supplier, "s_suppkey")])


SQL_MRG4 = """
SELECT event_id, event_id % 3000 AS ref,
       CASE WHEN event_id % 3000 IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) THEN 'customer'
            WHEN event_id % 3000 IN (SELECT s_suppkey FROM supplier) THEN 'supplier' END AS resolved_from
FROM events
"""


def mrg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    objects = part.filter("p_partkey % 3 = 0").select("p_partkey", F.col("p_name").alias("full"), F.concat_ws("/", "p_brand", "p_size").alias("base"))
    refs = part.select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("full"), F.concat_ws("/", "p_brand", "p_size").alias("base"))
    return M.resolve_exact_else_unambiguous(refs, objects, "full", "base", "p_partkey").select("ref", "resolved")


SQL_MRG5 = """
WITH o AS (SELECT p_partkey, p_name AS f, p_brand || '/' || p_size AS b FROM part WHERE p_partkey % 3 = 0),
e AS (SELECT f, min(p_partkey) AS id FROM o GROUP BY 1),
u AS (SELECT b, min(p_partkey) AS id FROM o GROUP BY 1 HAVING count(*) = 1)
SELECT p.p_partkey AS ref, coalesce(e.id, u.id) AS resolved
FROM part p LEFT JOIN e ON e.f = p.p_name LEFT JOIN u ON u.b = p.p_brand || '/' || p.p_size
"""


def mrg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    folded = M.group_nested(rows, ["conv_id"], "turn", ["role"], "roles")
    return folded.select("conv_id", F.array_join("roles", ",").alias("roles"))


def mrg6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each type in pieces of 500, in order: how many, the first and last, and a digest of all."""
    e = table(spark, sf_dir, "events")
    folded = gathered_pieces(e, ["event_type"], [F.col("event_id")], [F.col("event_id"), F.col("user_id")], "events", 500)
    text = F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["event_id"], x["user_id"])), ",")
    ids = F.col("events.event_id")
    return folded.select("event_type", "piece", F.size(ids).cast("long").alias("n"), F.get(ids, F.lit(0)).alias("first"), F.element_at(ids, -1).alias("last"), F.md5(text).alias("digest"))


SQL_MRG6_PIECES = """
WITH e AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500 + 1 AS piece FROM events)
SELECT event_type, piece, count(*) AS n, min(event_id) AS "first", max(event_id) AS "last", md5(string_agg(event_id || ':' || user_id, ',' ORDER BY event_id)) AS digest
FROM e GROUP BY 1, 2
"""


def mrg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("label"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("own")).alias("origin"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("label"))
    on = F.col("c_nationkey") == F.col("_c_n_nationkey")
    return M.inject_defaults(c, nation, on, ["label", "origin"], {"label": F.lit("global"), "origin": F.lit("default")})


SQL_MRG7 = """
SELECT c_custkey, c_nationkey,
       coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'global') AS label,
       CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'default' END AS origin
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
"""


def mrg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    text = (
        F.when(id_ % 7 == 0, F.concat(F.lit('{"k":'), id_ % 100, F.lit(',"extra":1}')))
        .when(id_ % 7 == 1, F.lit('{"k":null}'))
        .when(id_ % 7 == 2, F.lit('{"k":"word"}'))
        .otherwise(F.concat(F.lit('{"k":'), id_ % 100, F.lit("}")))
    )
    return e.select("event_id", M.round_trip(text, "k INT", ["k"]).alias("kept"))


SQL_MRG8 = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN NULL ELSE '{"k":' || (event_id % 100) || '}' END AS kept
FROM events
"""


def mrg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    options = F.when(key % 3 == 0, F.create_map(F.lit("password"), F.lit("x"))).otherwise(
        F.create_map(F.lit("password"), F.lit("x"), F.lit("host"), F.col("c_name"))
    )
    kept = M.redact(options, ["password"])
    return c.select("c_custkey", kept["host"].alias("host"), kept.isNull().alias("is_null"))


def mrg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 41 == 0, F.concat("p_brand", F.lit("_2"))).otherwise(F.col("p_brand"))
    return M.number_duplicates(part.select("p_partkey", name.alias("name")), "name", ["p_partkey"])


SQL_MRG11 = """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 41 = 0 THEN p_brand || '_2' ELSE p_brand END AS name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS rn FROM p),
t AS (SELECT DISTINCT regexp_extract(name, '^(.*)_2$', 1) AS base FROM p WHERE regexp_matches(name, '_2$'))
SELECT p_partkey, name,
       CASE WHEN rn = 0 THEN name ELSE name || '_' || (CASE WHEN name IN (SELECT base FROM t) AND rn >= 2 THEN rn + 1 ELSE rn END) END AS unique_name
FROM r
"""


def mrg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    listed = part.filter("p_partkey % 10 = 0").select("p_partkey")
    return M.pattern_exclude(part, "p_brand", ["Brand#1?", "*5"], listed, "p_partkey").select("p_partkey", "p_brand")


def mrg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 6 == 0, F.lit('{"k": oops')).when(F.col("event_id") % 6 != 1, F.col("props"))
    good, bad = M.quarantine(e.select("event_id", text.alias("body")), "body", "k INT")
    ok = good.select("event_id", F.lit("good").alias("reason"), F.col("parsed.k").alias("k"))
    return ok.unionByName(bad.select("event_id", "reason", F.lit(None).cast("int").alias("k")))


SQL_MRG13 = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'malformed' WHEN 1 THEN 'missing' ELSE 'good' END AS reason,
       CASE WHEN event_id % 6 > 1 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k
FROM events
"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    up = F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3") - 1))
    return part.select(F.col("p_partkey").alias("child"), up.alias("ref")).filter("ref <> child").select(
        "child", F.lit("table").alias("kind"), F.concat(F.lit("test.p"), "ref").alias("name")
    )


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("table").alias("kind"), F.lit("test").alias("schema"), F.concat(F.lit("p"), "p_partkey").alias("name")
    )


SQL_EDGES = """
refs AS (SELECT p_partkey AS child, p_partkey // 2 AS ref FROM part UNION ALL SELECT p_partkey, p_partkey // 3 - 1 FROM part),
edges AS (SELECT DISTINCT child, ref AS parent FROM refs WHERE ref <> child AND ref IN (SELECT p_partkey FROM part))
"""


def grf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_edges(_refs(spark, sf_dir), _objects(spark, sf_dir))[0]


def grf1_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_edges(_refs(spark, sf_dir), _objects(spark, sf_dir))[1].select("child", "name")


def grf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys between order status groups stand for a catalog: each nation refers to nations of its region."""
    n = table(spark, sf_dir, "nation")
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND b.n_nationkey <= a.n_nationkey"))
    edges = G.derive_reference_edges(pairs.select(F.col("a.n_name").alias("child"), F.col("b.n_name").alias("parent")))
    return edges.select("child", F.array_join("parents", ",").alias("parents"))


SQL_GRF2 = """
SELECT a.n_name AS child, string_agg(DISTINCT b.n_name, ',' ORDER BY b.n_name) AS parents
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey < a.n_nationkey GROUP BY 1
"""


def grf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _objects(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "view").otherwise("table").alias("kind"), "name")
    edges = grf1(spark, sf_dir)
    ranks = spark.createDataFrame([("table", 1), ("view", 2)], "kind string, rank int")
    return G.dependency_order(objects, edges, ranks).select("id", "level", "position")


SQL_GRF3 = f"""
WITH RECURSIVE {SQL_EDGES},
walk AS (
  SELECT p_partkey AS id, 0 AS level FROM part
  UNION
  SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.id
),
lv AS (SELECT id, max(level) AS level FROM walk GROUP BY 1)
SELECT id, level, row_number() OVER (ORDER BY level, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END, 'p' || id, id) AS position FROM lv
"""


def ord1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return global_ordinal(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "ordinal")


QUERIES = {
    "mrg1_merge_update": _merged(False),
    "mrg1_merge_prune": _merged(True),
    "mrg1_merge_counts": mrg1_counts,
    "mrg1_staged_merge": mrg1_staged,
    "mrg1_table_versions": mrg1_versions,
    "mrg2_overlay_last_non_null": mrg2,
    "mrg3_attach_children": mrg3,
    "mrg3_children_pieces": mrg3_pieces,
    "mrg3_orphans": mrg3_orphans,
    "mrg4_resolve_first_of": mrg4,
    "mrg5_resolve_exact_else_unambiguous": mrg5,
    "mrg6_group_nested": mrg6,
    "mrg6_group_pieces": mrg6_pieces,
    "mrg7_inject_defaults": mrg7,
    "mrg8_round_trip": mrg8,
    "mrg9_redact": mrg9,
    "mrg11_number_duplicates": mrg11,
    "mrg12_pattern_exclude": mrg12,
    "mrg13_quarantine": mrg13,
    "grf1_resolve_edges": grf1,
    "grf1_missing_references": grf1_missing,
    "grf2_reference_edges": grf2,
    "grf3_dependency_order": grf3,
    "ord1_global_ordinal": ord1,
}
SQL = {
    "mrg1_merge_update": _sql_merged(False),
    "mrg1_merge_prune": _sql_merged(True),
    "mrg1_staged_merge": f"WITH {SQL_PAIR} SELECT o_orderkey, o_totalprice, 0 AS written, 0 AS rewritten FROM desired",
    "mrg1_merge_counts": f"""WITH {SQL_PAIR}
SELECT count(*) FILTER (WHERE d.o_orderkey IS NOT NULL AND (a.o_orderkey IS NULL OR a.o_totalprice <> d.o_totalprice)) AS written,
       count(*) FILTER (WHERE d.o_orderkey IS NULL) AS stale, count(*) FILTER (WHERE d.o_orderkey IS NULL) AS pruned
FROM desired d FULL OUTER JOIN actual a ON a.o_orderkey = d.o_orderkey""",
    "mrg1_table_versions": f"""WITH {SQL_PAIR}
SELECT o_orderkey, o_totalprice, 0 AS step FROM actual
UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM desired WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM actual WHERE o_orderkey NOT IN (SELECT o_orderkey FROM desired WHERE o_orderkey % 2 = 0)
UNION ALL SELECT o_orderkey, o_totalprice, 2 FROM desired""",
    "mrg2_overlay_last_non_null": SQL_MRG2,
    "mrg3_attach_children": SQL_MRG3,
    "mrg3_children_pieces": SQL_MRG3_PIECES,
    "mrg3_orphans": "SELECT l_orderkey AS k, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)",
    "mrg4_resolve_first_of": SQL_MRG4,
    "mrg5_resolve_exact_else_unambiguous": SQL_MRG5,
    "mrg6_group_pieces": SQL_MRG6_PIECES,
    "mrg6_group_nested": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1",
    "mrg7_inject_defaults": SQL_MRG7,
    "mrg8_round_trip": SQL_MRG8,
    "mrg9_redact": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS host, c_custkey % 3 = 0 AS is_null FROM customer",
    "mrg11_number_duplicates": SQL_MRG11,
    "mrg12_pattern_exclude": "SELECT p_partkey, p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#1.$') AND p_brand NOT LIKE '%5' AND p_partkey % 10 <> 0",
    "mrg13_quarantine": SQL_MRG13,
    "grf1_resolve_edges": f"WITH {SQL_EDGES} SELECT child, parent FROM edges",
    "grf1_missing_references": f"WITH {SQL_EDGES} SELECT child, 'test.p' || ref AS name FROM refs WHERE ref <> child AND ref NOT IN (SELECT p_partkey FROM part)",
    "grf2_reference_edges": SQL_GRF2,
    "grf3_dependency_order": SQL_GRF3,
    "ord1_global_ordinal": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders",
}
