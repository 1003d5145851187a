"""Queries of the row, set and document rules (CON) and of grants and roles (ACL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import grants as A
from ..operators import references as R
from ..plans.session import table


def con1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    body = (
        F.when(id_ % 10 == 0, F.concat(F.lit('{"k":"x'), id_ % 7, F.lit('"}')))
        .when(id_ % 10 == 1, F.lit("{}"))
        .when(id_ % 10 == 2, F.concat(F.lit('{"k":'), id_ % 200, F.lit(',"Extra":1}')))
        .when(id_ % 10 == 3, F.lit("not json"))
        .when(id_ % 10 == 4, F.lit('{"k":5,"a":1,"b":2,"tags":["x","x"]}'))
        .when(id_ % 10 == 5, F.concat(F.lit('{"k":7,"a":1,"mode":"'), F.col("event_type"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"k":'), id_ % 120, F.lit(',"b":1,"name":"'), F.col("event_type"), F.lit('"}')))
    )
    contract = C.DocumentContract(
        fields={
            "k": C.Field(kind="integer", required=True, minimum=0, maximum=100),
            "a": C.Field(kind="integer"),
            "b": C.Field(kind="integer"),
            "mode": C.Field(enum=("click", "view")),
            "name": C.Field(pattern="^[a-z]+$", min_length=4, max_length=8),
            "tags": C.Field(kind="array", min_items=3, unique_items=True),
        },
        closed=True,
        key_pattern="^[a-z]+$",
        one_of=(("a", "b"),),
        not_together=(("a", "b"),),
        if_then=(("a", "mode"),),
    )
    return C.document_violations(e.select("event_id", body.alias("body")), ["event_id"], "body", contract)


SQL_CON1 = """
WITH e AS (SELECT event_id, event_type, event_id % 10 AS m FROM events)
SELECT event_id, 'k' AS path, 'type' AS rule FROM e WHERE m = 0
UNION ALL SELECT event_id, 'k', 'required' FROM e WHERE m = 1
UNION ALL SELECT event_id, 'k', 'maximum' FROM e WHERE m = 2 AND event_id % 200 > 100 OR m > 5 AND event_id % 120 > 100
UNION ALL SELECT event_id, '', 'closed' FROM e WHERE m = 2
UNION ALL SELECT event_id, '', 'key_pattern' FROM e WHERE m = 2
UNION ALL SELECT event_id, '', 'type' FROM e WHERE m = 3
UNION ALL SELECT event_id, 'tags', 'min_items' FROM e WHERE m = 4
UNION ALL SELECT event_id, 'tags', 'unique_items' FROM e WHERE m = 4
UNION ALL SELECT event_id, 'a&b', 'not' FROM e WHERE m = 4
UNION ALL SELECT event_id, 'a->mode', 'if_then' FROM e WHERE m = 4
UNION ALL SELECT event_id, 'a|b', 'one_of' FROM e WHERE m IN (0, 1, 2, 4)
UNION ALL SELECT event_id, 'mode', 'enum' FROM e WHERE m = 5 AND event_type NOT IN ('click', 'view')
UNION ALL SELECT event_id, 'name', 'pattern' FROM e WHERE m > 5 AND NOT regexp_matches(event_type, '^[a-z]+$')
UNION ALL SELECT event_id, 'name', 'min_length' FROM e WHERE m > 5 AND length(event_type) < 4
UNION ALL SELECT event_id, 'name', 'max_length' FROM e WHERE m > 5 AND length(event_type) > 8
"""


def con1_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted numbers and booleans, numbers for strings, keys with dots, nested objects and arrays."""
    e = table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    kinds = ['{"k":"5"}', '{"k":1,"s":7}', '{"k":1,"b":"true"}', '{"k":1,"a.b":{"c":"x"}}', '{"k":1,"o":{"tags":[1,"x",2,"y"]}}']
    kinds += ['{"k":1.0,"s":"7","b":true,"o":{"z":1}}', '{"k":1.5}', '{"k":1,"o":[]}']
    body = F.when(id_ % 10 == 9, F.concat(F.lit('{"k":'), id_ % 200, F.lit("}")))
    for i, text in enumerate(kinds):
        body = body.when(id_ % 10 == i, F.lit(text))
    contract = C.DocumentContract(
        fields={
            "k": C.Field(kind="integer", required=True, maximum=100),
            "s": C.Field(),
            "b": C.Field(kind="boolean"),
            "a.b": C.Field(kind="object", fields=C.DocumentContract(fields={"c": C.Field(kind="number")})),
            "o": C.Field(
                kind="object",
                fields=C.DocumentContract(fields={"tags": C.Field(kind="array", items=C.Field(kind="integer"))}, closed=True),
            ),
        }
    )
    return C.document_violations(e.select("event_id", body.alias("body")), ["event_id"], "body", contract)


SQL_CON1_NESTED = """
SELECT event_id, path, rule FROM events JOIN (VALUES (0, 'k', 'type'), (1, 's', 'type'), (2, 'b', 'type'), (3, 'a.b.c', 'type'), (4, 'o.tags[]', 'type'),
  (5, 'o', 'closed'), (6, 'k', 'type'), (7, 'o', 'type'), (8, '', 'type'), (9, 'k', 'maximum')) v(m, path, rule) ON event_id % 10 = m
WHERE m <> 9 OR event_id % 200 > 100
"""


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls put in by modulus."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 17 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 19 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
    )


SQL_HOLED = """
holed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS o_custkey,
                 CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM orders)"""


def con2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.violations(_holed(spark, sf_dir), C.not_null("o_custkey", "o_orderstatus")).select("o_orderkey", "rule")


def con3(spark: SparkSession, sf_dir: str) -> DataFrame:
    discount = F.when(F.col("l_linenumber") != 3, F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem").withColumn("l_discount", discount)
    rules = [C.check("small_discount", "l_discount <= 0.05")]
    return C.violations(lines, rules).select("l_orderkey", "l_linenumber", "l_partkey", "rule")


def con4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")))
    return C.check_unique(lines, ["l_orderkey", "l_linenumber"])


def con5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.when(F.col("l_partkey") % 50 != 0, F.col("l_linenumber")))
    return C.check_primary_key(lines, ["l_orderkey", "l_linenumber"])


def con6(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.lower(F.substring("c_name", 1, 15)).alias("stem")
    return C.check_unique(table(spark, sf_dir, "customer"), [stem], where="c_acctbal > 0")


def _con7(match: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parents = table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0")
        # A composite key: customer and a second column that is null on other rows.
        child = _holed(spark, sf_dir).withColumn("second", F.when(F.col("o_orderkey") % 23 != 0, F.lit(1)))
        child = child.withColumn("second", F.when(F.col("o_orderkey") % 34 == 0, F.lit(None)).otherwise(F.col("second")))
        there = parents.select("c_custkey", F.lit(1).alias("one"))
        return C.check_foreign_key(child, ["o_custkey", "second"], there, ["c_custkey", "one"], match).select("o_orderkey", "o_custkey", "second")

    return query


SQL_CON7 = f"""
WITH {SQL_HOLED},
c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 34 <> 0 THEN 1 END AS second FROM holed)
SELECT o_orderkey, o_custkey, second FROM c
WHERE o_custkey IS NOT NULL AND second IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)
"""


def con8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers % 9 = 0 are deleted and % 10 = 1 get new keys, under each action."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    deleted = customer.filter("c_custkey % 9 = 0")
    updated = customer.filter("c_custkey % 10 = 1 AND c_custkey % 9 <> 0").withColumn("new_key", F.col("c_custkey") + 1000000)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    out = None
    for action in ("NO ACTION", "CASCADE", "SET NULL", "SET DEFAULT"):
        one = C.propagate_parent_change(orders, "o_custkey", deleted, updated, "c_custkey", action, action, default=F.lit(-1), nullable=action != "SET NULL")
        one = one.withColumn("action", F.lit(action))
        out = one if out is None else out.unionByName(one)
    return out.filter("outcome <> 'kept'")


SQL_CON8 = """
WITH a(action) AS (VALUES ('NO ACTION'), ('CASCADE'), ('SET NULL'), ('SET DEFAULT')),
o AS (SELECT o_orderkey, o_custkey, o_custkey % 9 = 0 AS gone FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 10 = 1))
SELECT o_orderkey,
       CASE action WHEN 'NO ACTION' THEN o_custkey WHEN 'SET NULL' THEN NULL WHEN 'SET DEFAULT' THEN -1
                   ELSE CASE WHEN gone THEN o_custkey ELSE o_custkey + 1000000 END END AS o_custkey,
       CASE action WHEN 'NO ACTION' THEN 'violation' WHEN 'SET NULL' THEN 'violation' WHEN 'SET DEFAULT' THEN 'updated'
                   ELSE CASE WHEN gone THEN 'deleted' ELSE 'updated' END END AS outcome, action
FROM o CROSS JOIN a
"""


def con8_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers % 9 = 0 are deleted; their orders go with them, and those orders' lines; lines of other orders stay."""
    deleted = table(spark, sf_dir, "customer").select("c_custkey").filter("c_custkey % 9 = 0")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    chain = [
        C.Reference("orders", orders, "o_custkey", "o_orderkey", on_delete="CASCADE"),
        C.Reference("lineitem", lines, "l_orderkey", "l_orderkey", on_delete="CASCADE"),
    ]
    reports = C.propagate_chain(deleted, None, "c_custkey", chain)
    lost = [r.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(name)) for name, r in reports.items()]
    return lost[0].unionByName(lost[1])


SQL_CON8_CHAIN = """
SELECT CASE WHEN o_custkey % 9 = 0 AND c_custkey IS NOT NULL THEN 'deleted' ELSE 'kept' END AS outcome, count(*) AS n, 'orders' AS level
FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1
UNION ALL
SELECT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 9 = 0) THEN 'deleted' ELSE 'kept' END,
       count(*), 'lineitem' FROM lineitem GROUP BY 1
"""


def con8_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement deletes customers, suppliers and parts. Customers go with the one who referred them (key / 4), orders
    with their customer and lines with their order; lines lose a supplier, and must not lose a part unless they go."""
    key = F.col("c_custkey")
    referred = F.when(key >= 4, F.floor(key / 4).cast("bigint"))
    tables = {
        "customer": R.Table(table(spark, sf_dir, "customer").select(key.cast("bigint").alias("c_custkey"), referred.alias("referrer")), "c_custkey"),
        "orders": R.Table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"),
        "supplier": R.Table(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey"),
        "part": R.Table(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey"),
        "lineitem": R.Table(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
    }
    links = [
        R.Link("customer", "referrer", "customer", "CASCADE"),
        R.Link("orders", "o_custkey", "customer", "CASCADE"),
        R.Link("lineitem", "l_orderkey", "orders", "CASCADE"),
        R.Link("lineitem", "l_suppkey", "supplier", "SET NULL"),
        R.Link("lineitem", "l_partkey", "part"),
    ]
    deleted = {
        "customer": tables["customer"].rows.select("c_custkey").filter("c_custkey % 97 = 5"),
        "supplier": tables["supplier"].rows.filter("s_suppkey % 11 = 0"),
        "part": tables["part"].rows.filter("p_partkey % 40 = 0"),
    }
    reports = R.propagate_deletes(tables, links, deleted)
    null = {"customer": "referrer", "orders": "o_custkey", "supplier": "s_suppkey", "part": "p_partkey", "lineitem": "l_suppkey"}
    counts = [
        r.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(null[n]).isNull()).alias("nulls")).withColumn("name", F.lit(n))
        for n, r in reports.items()
    ]
    return reduce(DataFrame.unionByName, counts)


SQL_CON8_BRANCHES = """
WITH RECURSIVE g AS (
  SELECT c_custkey FROM customer WHERE c_custkey % 97 = 5
  UNION SELECT c.c_custkey FROM g JOIN customer c ON c.c_custkey >= 4 AND c.c_custkey // 4 = g.c_custkey
), o AS (SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM g) AS gone FROM orders),
l AS (
  SELECT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM o WHERE gone) THEN 'deleted'
              WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 40 = 0) THEN 'violation'
              WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 = 0) THEN 'updated' ELSE 'kept' END AS outcome
  FROM lineitem
)
SELECT 'customer' AS name, CASE WHEN c_custkey IN (SELECT c_custkey FROM g) THEN 'deleted' ELSE 'kept' END AS outcome,
       count(*) AS n, count(*) FILTER (WHERE c_custkey < 4) AS nulls FROM customer GROUP BY 2
UNION ALL SELECT 'orders', CASE WHEN gone THEN 'deleted' ELSE 'kept' END, count(*), 0 FROM o GROUP BY 2
UNION ALL SELECT 'supplier', CASE WHEN s_suppkey % 11 = 0 THEN 'deleted' ELSE 'kept' END, count(*), 0 FROM supplier GROUP BY 2
UNION ALL SELECT 'part', CASE WHEN p_partkey % 40 = 0 THEN 'deleted' ELSE 'kept' END, count(*), 0 FROM part GROUP BY 2
UNION ALL SELECT 'lineitem', outcome, count(*), CASE WHEN outcome = 'updated' THEN count(*) ELSE 0 END FROM l GROUP BY 2
"""


def con9(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    email = F.when(k % 5 == 0, F.concat(F.lit("user"), k)).when(k % 7 != 0, F.concat(F.lit("user"), k, F.lit("@example.com")))
    locale = F.when(k % 3 == 0, F.lit("en_US")).otherwise(F.lit("en-US"))
    age = F.when(k % 11 == 0, F.lit("many")).otherwise((k % 150).cast("string"))
    rows = c.select("c_custkey", email.alias("email"), locale.alias("locale"), age.alias("age"))
    rules = [
        *C.domain("email", "string", pattern="^[^@]+@[^@]+$", nullable=False),
        *C.domain("locale", "string", pattern="^[a-z]{2}-[A-Z]{2,3}$"),
        *C.domain("age", "int", checks=("value < 120",)),
    ]
    return C.violations(rows, rules).select("c_custkey", "rule")


SQL_CON9 = """
SELECT c_custkey, 'domain_null:email' AS rule FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'domain_pattern:email' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'domain_pattern:locale' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'domain_type:age' FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, 'domain_check0:age' FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 150 >= 120
"""

LABELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


def con10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    bad = C.enum("o_orderpriority", LABELS).broken()
    return o.groupBy("o_orderpriority").agg(
        F.max(C.enum_ordinal(F.col("o_orderpriority"), LABELS)).cast("int").alias("ordinal"), F.count_if(bad).alias("violations")
    )


def _line_rules() -> list[C.Rule]:
    return [
        *C.not_null("l_orderkey", "l_shipdate"),
        C.check("discount", "l_discount <= 0.08"),
        C.check("quantity", "l_quantity between 1 and 45"),
        C.check("tax", "l_tax < 0.08"),
        C.check("price", "l_extendedprice / l_quantity < 2000"),
        C.enum("l_returnflag", ["A", "N"]),
        C.check("line", "l_linenumber < 7"),
    ]


def con11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rule_counts(table(spark, sf_dir, "lineitem"), _line_rules())


def con11_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules and unique, primary and foreign keys of one table in one report."""
    parents = table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select("c_custkey")
    return C.contract_report(
        _holed(spark, sf_dir),
        rules=[*C.not_null("o_custkey"), C.check("cheap", "o_totalprice < 100000")],
        unique={"unique:customer": ["o_custkey"]},
        primary=["o_custkey", "o_orderstatus"],
        foreign={"customer": (["o_custkey"], parents, ["c_custkey"], "SIMPLE")},
    )


SQL_CON11_SETS = f"""
WITH {SQL_HOLED}
SELECT 'not_null:o_custkey' AS rule, count(*) AS n FROM holed WHERE o_custkey IS NULL
UNION ALL SELECT 'cheap', count(*) FROM holed WHERE NOT o_totalprice < 100000
UNION ALL SELECT 'unique:customer', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM holed WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1)
UNION ALL SELECT 'primary_key', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT o_custkey IS NULL OR o_orderstatus IS NULL AS null_key, count(*) AS n FROM holed GROUP BY o_custkey, o_orderstatus HAVING null_key OR count(*) > 1)
UNION ALL SELECT 'customer', count(*) FROM holed WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)
"""


def con11_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = C.quarantined(table(spark, sf_dir, "lineitem"), _line_rules())[1]
    return bad.groupBy(F.array_join("failed", ",").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


SQL_LINE_RULES = """
WITH r AS (SELECT l_orderkey IS NULL AS r0, l_shipdate IS NULL AS r1, NOT l_discount <= 0.08 AS r2, NOT l_quantity BETWEEN 1 AND 45 AS r3,
                  NOT l_tax < 0.08 AS r4, NOT l_extendedprice / l_quantity < 2000 AS r5, l_returnflag NOT IN ('A', 'N') AS r6, NOT l_linenumber < 7 AS r7 FROM lineitem)
"""
RULE_NAMES = ["not_null:l_orderkey", "not_null:l_shipdate", "discount", "quantity", "tax", "price", "enum:l_returnflag", "line"]


def con12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    text = F.when(k % 8 == 0, F.lit("n/a")).when(k % 8 == 1, F.lit(None)).otherwise((k * 10).cast("string"))
    audited = C.cast_audit(e.select("event_id", text.alias("raw")), "raw", "int")
    seconds = C.cast_audit(audited.withColumn("epoch", F.col("cast_value")).drop("cast_value", "cast_failed"), "epoch", "timestamp", F.timestamp_seconds("epoch"))
    return seconds.select(
        "event_id", "epoch", F.date_format("cast_value", "yyyy-MM-dd HH:mm:ss").alias("at"),
        (F.col("raw").isNotNull() & F.col("epoch").isNull()).alias("failed"),
    )


SQL_CON12 = """
SELECT event_id, CASE WHEN event_id % 8 > 1 THEN CAST(event_id * 10 AS INTEGER) END AS epoch,
       CASE WHEN event_id % 8 > 1 THEN strftime(TIMESTAMP '1970-01-01' + to_seconds(event_id * 10), '%Y-%m-%d %H:%M:%S') END AS at,
       event_id % 8 = 0 AS failed
FROM events
"""


def con13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.encodable(F.col("text"), "LATIN1").alias("latin1"), C.encodable(F.col("text"), "ASCII").alias("ascii"))


# Grants ------------------------------------------------------------------------------------------------------


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grant statements built from customers: roles by customer, objects by nation."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        F.array(F.concat(F.lit("r"), k % 40), F.concat(F.lit("r"), k % 7)).alias("roles"),
        F.lit("tables").alias("section"),
        F.array(F.concat(F.lit("test."), F.lower(F.regexp_replace("n_name", " ", "_")))).alias("objects"),
        F.when(k % 6 == 0, F.array(F.lit("ALL"))).otherwise(F.array(F.lit("SELECT"), F.lit("UPDATE"))).alias("privileges"),
        F.when(k % 4 == 0, F.array(F.lit("id"), F.lit("name"))).alias("columns"),
        (k % 10 == 0).alias("grantable"),
    )


SQL_GRANTS = """
s AS (SELECT c_custkey AS k, 'test.' || lower(replace(n_name, ' ', '_')) AS obj FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (
  SELECT DISTINCT role, CASE WHEN col IS NULL THEN 'tables' ELSE 'columns' END AS section, obj || CASE WHEN col IS NULL THEN '' ELSE '.' || col END AS object,
         priv || CASE WHEN k % 10 = 0 THEN ' WITH GRANT OPTION' ELSE '' END AS privilege
  FROM (SELECT k, obj, role, unnest(CASE WHEN k % 6 = 0 THEN ['ALL'] ELSE ['SELECT', 'UPDATE'] END) AS priv, col
        FROM (SELECT k, obj, role, unnest(CASE WHEN k % 4 = 0 THEN ['id', 'name'] ELSE [NULL] END) AS col
              FROM (SELECT k, obj, unnest(['r' || (k % 40), 'r' || (k % 7)]) AS role FROM s)))
)"""


def acl1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.explode_grants(_statements(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        (F.col("event_id") % 20).alias("batch"),
        F.concat(F.lit("r"), F.col("user_id") % 10).alias("role"),
        F.lit("tables").alias("section"),
        F.concat(F.lit("test."), "event_type").alias("object"),
        F.when(F.col("event_id") % 4 == 0, "SELECT WITH GRANT OPTION").otherwise("SELECT").alias("privilege"),
        (F.col("event_id") % 3 != 0).alias("is_grant"),
    )


SQL_ENTRIES = """
x AS (SELECT event_id, event_id % 20 AS batch, 'r' || (user_id % 10) AS role, 'tables' AS section, 'test.' || event_type AS object,
             CASE WHEN event_id % 4 = 0 THEN 'SELECT WITH GRANT OPTION' ELSE 'SELECT' END AS privilege, event_id % 3 <> 0 AS is_grant FROM events)"""


def acl2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cancel_pairs(_entries(spark, sf_dir), ["batch", "role", "section", "object", "privilege"]).select("event_id", "is_grant")


def acl3(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = A.aggregate_grants(_entries(spark, sf_dir).drop("event_id", "batch"))
    shown = F.transform("statements", lambda s: F.concat_ws(":", s["is_grant"].cast("string"), s["grantable"].cast("string"), s["role"], s["privilege"]))
    return grouped.select("section", "object", F.array_join(shown, ",").alias("statements"))


def acl4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("pg_"), k)).otherwise(F.concat(F.lit("role"), k % 30))
    return A.classify_roles(s.select(name.alias("name"), F.when(k % 4 != 0, F.col("s_acctbal") > 5000).alias("login"), (k % 3 == 0).alias("creates")))


SQL_ACL4 = """
SELECT 'role' || (s_suppkey % 30) AS name, CASE WHEN bool_or(s_suppkey % 4 <> 0 AND s_acctbal > 5000) THEN 'user' ELSE 'role' END AS kind,
       bool_or(s_suppkey % 3 = 0) AS created
FROM supplier WHERE s_suppkey % 10 <> 0 GROUP BY 1
"""


def _memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a member of those with a half and a third of its key; some of the first are taken back."""
    own = F.array(F.concat(F.lit("r"), "c_custkey")).alias("members")
    up = [F.concat(F.lit("r"), F.expr(f"c_custkey div {n}")) for n in (2, 3)]
    c = table(spark, sf_dir, "customer")
    granted = c.select(own, F.array(*up).alias("roles"), F.lit(True).alias("is_grant"))
    return granted.union(c.filter("c_custkey % 50 = 7").select(own, F.array(up[0]), F.lit(False)))


SQL_MEMBERS = """
m AS (SELECT DISTINCT 'r' || c_custkey AS member, 'r' || b AS role FROM (SELECT c_custkey, unnest([c_custkey // 2, c_custkey // 3]) AS b FROM customer)
      EXCEPT SELECT 'r' || c_custkey, 'r' || (c_custkey // 2) FROM customer WHERE c_custkey % 50 = 7)"""


def acl5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.membership_edges(_memberships(spark, sf_dir))


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("privilege", f"{A.GRANTABLE}$", "")
    grants = acl1(spark, sf_dir).withColumn("privilege", plain).distinct()
    revoked = grants.filter(F.col("role").isin("r3", "r5") & (F.col("section") == "tables")).withColumn("privilege", F.lit("UPDATE")).distinct()
    held = A.effective_lists(grants, revoked, acl5(spark, sf_dir))
    return held.select("role", "section", "object", F.array_join("privileges", ",").alias("privileges"))


SQL_EFFECTIVE = f"""
WITH RECURSIVE {SQL_GRANTS}, {SQL_MEMBERS},
legal(section, p) AS (VALUES ('tables','SELECT'),('tables','INSERT'),('tables','UPDATE'),('tables','DELETE'),('tables','TRUNCATE'),('tables','REFERENCES'),
  ('tables','TRIGGER'),('tables','MAINTAIN'),('columns','SELECT'),('columns','INSERT'),('columns','UPDATE'),('columns','REFERENCES')),
own AS (
  SELECT DISTINCT role, g.section, object, p AS privilege FROM g JOIN legal l ON l.section = g.section
    AND (replace(privilege, ' WITH GRANT OPTION', '') = 'ALL' OR replace(privilege, ' WITH GRANT OPTION', '') = p)
  WHERE NOT (role IN ('r3', 'r5') AND g.section = 'tables' AND p = 'UPDATE')
),
closure AS (SELECT member, role FROM m UNION SELECT c.member, m.role FROM closure c JOIN m ON m.member = c.role)
SELECT role, section, object, string_agg(privilege, ',' ORDER BY privilege) AS privileges FROM (
  SELECT role, section, object, privilege FROM own
  UNION SELECT c.member, o.section, o.object, o.privilege FROM own o JOIN closure c ON c.role = o.role
) GROUP BY 1, 2, 3
"""


def acl7(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("r"), k % 5).alias("role"),
        F.when(k % 9 == 0, "tabels").when(k % 4 == 1, "schemata").otherwise("tables").alias("section"),
        F.when(k % 4 == 1, F.lit("test")).when(k % 7 == 0, F.lit("bad name")).otherwise(F.lit("test.users")).alias("object"),
        F.when(k % 5 == 0, "EXECUTE").when(k % 4 == 1, "USAGE").otherwise("SELECT").alias("privilege"),
    )
    return A.privilege_violations(e).select("event_id", "rule")


SQL_ACL7 = """
SELECT * FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'section' WHEN event_id % 5 = 0 THEN 'privilege'
                                     WHEN event_id % 4 <> 1 AND event_id % 7 = 0 THEN 'name' END AS rule FROM events) WHERE rule IS NOT NULL
"""


def acl8(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    granted = [("reader", "columns", f"test.customer.{c}", "SELECT") for c in customer.columns if c != "c_acctbal"]
    privileges = spark.createDataFrame(granted, "role string, section string, object string, privilege string")
    return A.project_for_role(customer, "test.customer", privileges, "reader")


QUERIES = {
    "con1_validate_documents": con1,
    "con1_validate_nested": con1_nested,
    "con2_not_null": con2,
    "con3_check_expression": con3,
    "con4_unique": con4,
    "con5_primary_key": con5,
    "con6_unique_index": con6,
    "con7_foreign_key_simple": _con7("SIMPLE"),
    "con7_foreign_key_full": _con7("FULL"),
    "con8_propagate_parent_change": con8,
    "con8_propagate_chain": con8_chain,
    "con8_propagate_branches": con8_branches,
    "con9_domain": con9,
    "con10_enum": con10,
    "con11_contract_report": con11,
    "con11_set_rules": con11_sets,
    "con11_quarantine": con11_quarantine,
    "con12_checked_cast": con12,
    "con13_encodable": con13,
    "acl1_explode_grants": acl1,
    "acl2_cancel_pairs": acl2,
    "acl3_aggregate_grants": acl3,
    "acl4_classify_roles": acl4,
    "acl5_membership_edges": acl5,
    "acl6_effective_privileges": _effective,
    "acl7_privilege_domain": acl7,
    "acl8_project_for_role": acl8,
}
SQL = {
    "con1_validate_documents": SQL_CON1,
    "con2_not_null": f"WITH {SQL_HOLED} SELECT o_orderkey, 'not_null:o_custkey' AS rule FROM holed WHERE o_custkey IS NULL UNION ALL SELECT o_orderkey, 'not_null:o_orderstatus' FROM holed WHERE o_orderstatus IS NULL",
    "con3_check_expression": "SELECT l_orderkey, l_linenumber, l_partkey, 'small_discount' AS rule FROM lineitem WHERE l_linenumber <> 3 AND l_discount > 0.05",
    "con4_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2 HAVING count(*) > 1",
    "con5_primary_key": """WITH g AS (SELECT l_orderkey, CASE WHEN l_partkey % 50 <> 0 THEN l_linenumber END AS l, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(CASE WHEN l IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_rows, count(*) FILTER (WHERE l IS NOT NULL AND n > 1) AS duplicate_keys,
       CAST(sum(CASE WHEN l IS NOT NULL THEN n - 1 ELSE 0 END) AS BIGINT) AS surplus_rows FROM g""",
    "con6_unique_index": "SELECT lower(substr(c_name, 1, 15)) AS stem, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 1",
    "con7_foreign_key_simple": SQL_CON7,
    "con7_foreign_key_full": SQL_CON7 + "UNION ALL SELECT o_orderkey, o_custkey, second FROM c WHERE (o_custkey IS NULL) <> (second IS NULL)",
    "con8_propagate_parent_change": SQL_CON8,
    "con8_propagate_chain": SQL_CON8_CHAIN,
    "con8_propagate_branches": SQL_CON8_BRANCHES,
    "con11_set_rules": SQL_CON11_SETS,
    "con1_validate_nested": SQL_CON1_NESTED,
    "con9_domain": SQL_CON9,
    "con10_enum": "SELECT o_orderpriority, CAST(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH'], o_orderpriority) AS INTEGER) AS ordinal, 0 AS violations FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1 UNION ALL SELECT o_orderpriority, 0, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
    "con11_contract_report": SQL_LINE_RULES + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE r{i}) AS n FROM r" for i, n in enumerate(RULE_NAMES)),
    "con11_quarantine": SQL_LINE_RULES + "SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN r{i} THEN '{n}' ELSE '' END" for i, n in enumerate(RULE_NAMES)) + "], lambda x: x <> ''), ',') AS failed, count(*) AS n FROM r WHERE r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 GROUP BY 1",
    "con12_checked_cast": SQL_CON12,
    "con13_encodable": r"SELECT doc_id, NOT regexp_matches(text, '[^\x{00}-\x{FF}]') AS latin1, NOT regexp_matches(text, '[^\x{00}-\x{7F}]') AS ascii FROM documents",
    "acl1_explode_grants": f"WITH {SQL_GRANTS} SELECT role, section, object, privilege FROM g",
    "acl2_cancel_pairs": f"WITH {SQL_ENTRIES} SELECT event_id, is_grant FROM x WHERE is_grant OR NOT EXISTS (SELECT 1 FROM x y WHERE y.is_grant AND y.batch = x.batch AND y.role = x.role AND y.object = x.object AND y.privilege = x.privilege)",
    "acl3_aggregate_grants": f"""WITH {SQL_ENTRIES}, d AS (SELECT DISTINCT section, object, is_grant, privilege LIKE '% WITH GRANT OPTION' AS grantable, role, replace(privilege, ' WITH GRANT OPTION', '') AS p FROM x)
SELECT section, object, string_agg(is_grant || ':' || grantable || ':' || role || ':' || p, ',' ORDER BY is_grant, grantable, role, p) AS statements FROM d GROUP BY 1, 2""",
    "acl4_classify_roles": SQL_ACL4,
    "acl5_membership_edges": f"WITH {SQL_MEMBERS} SELECT member, role FROM m",
    "acl6_effective_privileges": SQL_EFFECTIVE,
    "acl7_privilege_domain": SQL_ACL7,
    "acl8_project_for_role": "SELECT * EXCLUDE (c_acctbal) FROM customer",
}
