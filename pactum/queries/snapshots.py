"""Queries of the snapshot comparison operators (DIF)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..plans.session import table
from .pairs import SQL_PAIR, actual_orders, desired_orders

KEY = ["o_orderkey"]

SQL_DIFF = f"""
WITH {SQL_PAIR},
diff AS (
  SELECT coalesce(d.o_orderkey, a.o_orderkey) AS o_orderkey,
         CASE WHEN a.o_orderkey IS NULL THEN 'Added' WHEN d.o_orderkey IS NULL THEN 'Removed'
              WHEN d.o_custkey IS NOT DISTINCT FROM a.o_custkey
               AND d.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus
               AND d.o_totalprice IS NOT DISTINCT FROM a.o_totalprice
               AND d.o_orderdate IS NOT DISTINCT FROM a.o_orderdate
               AND d.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority THEN 'Unchanged'
              ELSE 'Changed' END AS change,
         d.o_totalprice AS new_price, a.o_totalprice AS old_price,
         coalesce(d.o_orderpriority, a.o_orderpriority) AS o_orderpriority,
         coalesce(d.o_orderstatus, a.o_orderstatus) AS o_orderstatus
  FROM desired d FULL OUTER JOIN actual a ON d.o_orderkey = a.o_orderkey
)
"""


def pair_diff(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return D.snapshot_diff(desired_orders(spark, sf_dir), actual_orders(spark, sf_dir), KEY, **options)


def dif1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_diff(spark, sf_dir, checked=True).select(
        "o_orderkey",
        "change",
        F.col("desired.o_totalprice").alias("new_price"),
        F.col("actual.o_totalprice").alias("old_price"),
    )


def dif1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_summary(pair_diff(spark, sf_dir))


def _repriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The desired orders with another priority on every row, which DIF2 leaves out of the comparison."""
    return desired_orders(spark, sf_dir).withColumn("o_orderpriority", F.lit("9-NONE"))


def dif2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _repriced(spark, sf_dir), actual_orders(spark, sf_dir)
    kind = a.schema
    left = a.select("o_orderkey", F.struct(*a.columns).alias("d"))
    right = b.select("o_orderkey", F.struct(*b.columns).alias("a"))
    equal = D.normalized_equal(F.col("d"), F.col("a"), kind, ignore=("o_orderpriority",))
    return left.join(right, "o_orderkey").select("o_orderkey", equal.alias("equal"))


TYPES = ["int4", "varchar(20)[]", "numeric(10,2)", "decimal(5,1)", "timestamptz", "bool[]", "float8", "text", "char(3)", "int8[] "]
SQL_TYPES = "['integer','character varying(20)[]','numeric(10,2)','numeric(5,1)','timestamp with time zone','boolean[]','double precision','text','character(3)','bigint[]']"


def _type_of(key: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (key % len(TYPES) + 1).cast("int"))


def dif3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", D.canonical_type(_type_of(F.col("p_partkey"))).alias("canonical")
    )


def dif4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    arg = lambda mode, name, kind: F.struct(mode.alias("mode"), name.alias("name"), kind.alias("type"))
    flag = F.when(F.col("l_returnflag") == "A", "OUT").when(F.col("l_returnflag") == "R", "INOUT").otherwise("IN")
    args = F.array(
        arg(F.lit("IN"), F.lit("k"), F.lit("int8")), arg(flag, F.lower("l_linestatus"), _type_of(F.col("l_partkey")))
    )
    kind = F.when(F.col("l_linenumber") == 1, "EXTENSION").otherwise("FUNCTION")
    key = D.identity_key(kind, F.lit("test"), F.concat(F.lit("f"), "l_linenumber"), args, schemaless=("EXTENSION",))
    return lines.select(key.alias("k")).groupBy("k.kind", "k.schema", "k.name").agg(F.count(F.lit(1)).alias("n"))


SQL_DIF4 = f"""
SELECT CASE WHEN l_linenumber = 1 THEN 'EXTENSION' ELSE 'FUNCTION' END AS kind,
       CASE WHEN l_linenumber = 1 THEN '' ELSE 'test' END AS schema,
       'f' || l_linenumber || '(k bigint' ||
       CASE WHEN l_returnflag = 'A' THEN ''
            ELSE ', ' || CASE WHEN l_returnflag = 'R' THEN 'INOUT ' ELSE '' END || lower(l_linestatus) || ' '
                 || ({SQL_TYPES})[l_partkey % {len(TYPES)} + 1] END || ')' AS name,
       count(*) AS n
FROM lineitem GROUP BY 1, 2, 3
"""


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = desired_orders(spark, sf_dir)
    status = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    return orders.withColumn("o_orderstatus", status)


def dif5(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = D.snapshot_diff(_shifted(spark, sf_dir), actual_orders(spark, sf_dir), KEY)
    return D.changed_fields(diff, KEY).select("o_orderkey", "field")


SQL_DIF5 = f"""
WITH {SQL_PAIR},
m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM desired)
SELECT m.o_orderkey, 'o_orderstatus' AS field FROM m JOIN actual a ON m.o_orderkey = a.o_orderkey WHERE m.s <> a.o_orderstatus
UNION ALL
SELECT m.o_orderkey, 'o_totalprice' FROM m JOIN actual a ON m.o_orderkey = a.o_orderkey WHERE m.p <> a.o_totalprice
"""


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    pair = lambda k, v: F.create_map(F.lit(k), v)
    nothing = F.expr("CAST(map() AS map<string,string>)")
    new = F.map_concat(
        pair("segment", F.col("c_mktsegment")),
        F.when(key % 3 == 0, pair("host", F.concat(F.lit("h"), key % 10))).otherwise(nothing),
        F.when(key % 4 == 0, pair("password", F.lit("new"))).otherwise(nothing),
    )
    old = F.map_concat(
        pair("segment", F.when(key % 2 == 0, F.lit("OLD")).otherwise(F.col("c_mktsegment"))),
        F.when(key % 5 == 0, pair("host", F.lit("h0"))).otherwise(nothing),
        pair("password", F.lit("secret")),
    )
    return c.select("c_custkey", new.alias("new"), old.alias("old"))


def _delta_rows(df: DataFrame, delta: F.Column) -> DataFrame:
    return df.select("c_custkey", F.explode(delta).alias("_e")).select("c_custkey", "_e.key", "_e.action")


def dif6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta_rows(_options(spark, sf_dir), D.options_delta(F.col("new"), F.col("old")))


SQL_OPTIONS = """
o AS (
  SELECT c_custkey, 'segment' AS key, c_mktsegment AS new, CASE WHEN c_custkey % 2 = 0 THEN 'OLD' ELSE c_mktsegment END AS old FROM customer
  UNION ALL SELECT c_custkey, 'host', CASE WHEN c_custkey % 3 = 0 THEN 'h' || (c_custkey % 10) END, CASE WHEN c_custkey % 5 = 0 THEN 'h0' END FROM customer
  UNION ALL SELECT c_custkey, 'password', CASE WHEN c_custkey % 4 = 0 THEN 'new' END, 'secret' FROM customer
), d AS (
  SELECT c_custkey, key, CASE WHEN old IS NULL AND new IS NOT NULL THEN 'ADD' WHEN new IS NULL AND old IS NOT NULL THEN 'DROP'
         WHEN new <> old THEN 'SET' END AS action FROM o
)"""


def dif7(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_quantity").alias("quantity"), F.min("l_partkey").alias("partkey"))
    )
    changed = F.when(F.col("partkey") % 5 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))
    desired = lines.filter("l_linenumber <> 2 OR l_orderkey % 3 <> 0").withColumn("quantity", changed)
    actual = lines.filter("l_linenumber <> 1 OR l_orderkey % 4 <> 0")
    return D.child_reconcile(desired, actual, ["l_orderkey"], "l_linenumber")


SQL_DIF7 = """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_orderkey, l_linenumber, CASE WHEN p % 5 = 0 THEN q + 1 ELSE q END AS q, p FROM l WHERE l_linenumber <> 2 OR l_orderkey % 3 <> 0),
a AS (SELECT * FROM l WHERE l_linenumber <> 1 OR l_orderkey % 4 <> 0),
j AS (
  SELECT coalesce(d.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(d.l_linenumber, a.l_linenumber) AS l_linenumber,
         a.l_orderkey IS NOT NULL AS was, d.l_orderkey IS NOT NULL AS is_, d.q IS NOT DISTINCT FROM a.q AND d.p IS NOT DISTINCT FROM a.p AS same
  FROM d FULL OUTER JOIN a ON d.l_orderkey = a.l_orderkey AND d.l_linenumber = a.l_linenumber
)
SELECT l_orderkey, l_linenumber, 'DROP' AS action FROM j WHERE was AND NOT (is_ AND same)
UNION ALL SELECT l_orderkey, l_linenumber, 'ADD' FROM j WHERE is_ AND NOT (was AND same)
"""


def dif8(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tag = F.concat(F.col("p_brand"), F.lit(" ("), F.col("p_size"), F.lit(")"))
    desired = part.select("p_partkey", tag.alias("tag"))
    actual = part.filter("p_partkey % 50 = 0").select(tag.alias("tag"))
    return D.existence_check(desired, actual, "tag").select("p_partkey", "coarse_key", "change")


SQL_DIF8 = """
SELECT p_partkey, p_brand AS coarse_key,
       CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 0) THEN 'Undiffable' ELSE 'Added' END AS change
FROM part
"""


def dif9(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.coalesce(F.col("desired.o_orderstatus"), F.col("actual.o_orderstatus"))
    return D.diff_summary(pair_diff(spark, sf_dir, skip=status == "P"))


def _line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_linenumber")).alias("new")
    )
    old = F.when(F.col("l_orderkey") % 2 == 0, F.slice("new", 1, 2)).when(
        F.col("l_orderkey") % 3 == 0, F.reverse("new")
    )
    return lines.withColumn("old", old)


def dif10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_arrays(spark, sf_dir)
    tail = F.array_join(D.appended_tail(F.col("new"), F.col("old")).cast("array<string>"), ",")
    fits = D.append_only_compatible(F.col("new"), F.col("old"))
    return rows.select("l_orderkey", fits.alias("compatible"), F.when(fits & F.col("old").isNotNull(), tail).alias("tail"))


SQL_ARRAYS = """
WITH n AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS new FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, new, CASE WHEN l_orderkey % 2 = 0 THEN new[1:2] WHEN l_orderkey % 3 = 0 THEN list_reverse(new) END AS old FROM n)
"""
SQL_DIF10 = SQL_ARRAYS + """
SELECT l_orderkey, old IS NULL OR new[1:len(old)] = old AS compatible,
       CASE WHEN old IS NOT NULL AND new[1:len(old)] = old THEN array_to_string(new[len(old) + 1:], ',') END AS tail
FROM r
"""


def dif11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_arrays(spark, sf_dir).filter("old IS NOT NULL")
    return rows.select("l_orderkey", D.shared_order_preserved(F.col("new"), F.col("old")).alias("preserved"))


RULES = [
    ("o_totalprice", "in_place"),
    ("o_orderpriority", "in_place"),
    ("o_custkey", "or_replace"),
    ("o_orderdate", "or_replace"),
    ("o_orderstatus", "rebuild"),
    ("o_comment", "in_place"),
]


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = D.snapshot_diff(_shifted(spark, sf_dir), actual_orders(spark, sf_dir), KEY)
    rules = spark.createDataFrame(RULES, "field string, resolution string")
    return D.classify_resolution(D.changed_fields(diff, KEY), rules, KEY)


SQL_RESOLUTIONS = f"""
WITH c AS ({SQL_DIF5}),
res AS (SELECT o_orderkey, CASE WHEN bool_or(field = 'o_orderstatus') THEN 'rebuild' ELSE 'in_place' END AS resolution FROM c GROUP BY 1)
"""


def dif13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gate_counts(resolutions(spark, sf_dir), F.col("resolution") == "rebuild", allow=False)


def dif14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordering import global_ordinal

    diff = pair_diff(spark, sf_dir)
    # The ordinals of the two archives: the actual one lists keys upwards (some unknown), the desired one by date.
    actual = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey"))
    desired = F.datediff(F.col("desired.o_orderdate"), F.lit("1970-01-01"))
    phased = D.plan_phases(diff, desired, actual)
    ordered = global_ordinal(phased.select("o_orderkey", "change", "phase", "rank"), [F.col("phase"), F.col("rank"), F.col("o_orderkey")], "seq")
    return ordered.select("seq", "o_orderkey", "change")


SQL_DIF14 = SQL_DIFF + f""",
p AS (
  SELECT diff.o_orderkey, change,
         CASE WHEN change = 'Removed' AND diff.o_orderkey % 2 = 1 THEN 0 WHEN change = 'Removed' THEN 1 ELSE 2 END AS phase,
         CASE WHEN change = 'Removed' AND diff.o_orderkey % 2 = 1 THEN -diff.o_orderkey WHEN change = 'Removed' THEN 0
              ELSE date_diff('day', DATE '1970-01-01', CAST(d.o_orderdate AS DATE)) END AS rank
  FROM diff LEFT JOIN desired d ON d.o_orderkey = diff.o_orderkey WHERE change <> 'Unchanged'
)
SELECT row_number() OVER (ORDER BY phase, rank, o_orderkey) AS seq, o_orderkey, change FROM p
"""


def dif15(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = pair_diff(spark, sf_dir).withColumn(
        "priority", F.coalesce(F.col("desired.o_orderpriority"), F.col("actual.o_orderpriority"))
    )
    return D.diff_summary(diff, "priority", totals=True)


def dif16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.converges(desired_orders(spark, sf_dir), actual_orders(spark, sf_dir), KEY)


def mrg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = D.keep_redacted(F.col("old"), F.col("new"))
    return _delta_rows(_options(spark, sf_dir), D.options_delta(F.col("new"), old))


QUERIES = {
    "dif1_snapshot_diff": dif1,
    "dif1_snapshot_diff_counts": dif1_counts,
    "dif2_normalized_equal": dif2,
    "dif3_canonical_type": dif3,
    "dif4_identity_key": dif4,
    "dif5_changed_fields": dif5,
    "dif6_options_delta": dif6,
    "dif7_child_reconcile": dif7,
    "dif8_existence_check": dif8,
    "dif9_scope_filter": dif9,
    "dif10_append_only": dif10,
    "dif11_shared_order": dif11,
    "dif12_classify_resolution": resolutions,
    "dif13_destructive_gate": dif13,
    "dif14_ordered_plan": dif14,
    "dif15_diff_summary": dif15,
    "dif16_converges": dif16,
    "mrg10_delta_keep_redacted": mrg10,
}
SQL = {
    "dif1_snapshot_diff": SQL_DIFF + "SELECT o_orderkey, change, new_price, old_price FROM diff",
    "dif1_snapshot_diff_counts": SQL_DIFF + "SELECT change, count(*) AS n FROM diff GROUP BY change",
    "dif2_normalized_equal": SQL_DIFF + "SELECT o_orderkey, new_price = old_price AS equal FROM diff WHERE change IN ('Changed', 'Unchanged')",
    "dif3_canonical_type": f"SELECT p_partkey, ({SQL_TYPES})[p_partkey % {len(TYPES)} + 1] AS canonical FROM part",
    "dif4_identity_key": SQL_DIF4,
    "dif5_changed_fields": SQL_DIF5,
    "dif6_options_delta": f"WITH {SQL_OPTIONS} SELECT c_custkey, key, action FROM d WHERE action IS NOT NULL",
    "dif7_child_reconcile": SQL_DIF7,
    "dif8_existence_check": SQL_DIF8,
    "dif9_scope_filter": SQL_DIFF + "SELECT CASE WHEN o_orderstatus = 'P' THEN 'Skipped' ELSE change END AS change, count(*) AS n FROM diff GROUP BY 1",
    "dif10_append_only": SQL_DIF10,
    "dif11_shared_order": SQL_ARRAYS + "SELECT l_orderkey, l_orderkey % 2 = 0 OR len(new) = 1 AS preserved FROM r WHERE old IS NOT NULL",
    "dif12_classify_resolution": SQL_RESOLUTIONS + "SELECT o_orderkey, resolution FROM res",
    "dif13_destructive_gate": SQL_RESOLUTIONS + "SELECT count(*) FILTER (WHERE resolution <> 'rebuild') AS included, count(*) FILTER (WHERE resolution = 'rebuild') AS excluded, 0 AS included_destructive, count(*) FILTER (WHERE resolution = 'rebuild') = 0 AS may_apply FROM res",
    "dif14_ordered_plan": SQL_DIF14,
    "dif15_diff_summary": SQL_DIFF + "SELECT change, o_orderpriority AS priority, count(*) AS n, CASE WHEN grouping(change) = 1 THEN 'change,priority' WHEN grouping(o_orderpriority) = 1 THEN 'priority' ELSE '' END AS summed FROM diff GROUP BY ROLLUP (change, o_orderpriority)",
    "dif16_converges": "SELECT 0 AS differences",
    "mrg10_delta_keep_redacted": f"WITH {SQL_OPTIONS} SELECT c_custkey, key, action FROM d WHERE action IS NOT NULL AND NOT (key = 'password' AND action = 'DROP')",
}
