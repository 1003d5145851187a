"""Queries of the derivation and routing operators (DER) and of views and relational shapes (QRY)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import derive as V
from ..operators import diff as D
from ..operators import interval as I
from ..operators import views as W
from ..plans.session import table
from .pairs import SQL_PAIR, actual_orders, desired_orders
from .snapshots import SQL_DIFF


def der1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    given = F.create_map(F.lit("nick"), k % 3 != 0)
    rows = c.select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).alias("nick"), given.alias("given"))
    rows = V.apply_defaults(rows, {"nick": "concat('c', c_custkey)", "segment": "'NONE'"}, presence="given")
    return rows.select("c_custkey", "nick", "segment")


def der2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return V.generated_column(lines, "cents", "CAST(round(l_extendedprice * (1 - l_discount) * 100) AS bigint)").select(
        "l_orderkey", "l_linenumber", "l_partkey", "cents"
    )


SEQUENCE = V.Sequence_(start=100, increment=10, minimum=1, maximum=1000, cycle=True)


def der3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_id") + 10**9).alias("id"))
    return V.identity_column(rows, "id", [F.col("event_id")], V.Sequence_(start=1, increment=2)).select("event_id", "id", "identity_violation")


def der3_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(7)).cast("long").alias("id"))
    return V.identity_column(rows, "id", [F.col("event_id")], V.Sequence_(start=1, increment=2), always=True).select("event_id", "id", "identity_violation")


def der4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return V.sequence_assign(e, [F.col("event_id")], "value", SEQUENCE)


def der5(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.when(F.col("p_partkey") % 6 == 0, F.lit("big")).otherwise(F.col("p_size").cast("string"))
    loose = part.select(size.alias("p_size"), "p_type", F.col("p_partkey").cast("string").alias("p_partkey"), F.lit(1).alias("junk"))
    return V.conform(loose, {"p_partkey": "bigint", "p_size": "int", "p_comment": "string"})[0]


def der6_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [V.Partition("open", values=("O",)), V.Partition("closed", values=("F", None))]
    status = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus"))
    return V.route_partitions(table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")), "status", "LIST", parts)


def der6_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [V.Partition("small", upper=1000.0), V.Partition("middle", lower=1000.0, upper=200000.0), V.Partition("large", lower=300000.0)]
    return V.route_partitions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "RANGE", parts, default="rest").select("o_orderkey", "partition")


def der6_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [V.Partition(f"h{i}", modulus=4, remainder=i) for i in range(4)]
    routed = V.route_partitions(table(spark, sf_dir, "orders"), "o_orderkey", "HASH", parts)
    return routed.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


def der6_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANGE over (status, price), the last partition hashed once more, the middle one by list."""
    hashed = V.Partitioning("HASH", ("o_orderkey",), tuple(V.Partition(f"p{i}", modulus=3, remainder=i) for i in range(3)))
    listed = V.Partitioning("LIST", ("o_orderpriority",), (V.Partition("hot", values=("1-URGENT", "2-HIGH")),), "cold")
    parts = [
        V.Partition("f_low", lower=("F", V.MINVALUE), upper=("F", 150000.0)),
        V.Partition("f_high", lower=("F", 150000.0), upper=("F", V.MAXVALUE), parts=listed),
        V.Partition("rest", lower=("O", 100000.0), parts=hashed),
    ]
    o = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")))
    return V.route_partitions(o, ["o_orderstatus", "o_totalprice"], "RANGE", parts, default="other").select("o_orderkey", "partition")


def der6_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 ranges of order keys, every tenth of them missing."""
    parts = [V.Partition(f"r{i}", lower=i * 7, upper=i * 7 + 7) for i in range(10_000) if i % 10]
    return V.route_partitions(table(spark, sf_dir, "orders"), "o_orderkey", "RANGE", parts, default="none").select("o_orderkey", "partition")


def der7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    parent = c.filter("key % 50 = 0").select("key", "name", "nation")
    return V.inheritance_scan(("party", parent), [("customer", c), ("supplier", s)])


def der8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", V.pack("address", "c_nationkey", "c_mktsegment"))
    return V.unpack(c, "address").withColumn("first", F.substring("c_mktsegment", 1, 1))


def der9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the week that begins with the user's first one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    weeks = e.groupBy("user_id").agg(F.min("s").alias("begins"))
    week = 7 * 86400
    found = I.range_join(e, F.col("s"), weeks, F.col("begins"), F.col("begins") + week, on=["user_id"])
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def der9_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys in ranges of suppliers: short ones, one of 10^10, and some without a lower or an upper bound."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("long").alias("key"))
    k = F.col("s_suppkey").cast("long")
    lower = F.when(k % 10 != 3, F.when(k == 1, F.lit(-(10**9))).otherwise(k * 5))
    upper = F.when(k % 10 != 7, F.when(k == 1, F.lit(9 * 10**9)).otherwise(k * 5 + k % 40))
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", lower.alias("low"), upper.alias("high"))
    totals = {"n": (F.count(F.lit(1)), F.sum), "total": (F.sum("key"), F.sum)}
    return I.range_totals(part, F.col("key"), ranges, F.col("low"), F.col("high"), ["s_suppkey"], totals)


def der9_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers in ranges of suppliers' balances, as decimals, upper bound included."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    low = F.col("s_acctbal").cast("decimal(12,2)")
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), (low + F.lit(50)).cast("decimal(12,1)").alias("high"))
    return I.range_join(c, F.col("balance"), ranges, F.col("low"), F.col("high"), "(]").select("c_custkey", "s_suppkey")


def der9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose days meet a supplier's season; every 25th season has no end, every 10th order takes no day."""
    o = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", V.range_value(o, F.date_add(o, F.col("o_orderkey").cast("int") % 10)).alias("days"))
    k = F.col("s_suppkey").cast("int")
    begins = F.date_add(F.lit("1992-01-01").cast("date"), k * 17 % 2400)
    seasons = table(spark, sf_dir, "supplier").select("s_suppkey", V.range_value(begins, F.when(k % 25 != 0, F.date_add(begins, k % 15)), "[]").alias("season"))
    totals = {"n": (F.count(F.lit(1)), F.sum), "total": (F.sum("o_orderkey"), F.sum)}
    return I.overlap_totals(orders, F.col("days"), seasons, F.col("season"), ["s_suppkey"], totals)


def der9_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = V.range_value(k % 10, k % 10 + k % 3, "[]")
    b = V.range_value(k % 7, F.when(k % 5 != 0, k % 7 + 4), "[)")
    c = V.range_value(k % 4, k % 4 + k % 2, "[)")  # half of them empty
    none = F.when(k % 6 != 0, c)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", V.range_contains(a, k % 8).alias("has"), V.range_overlaps(a, b).alias("meets"), V.range_length(b).alias("length"),
        V.range_contains(none, F.when(k % 8 != 1, k % 4)).alias("c_has"), V.range_overlaps(a, c).alias("c_meets"), V.range_length(c).alias("c_length"),
    )


def der10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 != 0, F.col("o_totalprice")))
    order = [V.index_order("o_totalprice", descending=True), V.index_order("o_orderkey")]
    return V.ordered_scan(o, order, ["o_orderkey", "o_totalprice"], limit=100)


def _triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = D.snapshot_diff(desired_orders(spark, sf_dir), actual_orders(spark, sf_dir), ["o_orderkey"])
    trigger = V.RowTrigger(
        "stamp", ("insert", "update"), {"o_orderpriority": "concat('changed ', substring(new.o_orderpriority, 1, 1))"}, of=("o_totalprice",), when="new.o_totalprice > 1000"
    )
    return V.row_trigger(V.change_events(diff), trigger)


def der11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triggered(spark, sf_dir).select("o_orderkey", "event", "fired", F.col("new.o_orderpriority").alias("priority"))


def der12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statement_trigger(_triggered(spark, sf_dir))


# Views and relational shapes -----------------------------------------------------------------------------------


def qry1(spark: SparkSession, sf_dir: str) -> DataFrame:
    W.define_view(spark, "pactum_orders", table(spark, sf_dir, "orders"))
    W.define_view(spark, "pactum_big", "SELECT o_orderkey, o_custkey, o_totalprice FROM pactum_orders WHERE o_totalprice > 1000", ["key", "customer"])
    return W.define_view(spark, "pactum_top", "SELECT customer, count(*), max(o_totalprice) FROM pactum_big GROUP BY customer", ["customer", "n", "top"])


def qry2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part tree (parent = key div 2) below key 1."""
    edges = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 2").alias("up")).filter("up > 0")
    seed = table(spark, sf_dir, "part").filter("p_partkey = 1").select("p_partkey", F.lit(0).alias("depth"))

    def step(fresh: DataFrame) -> DataFrame:
        near = fresh.select(F.col("p_partkey").alias("up"), (F.col("depth") + 1).alias("depth"))
        return edges.join(near, "up").select("p_partkey", "depth")

    return W.recursive_view(seed, step)


def qry3(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    base = W.View("big", F.col("o_totalprice") > 1000)
    local = W.View("open", F.col("o_orderstatus") != "F", base, "LOCAL")
    cascaded = W.View("open_all", F.col("o_orderstatus") != "F", base, "CASCADED")
    bad = lambda v: W.check_option_violations(o, v).select("o_orderkey", F.lit(v.name).alias("view"))
    return bad(local).unionByName(bad(cascaded))


def qry4(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("total"))
    return W.refresh_materialized(states, "pactum_order_states", unique=["o_orderstatus"])


def qry5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("total"))


def qry6(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment"))


def qry7(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def qry8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_brand").rlike("#[1-3][24]$")).select("p_partkey", "p_brand")


def qry9(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))
    return grouped.select("p_brand", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


QUERIES = {
    "der1_apply_defaults": der1,
    "der2_generated_column": der2,
    "der3_identity_by_default": der3,
    "der3_identity_always": der3_always,
    "der4_sequence_assign": der4,
    "der5_conform": der5,
    "der6_route_list": der6_list,
    "der6_route_range": der6_range,
    "der6_route_hash": der6_hash,
    "der6_route_two_columns": der6_two_columns,
    "der6_route_many_ranges": der6_many,
    "der7_inheritance_scan": der7,
    "der8_composite": der8,
    "der9_range_join": der9,
    "der9_interval_join": der9_interval,
    "der9_decimal_join": der9_decimal,
    "der9_overlap_join": der9_overlap,
    "der9_range_values": der9_values,
    "der10_ordered_scan": der10,
    "der11_row_trigger": der11,
    "der12_statement_trigger": der12,
    "qry1_define_view": qry1,
    "qry2_recursive_view": qry2,
    "qry3_check_option": qry3,
    "qry4_refresh_materialized": qry4,
    "qry5_group_count": qry5,
    "qry6_inner_join": qry6,
    "qry7_semi_join": qry7,
    "qry8_regex_filter": qry8,
    "qry9_array_aggregate": qry9,
}
SQL = {
    "der1_apply_defaults": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey WHEN c_custkey % 2 = 0 THEN c_name END AS nick, 'NONE' AS segment FROM customer",
    "der2_generated_column": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents FROM lineitem",
    "der3_identity_by_default": "SELECT event_id, event_id + 1000000000 AS id, false AS identity_violation FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 2 * row_number() OVER (ORDER BY event_id) - 1, false FROM events WHERE event_id % 4 <> 0",
    "der3_identity_always": "SELECT event_id, 2 * row_number() OVER (ORDER BY event_id) - 1 AS id, event_id % 4 = 0 AS identity_violation FROM events",
    "der4_sequence_assign": "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) SELECT event_id, CASE WHEN k < 91 THEN 100 + 10 * k ELSE 1 + (k - 91) % 100 * 10 END AS value FROM n",
    "der5_conform": "SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN p_size END AS p_size, CAST(NULL AS VARCHAR) AS p_comment FROM part",
    "der6_route_list": "SELECT o_orderkey, status, CASE WHEN status = 'O' THEN 'open' WHEN status = 'F' OR status IS NULL THEN 'closed' END AS partition FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status FROM orders)",
    "der6_route_range": "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' WHEN o_totalprice >= 300000 THEN 'large' ELSE 'rest' END AS partition FROM orders",
    "der6_route_hash": "SELECT 'h' || (CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 4) AS partition, count(*) AS n FROM orders GROUP BY 1",
    "der6_route_two_columns": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS p FROM orders)
SELECT o_orderkey, CASE WHEN p IS NULL OR o_orderstatus IS NULL THEN 'other' WHEN o_orderstatus = 'F' AND p < 150000 THEN 'f_low'
  WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hot' ELSE 'cold' END
  WHEN o_orderstatus > 'O' OR o_orderstatus = 'O' AND p >= 100000 THEN 'p' || (CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 3) ELSE 'other' END AS partition FROM o""",
    "der6_route_many_ranges": "SELECT o_orderkey, CASE WHEN o_orderkey < 70000 AND (o_orderkey // 7) % 10 <> 0 THEN 'r' || (o_orderkey // 7) ELSE 'none' END AS partition FROM orders",
    "der7_inheritance_scan": "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'supplier' FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, 'party' FROM customer WHERE c_custkey % 50 = 0",
    "der8_composite": "SELECT c_custkey, c_nationkey, c_mktsegment, substr(c_mktsegment, 1, 1) AS first FROM customer",
    "der9_range_join": "WITH e AS (SELECT user_id, epoch(date_trunc('second', ts)) AS s FROM events), w AS (SELECT user_id, min(s) AS b FROM e GROUP BY 1) SELECT e.user_id, count(*) AS n FROM e JOIN w ON w.user_id = e.user_id AND s >= b AND s < b + 604800 GROUP BY 1",
    "der9_interval_join": """WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 3 THEN CASE WHEN s_suppkey = 1 THEN -1000000000 ELSE s_suppkey * 5 END END AS low,
  CASE WHEN s_suppkey % 10 <> 7 THEN CASE WHEN s_suppkey = 1 THEN 9000000000 ELSE s_suppkey * 5 + s_suppkey % 40 END END AS high FROM supplier)
SELECT s_suppkey, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM part JOIN r ON (low IS NULL OR p_partkey >= low) AND (high IS NULL OR p_partkey < high) GROUP BY 1""",
    "der9_decimal_join": """WITH r AS (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(12,2)) AS low, CAST(CAST(s_acctbal AS DECIMAL(12,2)) + 50 AS DECIMAL(12,1)) AS high FROM supplier)
SELECT c_custkey, s_suppkey FROM customer JOIN r ON CAST(c_acctbal AS DECIMAL(12,2)) > low AND CAST(c_acctbal AS DECIMAL(12,2)) <= high""",
    "der9_overlap_join": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INTEGER) AS e FROM orders),
s AS (SELECT s_suppkey, DATE '1992-01-01' + CAST(s_suppkey * 17 % 2400 AS INTEGER) AS b, CASE WHEN s_suppkey % 25 <> 0 THEN DATE '1992-01-01' + CAST(s_suppkey * 17 % 2400 + s_suppkey % 15 AS INTEGER) END AS e FROM supplier)
SELECT s_suppkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM o JOIN s ON o.b < o.e AND (s.e IS NULL OR o.b <= s.e) AND s.b < o.e GROUP BY 1""",
    "der9_range_values": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 AS lo, o_orderkey % 10 + o_orderkey % 3 AS hi, o_orderkey % 7 AS b, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 + 4 END AS e FROM orders)
SELECT k AS o_orderkey, k % 8 BETWEEN lo AND hi AS has, (e IS NULL OR lo < e) AND b <= hi AS meets, e - b AS length,
       CASE WHEN k % 6 <> 0 AND k % 8 <> 1 THEN k % 2 = 1 END AS c_has, k % 2 = 1 AND k % 4 <= hi AND lo < k % 4 + 1 AS c_meets, CASE WHEN k % 2 = 1 THEN 1 END AS c_length FROM r""",
    "der10_ordered_scan": "SELECT o_orderkey, p AS o_totalprice FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 500 <> 0 THEN o_totalprice END AS p FROM orders) ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 100",
    "der11_row_trigger": SQL_DIFF + """, t AS (
  SELECT diff.o_orderkey, CASE change WHEN 'Added' THEN 'insert' WHEN 'Changed' THEN 'update' ELSE 'delete' END AS event,
         change <> 'Removed' AND new_price > 1000 AND (change = 'Added' OR new_price <> old_price) AS fired, d.o_orderpriority AS p
  FROM diff LEFT JOIN desired d ON d.o_orderkey = diff.o_orderkey WHERE change <> 'Unchanged')
SELECT o_orderkey, event, coalesce(fired, false) AS fired, CASE WHEN fired THEN 'changed ' || substr(p, 1, 1) ELSE p END AS priority FROM t""",
    "der12_statement_trigger": SQL_DIFF + "SELECT CASE change WHEN 'Added' THEN 'insert' WHEN 'Changed' THEN 'update' ELSE 'delete' END AS event, count(*) AS n FROM diff WHERE change <> 'Unchanged' GROUP BY 1",
    "qry1_define_view": "SELECT o_custkey AS customer, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
    "qry2_recursive_view": "WITH RECURSIVE t AS (SELECT p_partkey, 0 AS depth FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, depth + 1 FROM t JOIN part p ON p.p_partkey // 2 = t.p_partkey) SELECT p_partkey, depth FROM t",
    "qry3_check_option": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS s, o_totalprice AS p FROM orders) SELECT o_orderkey, 'open' AS view FROM o WHERE NOT coalesce(s <> 'F', false) UNION ALL SELECT o_orderkey, 'open_all' FROM o WHERE NOT (coalesce(s <> 'F', false) AND p > 1000)",
    "qry4_refresh_materialized": "SELECT o_orderstatus, count(*) AS total FROM orders GROUP BY 1",
    "qry5_group_count": "SELECT o_orderstatus, count(*) AS total FROM orders GROUP BY 1",
    "qry6_inner_join": "SELECT o_orderkey, c_name AS customer, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey",
    "qry7_semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "qry8_regex_filter": "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#[1-3][24]$')",
    "qry9_array_aggregate": "SELECT p_brand, string_agg(p_partkey, ',' ORDER BY p_partkey) AS parts FROM part GROUP BY 1",
}
