"""Queries of user functions, aggregates, operators, collations and text search, and of sources and change feeds."""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collations as L
from ..functions import routines as R
from ..functions import text as X
from ..functions.overloads import Functions
from ..operators import interval as I
from ..operators import scan as W
from ..operators.checks import enum_ordinal
from ..plans.session import list_names, shared_folder, table
from ..sources import tables as S
from ..streaming import replication as P


def udf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.scalar_function(spark, "pactum_discounted", "price DOUBLE, discount DOUBLE DEFAULT 0.1", "BIGINT", "CAST(round(price * (1 - discount) * 100) AS BIGINT)", strict=["price", "discount"])
    lines = table(spark, sf_dir, "lineitem").withColumn("d", F.when(F.col("l_linenumber") != 2, F.col("l_discount")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("pactum_discounted(l_extendedprice, d)").alias("own"), F.expr("pactum_discounted(l_extendedprice)").alias("usual"))


def udf1_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signatures of one name in one query; a whole number goes to the signature of doubles, the preferred one."""
    own = Functions(spark, "pactum_size")
    own.define("size_of", [("x", "double"), ("step", "int", "100")], "bigint", "CAST(round(x * step) AS bigint)", strict=True, volatility="immutable")
    own.define("size_of", [("x", "string")], "bigint", "length(x)", strict=True, volatility="immutable")
    own.define("size_of", [("x", "date")], "bigint", "year(x)", volatility="stable")
    o = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    call = lambda *a: own.call(o, "size_of", *a)
    status = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", call(F.col("o_totalprice")).alias("cents"), call(F.col("o_custkey"), F.lit(7)).alias("week"), call(status).alias("letters"), call(F.col("day")).alias("year"))


def udf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").select("o_orderkey").createOrReplaceTempView("pactum_order_keys")
    R.table_function(spark, "pactum_parts", "k BIGINT", "n INT, share BIGINT", "SELECT CAST(n AS INT), k % 100 + n FROM explode(sequence(1, CAST(k % 3 + 1 AS INT))) AS t(n)")
    return spark.sql("SELECT o_orderkey, p.n, p.share FROM pactum_order_keys, LATERAL pactum_parts(o_orderkey) AS p")


def udf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.select("event_id", R.running(F.col("cents"), ["user_id"], [F.col("event_id")]).alias("total"))


def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity-weighted mean line number of a part, in thousandths."""
    lines = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("long")))
    pair = F.when(F.col("q").isNotNull(), F.struct(F.col("q").alias("w"), (F.col("q") * F.col("l_linenumber")).alias("x")))
    state = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("x"))
    mean = R.user_aggregate(
        pair,
        F.struct("l_orderkey", "l_linenumber"),
        state,
        lambda s, v: F.struct((s["w"] + v["w"]).alias("w"), (s["x"] + v["x"]).alias("x")),
        lambda s: F.when(s["w"] > 0, F.floor(s["x"] * 1000 / s["w"])),
    )
    return lines.groupBy("l_partkey").agg(mean.alias("mean"))


def agg1_ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check value over the customers of all orders of a status, in order: a transition that is not associative, over
    three groups that hold all rows."""
    o = table(spark, sf_dir, "orders").withColumn("c", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")))
    step = lambda s, v: (s * 31 + v) % 1000003
    folded = W.ordered_fold(o, ["o_orderstatus"], [F.col("o_orderkey")], F.col("c"), F.lit(7).cast("long"), step, lambda s: s, "check_value", size=4096)
    return folded


def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("long")))
    partial = [F.sum("q").alias("w"), F.sum(F.col("q") * F.col("l_linenumber")).alias("x")]
    combine = [F.when(F.sum("w") > 0, F.floor(F.sum("x") * 1000 / F.sum("w"))).alias("mean")]
    return R.two_level(lines, ["l_partkey"], partial, combine, salt_by=["l_orderkey"])


SQL_FOLD = """
SELECT o_orderstatus, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list(o_custkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 11 <> 0)), lambda s, v: (s * 31 + v) % 1000003) AS BIGINT) AS check_value
FROM orders GROUP BY 1
"""
SQL_AGG = "SELECT l_partkey, CAST(floor(sum(q * l_linenumber) * 1000 / sum(q)) AS BIGINT) AS mean FROM (SELECT l_partkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS BIGINT) END AS q FROM lineitem) GROUP BY 1"


def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.select("event_id", R.moving(F.sum, F.col("cents"), ["user_id"], [F.col("event_id")], 7).alias("last7"))


def _user_events(spark: SparkSession, sf_dir: str, partition: list[str]) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return W.numbered(e, partition, [F.col("event_id")], "place")


def udf3_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window function with a state of its own: count and total of a user's cents so far."""
    e = _user_events(spark, sf_dir, ["user_id"])
    pair = F.when(F.col("cents").isNotNull(), F.struct(F.lit(1).cast("long").alias("n"), F.col("cents").alias("total")))
    add = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["total"] + b["total"]).alias("total"))
    return W.running_state(e, ["user_id"], "place", pair, add).select("event_id", "place", "state.n", "state.total")


def agg3_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _user_events(spark, sf_dir, ["user_id"])
    moved = W.moving_state(e, ["user_id"], "place", F.col("cents"), lambda a, b: a + b, 7, inverse=lambda a, b: a - b, name="last7")
    return moved.select("event_id", "last7")


def agg3_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _user_events(spark, sf_dir, ["user_id"])
    return W.moving_state(e, ["user_id"], "place", F.col("cents"), F.greatest, 7, name="top7").select("event_id", "top7")


def agg3_one_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are one partition."""
    return W.moving_state(_user_events(spark, sf_dir, []), [], "place", F.col("cents"), F.greatest, 100, name="top").select("event_id", "place", "top")


SQL_CENTS = "WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS cents FROM events) "


def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ordered_set(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity"), {"median": 0.5}, {"high": 0.9})


def agg4_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and the most frequent day of the orders of each status and priority; every seventh day is unknown."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").withColumn("day", F.when(day % 7 != 0, day.cast("long")))
    return W.ordered_set(o, ["o_orderstatus", "o_orderpriority"], F.col("day"), {"quarter": 0.25}, {"first": 0.0, "third": 0.75, "last": 1.0}, mode="usual")


SQL_AGG4_MODE = """
WITH o AS (SELECT *, CASE WHEN d % 7 <> 0 THEN d END AS day FROM (SELECT *, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)),
m AS (SELECT o_orderstatus, o_orderpriority, day, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY count(*) DESC, day) AS r
      FROM o WHERE day IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.*, m.day AS usual FROM
(SELECT o_orderstatus, o_orderpriority, quantile_cont(day, 0.25) AS quarter, min(day) AS "first", quantile_disc(day, 0.75) AS third, max(day) AS "last" FROM o GROUP BY 1, 2) g
LEFT JOIN m ON m.o_orderstatus = g.o_orderstatus AND m.o_orderpriority = g.o_orderpriority AND m.r = 1
"""


def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hypothetical_rank(table(spark, sf_dir, "orders"), ["o_orderstatus"], F.col("o_totalprice"), F.lit(1500.0))


PRIORITIES = ["5-LOW", "3-MEDIUM", "1-URGENT", "4-NOT SPECIFIED", "2-HIGH"]


def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = enum_ordinal(F.col("o_orderpriority"), PRIORITIES)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", rank).alias("highest"), F.min_by("o_orderpriority", rank).alias("lowest"))


def opr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and equal area (size squared) as another's of the same type."""
    part = table(spark, sf_dir, "part")
    a = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_size") * F.col("p_size")).alias("x"), F.col("p_brand").alias("brand"))
    b = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b"), (F.col("p_size") * F.col("p_size")).alias("y"), F.col("p_brand").alias("other"))
    joined = R.operator_join(a, b, F.struct(F.col("brand"), F.col("x")), F.struct(F.col("other"), F.col("y")))
    return joined.select("a", "b", "x")


def opr1_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the customers with a smaller balance and a key that is not below its own, times ten."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") * 10).alias("tenfold"))
    totals = {"n": (F.count(F.lit(1)), F.sum), "first": (F.min("c_custkey"), F.min)}
    return I.inequality_totals(c, s, [("c_acctbal", "<", "s_acctbal"), ("c_custkey", ">=", "tenfold")], ["s_suppkey"], totals)


def opr1_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders whose prices lie apart by less than a quarter, the dearer one second."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), (F.col("o_totalprice") + 0.25).alias("limit"))
    met = I.inequality_join(o, o, [("p", "<", "p"), ("limit", ">", "p")], block=256)
    return met.select(F.col("left.o_orderkey").alias("a"), F.col("right.o_orderkey").alias("b"))


def opr1_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("other", F.pmod(F.col("p_partkey") * 7, F.lit(50)).cast("int"))
    less = lambda x, y: x * x < y * y
    return R.operator_laws(part, less, lambda x, y: x * x > y * y, lambda x, y: x * x > y * y, "p_size", "other")


def col1(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mixed = F.when(k % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select(R.collated(mixed).alias("segment"))
    return c.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select(F.upper(F.collate("segment", "UTF8_BINARY")).alias("segment"), "n")


def col1_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are the same without accents and case, with the number of rows."""
    k = F.col("c_custkey")
    accented = F.when(k % 3 == 0, F.translate("c_mktsegment", "AEO", "ÁÉÔ")).otherwise(F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, F.lower(accented)).otherwise(accented).alias("segment"))
    same = L.unique_violations(c, "segment", L.Collation(accents=False, case=False, deterministic=False))
    return same.select(F.translate(F.upper("example"), "ÁÉÔ", "AEO").alias("segment"), "n")


def col1_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the order of two French locales, which weigh accents from the front and from the back."""
    word = F.element_at(F.array(*map(F.lit, ["cote", "coté", "côte", "côté"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", word.alias("word"))
    out = L.collated_ordinal(p, "word", L.Collation("fr_FR.utf8"), [F.col("p_partkey")], "france")
    return L.collated_ordinal(out, "word", L.Collation("fr_CA"), [F.col("p_partkey")], "canada")


def txt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.lexemes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return words.groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("position").alias("first"))


def txt1_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    every = X.matches(d, "text", ["the", "when", "from"]).select("doc_id", F.lit("and").alias("mode"))
    some = X.matches(d, "text", ["license", "token"], every=False).select("doc_id", F.lit("or").alias("mode"))
    return every.unionByName(some)


def txt1_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.headline(F.col("text"), ["license", "token"])).alias("marked"))


def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    server, user, own = {"mergeSchema": "false"}, {"user": "reader"}, {"path": f"{sf_dir}/nation.parquet"}
    return S.foreign_table(spark, "parquet", {"n_nationkey": "bigint", "n_name": "string"}, server, user, own)


def src1_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders behind a CSV source. The separator and the null marker of the table win over those of the server and the
    user mapping, columns are found by name, and a word in a column of numbers is null."""
    path = f"{shared_folder(spark)}/foreign-{uuid.uuid4().hex}"
    key = F.when(F.col("o_orderkey") % 5 == 0, "none").when(F.col("o_orderkey") % 5 != 1, F.col("o_custkey").cast("string"))
    table(spark, sf_dir, "orders").select("o_orderstatus", key.alias("o_custkey"), "o_orderkey").write.csv(path, header=True, sep="|", nullValue="-")
    layers = ({"header": "true", "sep": ",", "nullValue": "?"}, {"sep": ";"}, {"SEP": "|", "nullValue": "-", "path": path})
    return S.foreign_table(spark, "csv", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_comment": "string"}, *layers)


def src1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a declaration differs from the file behind it, with the prices that it cannot hold."""
    declared = {"o_orderkey": "bigint", "o_custkey": "int", "o_totalprice": "decimal(7,2)", "o_orderstatus": "string", "o_comment": "string"}
    return S.foreign_columns(spark, "parquet", declared, {"mergeSchema": "false"}, {"path": f"{sf_dir}/orders.parquet"})


SQL_SRC1_OVERLAY = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_custkey END AS o_custkey, CAST(NULL AS VARCHAR) AS o_comment FROM orders
"""
SQL_SRC1_COLUMNS = """
SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'bigint', 'same', 0), ('o_orderstatus', 'string', 'string', 'same', 0), ('o_comment', 'string', NULL, 'missing', 0),
  ('o_orderdate', NULL, 'timestamp_ntz', 'extra', 0), ('o_orderpriority', NULL, 'string', 'extra', 0)) AS t(column_name, declared, found, state, lost)
UNION ALL SELECT 'o_custkey', 'int', 'bigint', 'cast', count(*) FILTER (WHERE o_custkey > 2147483647) FROM orders
UNION ALL SELECT 'o_totalprice', 'decimal(7,2)', 'double', 'cast', count(*) FILTER (WHERE TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL AND o_totalprice IS NOT NULL) FROM orders
"""


def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name"), "c_acctbal")
    path = f"{shared_folder(spark)}/seed-{uuid.uuid4().hex}"
    S.seed_write(region, path)
    return S.seed_load(spark, path, {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"})[0]


def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = S.generate_users(table(spark, sf_dir, "customer"), "c_custkey")
    addresses = S.generate_addresses(users).groupBy("user_id").agg(F.count(F.lit(1)).alias("addresses"))
    return users.join(addresses, users["id"] == addresses["user_id"], "left").drop("user_id")


def _drawn(salt: str, below: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'42:{salt}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % {below})"


def _picked(items, salt: str) -> str:
    return f"[{', '.join(repr(x) for x in items)}][{_drawn(salt, len(items), 'k')} + 1]"


SQL_SRC3 = f"""
WITH c AS (SELECT c_custkey AS k FROM customer),
u AS (
  SELECT k AS id, CASE WHEN {_drawn('modified', 100, 'k')} >= 45 THEN CAST(DATE '2020-01-01' + CAST({_drawn('day', 700, 'k')} AS INTEGER) AS DATE) END AS last_modified_at,
         {_picked(('unverified', 'verified', 'suspended'), 'state')} AS state, 'user' || {_drawn('mail', 1_000_000, 'k')} || '@example.com' AS email,
         {_picked(S.LANGUAGES, 'language')} || '-' || {_picked(S.COUNTRIES, 'country')} AS locale,
         CASE WHEN {_drawn('display', 100, 'k')} >= 50 THEN 'User ' || k END AS display_name,
         CASE WHEN {_drawn('icon', 100, 'k')} >= 25 THEN {_drawn('oid', 100_000, 'k')} END AS icon
  FROM c
)
SELECT *, nullif({_drawn('addresses', 3, 'id')}, 0) AS addresses FROM u QUALIFY row_number() OVER (PARTITION BY email ORDER BY id) = 1
"""


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change feed: users are rows, event types operations, and one truncate."""
    e = table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    op = F.when(id_ == 1000, "truncate").when(id_ % 5 == 0, "delete").when(id_ % 2 == 0, "insert").otherwise("update")
    return e.select(F.pmod("user_id", F.lit(2000)).alias("user_id"), F.col("event_id").alias("ord"), op.alias("op"), F.col("event_type").alias("kind"))


def cdc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.publish(_feed(spark, sf_dir), ["insert", "delete"]).select("ord", "op")


def cdc2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fold_feed(_feed(spark, sf_dir), "user_id", "ord").select("user_id", "present", "conflicts", "skipped", F.when(F.col("present"), F.col("kind")).alias("kind"))


SQL_CDC2 = """
WITH f AS (
  SELECT user_id, event_id AS ord, event_type AS kind, CASE WHEN event_id % 5 = 0 THEN 'delete' WHEN event_id % 2 = 0 THEN 'insert' ELSE 'update' END AS op
  FROM (SELECT user_id % 2000 AS user_id, event_id, event_type FROM events) WHERE event_id > (SELECT coalesce(max(event_id), -1) FROM events WHERE event_id = 1000)
), p AS (
  SELECT *, coalesce(last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'insert', false) AS there
  FROM f
), s AS (
  SELECT user_id, coalesce(max_by(op, ord) FILTER (WHERE op <> 'update') = 'insert', false) AS present,
         count(*) FILTER (WHERE op = 'insert' AND there) AS conflicts, count(*) FILTER (WHERE op <> 'insert' AND NOT there) AS skipped,
         max_by(kind, ord) FILTER (WHERE op = 'insert' AND NOT there OR op = 'update' AND there) AS kind
  FROM p GROUP BY 1
)
SELECT user_id, present, conflicts, skipped, CASE WHEN present THEN kind END AS kind FROM s
"""


def _half_of_files(spark: SparkSession, folder: str, before: Collection[str] = ()) -> int:
    """So many files a batch that the new ones in ``folder`` come in two batches, however many tasks wrote them."""
    new = [n for n in list_names(spark, folder) if n.startswith("part-") and n not in before]
    return max(1, -(-len(new) // 2))


def cdc2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed as a stream of files, applied by micro-batches; the final rows."""
    subscriber = P.StreamSubscriber(spark, "user_id", "ord")
    source = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    feed = _feed(spark, sf_dir)
    feed.repartition(max(4, feed.rdd.getNumPartitions()), "ord").write.parquet(source)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", _half_of_files(spark, source)).parquet(source)
    published = P.publish(stream, ["insert", "update", "delete", "truncate"])
    subscriber.start(published, f"{source}-checkpoint").awaitTermination()
    return subscriber.state()


def cdc2_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed in two runs of the stream: the second one is another subscriber, which has the name only."""
    name = uuid.uuid4().hex
    source = f"{shared_folder(spark)}/feed-{name}"
    feed = _feed(spark, sf_dir)
    for half in (0, 1):
        before = set(list_names(spark, source))
        feed.filter(F.col("ord") % 2 == half).write.mode("append").parquet(source)
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", _half_of_files(spark, source, before)).parquet(source)
        P.StreamSubscriber(spark, "user_id", "ord", name=name).start(stream, f"{source}-checkpoint").awaitTermination()
    return P.StreamSubscriber(spark, "user_id", "ord", name=name).state()


def cdc_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-local rules on a stream: violations of the feed, counted after the stream has ended."""
    from ..operators import checks as C

    source = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    folder = f"{shared_folder(spark)}/checked-{uuid.uuid4().hex}"
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    rules = [*C.not_null("value"), C.check("bounded", "value < 50"), C.enum("event_type", ["click", "view"])]
    bad = C.violations(stream, rules).select("event_id", "rule")
    query = bad.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id bigint, rule string").parquet(f"{folder}/out").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "udf1_scalar_function": udf1,
    "udf1_overloads": udf1_overloads,
    "udf2_table_function": udf2,
    "udf3_window_function": udf3,
    "udf3_user_window": udf3_user,
    "agg3_moving_inverse": agg3_inverse,
    "agg3_moving_maximum": agg3_maximum,
    "agg3_moving_one_partition": agg3_one_partition,
    "agg1_user_aggregate": agg1,
    "agg1_ordered_fold": agg1_ordered_fold,
    "agg2_partial_aggregate": agg2,
    "agg3_moving_aggregate": agg3,
    "agg4_ordered_set": agg4,
    "agg4_percentiles_and_mode": agg4_mode,
    "agg5_hypothetical_set": agg5,
    "agg6_sort_operator": agg6,
    "opr1_operator_join": opr1,
    "opr1_inequality_join": opr1_inequality,
    "opr1_band_join": opr1_band,
    "opr1_operator_laws": opr1_laws,
    "col1_collation": col1,
    "col1_accent_insensitive": col1_accents,
    "col1_locale_order": col1_order,
    "txt1_lexemes": txt1,
    "txt1_match": txt1_match,
    "txt1_headline": txt1_headline,
    "src1_foreign_table": src1,
    "src1_option_overlay": src1_overlay,
    "src1_foreign_columns": src1_columns,
    "src2_seed_load": src2,
    "src3_generate_fixtures": src3,
    "cdc1_publish": cdc1,
    "cdc2_subscribe": cdc2,
    "cdc2_subscribe_stream": cdc2_stream,
    "cdc2_subscribe_restart": cdc2_restart,
    "cdc_stream_rules": cdc_windowed,
}
SQL = {
    "src3_generate_fixtures": SQL_SRC3,
    "udf1_scalar_function": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 2 THEN CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) END AS own, CAST(round(l_extendedprice * (1 - CAST(0.1 AS DOUBLE)) * 100) AS BIGINT) AS usual FROM lineitem",
    "udf1_overloads": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey * 7 AS week, CASE WHEN o_orderkey % 9 <> 0 THEN length(o_orderpriority) END AS letters, year(o_orderdate) AS year FROM orders",
    "udf2_table_function": "SELECT o_orderkey, CAST(n AS INTEGER) AS n, o_orderkey % 100 + n AS share FROM (SELECT o_orderkey, unnest(generate_series(1, o_orderkey % 3 + 1)) AS n FROM orders)",
    "udf3_window_function": "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM events",
    "udf3_user_window": SQL_CENTS + "SELECT event_id, row_number() OVER w AS place, CASE WHEN count(cents) OVER w > 0 THEN count(cents) OVER w END AS n, CAST(sum(cents) OVER w AS BIGINT) AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "agg3_moving_inverse": SQL_CENTS + "SELECT event_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS last7 FROM e",
    "agg3_moving_maximum": SQL_CENTS + "SELECT event_id, max(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS top7 FROM e",
    "agg3_moving_one_partition": SQL_CENTS + "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, max(cents) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS top FROM e",
    "agg1_user_aggregate": SQL_AGG,
    "agg1_ordered_fold": SQL_FOLD,
    "agg4_percentiles_and_mode": SQL_AGG4_MODE,
    "src1_option_overlay": SQL_SRC1_OVERLAY,
    "src1_foreign_columns": SQL_SRC1_COLUMNS,
    "agg2_partial_aggregate": SQL_AGG,
    "agg3_moving_aggregate": "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS last7 FROM events",
    "agg4_ordered_set": "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.9) AS high FROM lineitem GROUP BY 1",
    "agg5_hypothetical_set": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice < 1500) + 1 AS rank, count(DISTINCT CASE WHEN o_totalprice < 1500 THEN o_totalprice END) + 1 AS dense_rank FROM orders GROUP BY 1",
    "agg6_sort_operator": "WITH p AS (SELECT o_custkey, list_position(['5-LOW', '3-MEDIUM', '1-URGENT', '4-NOT SPECIFIED', '2-HIGH'], o_orderpriority) AS r FROM orders) SELECT o_custkey, ['5-LOW', '3-MEDIUM', '1-URGENT', '4-NOT SPECIFIED', '2-HIGH'][max(r)] AS highest, ['5-LOW', '3-MEDIUM', '1-URGENT', '4-NOT SPECIFIED', '2-HIGH'][min(r)] AS lowest FROM p GROUP BY 1",
    "opr1_operator_join": "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_size * a.p_size AS x FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1",
    "opr1_inequality_join": "SELECT s_suppkey, count(*) AS n, min(c_custkey) AS first FROM customer JOIN supplier ON c_acctbal < s_acctbal AND c_custkey >= s_suppkey * 10 GROUP BY 1",
    "opr1_band_join": "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_totalprice < b.o_totalprice AND a.o_totalprice + 0.25 > b.o_totalprice",
    "opr1_operator_laws": "SELECT 0 AS commutator_breaks, count(*) FILTER (WHERE p_size = p_partkey * 7 % 50) AS negator_breaks FROM part",
    "col1_collation": "SELECT upper(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1",
    "col1_accent_insensitive": "SELECT upper(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
    "col1_locale_order": "SELECT p_partkey, ['cote', 'coté', 'côte', 'côté'][p_partkey % 4 + 1] AS word, row_number() OVER (ORDER BY p_partkey % 4, p_partkey) AS france, row_number() OVER (ORDER BY [1, 3, 2, 4][p_partkey % 4 + 1], p_partkey) AS canada FROM part",
    "txt1_lexemes": "WITH w AS (SELECT doc_id, unnest(t) AS lexeme, unnest(range(1, len(t) + 1)) AS position FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)) SELECT lexeme, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(min(position) AS INTEGER) AS first FROM w WHERE lexeme NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ") GROUP BY 1",
    "txt1_match": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) SELECT doc_id, 'and' AS mode FROM t WHERE list_contains(t, 'when') UNION ALL SELECT doc_id, 'or' FROM t WHERE list_contains(t, 'license') OR list_contains(t, 'token')",
    "txt1_headline": r"SELECT doc_id, md5(regexp_replace(text, '(?i)\b(license|token)\b', '<b>\1</b>', 'g')) AS marked FROM documents",
    "src1_foreign_table": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "src2_seed_load": "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS c_name, c_acctbal FROM customer",
    "cdc1_publish": "SELECT event_id AS ord, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'insert' END AS op FROM events WHERE event_id <> 1000 AND (event_id % 5 = 0 OR event_id % 2 = 0)",
    "cdc2_subscribe": SQL_CDC2,
    "cdc2_subscribe_stream": "SELECT user_id, kind FROM (" + SQL_CDC2 + ") WHERE present",
    "cdc2_subscribe_restart": "SELECT user_id, kind FROM (" + SQL_CDC2 + ") WHERE present",
    "cdc_stream_rules": "SELECT 'not_null:value' AS rule, count(*) AS n FROM events WHERE value IS NULL HAVING count(*) > 0 UNION ALL SELECT 'bounded', count(*) FROM events WHERE value >= 50 HAVING count(*) > 0 UNION ALL SELECT 'enum:event_type', count(*) FROM events WHERE event_type NOT IN ('click', 'view') HAVING count(*) > 0",
}
