"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import board
from ..sources.tables import table
from .registry import query

EVENT_NAMES = ["signup", "view", "click", "purchase", "error", "checkout_opened", "checkout_completed"]


@query("""
WITH names AS (SELECT unnest(['signup', 'view', 'click', 'purchase', 'error', 'checkout_opened', 'checkout_completed']) AS event_type),
got AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY event_type)
SELECT event_type, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(people, 0) AS BIGINT) AS people FROM names LEFT JOIN got USING (event_type)
""")
def event_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.count_vector(table(spark, sf_dir, "events"), board.names(spark, EVENT_NAMES, "event_type"), "event_type", "user_id")


@query("""
SELECT coalesce(c_mktsegment, 'none') AS segment, count(*) AS n_orders,
       CAST(sum(CASE WHEN o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 1 ELSE 0 END) AS BIGINT) AS n_tolerant,
       CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 1 ELSE 0 END) AS BIGINT) AS n_strict
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = ["1-URGENT", "5-LOW"]
    keep = lambda null: F.count_if(board.excluded(F.col("o_orderpriority"), out, null))
    return rows.groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count("*").alias("n_orders"), keep(True).alias("n_tolerant"), keep(False).alias("n_strict"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def never_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def pending_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("""
WITH a AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 200),
b AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY ts DESC, event_id DESC LIMIT 200
""")
def recent_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parts = [events.where(F.col("event_type") == t).select("event_id", "user_id", "ts", "event_type") for t in ("purchase", "error")]
    out = board.recent(parts, [F.desc("ts"), F.desc("event_id")], 200)
    return out.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH last AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, epoch_us(ts) AS at_us FROM last ORDER BY ts DESC, user_id LIMIT 20
""")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return board.newest_of_each(rows, "user_id", "ts", 20).select("user_id", F.unix_micros("ts").alias("at_us"))


_CALLS = "SELECT l_returnflag AS role, CASE WHEN l_discount > 0 THEN CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) END AS cost, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem"


@query(f"""
WITH calls AS ({_CALLS}), g AS (
SELECT CASE WHEN grouping(role) = 1 THEN 'total' ELSE role END AS role, count(*) AS calls, count(cost) AS priced_calls, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens
FROM calls GROUP BY ROLLUP (role))
SELECT *, calls > 0 AND calls = priced_calls AS complete, format('{{:d}}.{{:06d}}', cost // 1000000, cost % 1000000) AS usd FROM g
""")
def role_bill_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("role"), F.when(F.col("l_discount") > 0, F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100 + 0.5)).cast("long").alias("cost"), F.col("l_quantity").cast("long").alias("tokens"))
    return board.bill(rows, "role", "cost", "tokens")


@query(f"WITH calls AS ({_CALLS}) SELECT role, count(*) AS calls, CASE WHEN count(cost) = count(*) THEN CAST(sum(cost) AS BIGINT) END AS billed FROM calls GROUP BY role")
def poisoned_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("role"), F.when(F.col("l_discount") > 0, F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100 + 0.5)).cast("long").alias("cost"))
    return rows.groupBy("role").agg(F.count("*").alias("calls"), board.poisoned_sum(F.col("cost")).alias("billed"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders),
f AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM o WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o.o_orderkey, CASE WHEN f.first_order IS NULL THEN 'never' WHEN f.first_order = o.o_orderkey THEN 'free' ELSE 'paid' END AS billing, coalesce(n_name, 'unknown') AS nation, epoch_us(o_orderdate) AS at_us
FROM o LEFT JOIN f USING (o_custkey) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200
""")
def owner_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest runs with who paid: outer joins, an anti-join, a projection by join presence, top 200."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    first = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    bad = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    top = orders.join(bad, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").orderBy(F.desc("at"), F.desc("o_orderkey")).limit(200)
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    out = top.join(first, "o_custkey", "left").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    billing = F.when(F.col("first_order").isNull(), "never").when(F.col("first_order") == F.col("o_orderkey"), "free").otherwise("paid")
    return out.select("o_orderkey", billing.alias("billing"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.unix_micros("at").alias("at_us"))


@query("""
SELECT n_name AS nation, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments, greatest(0, count(*) - CAST(count(CASE WHEN c_acctbal < 0 THEN 1 END) * 2 AS BIGINT)) AS paid
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def derived_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"), F.greatest(F.lit(0), F.count("*") - F.count_if(F.col("c_acctbal") < 0) * 2).alias("paid"))
