"""Credit queries: orders stand for operations, reservations and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import stable_uuid
from ..operators import folds, ledger, machines
from ..sources.tables import table
from .registry import query

_CENTS = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("credits", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long"))


@query(f"""
WITH s AS (SELECT o_custkey AS c, sum(CASE WHEN o_orderstatus = 'O' THEN {_CENTS} ELSE -{_CENTS} END) AS settled FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1),
h AS (SELECT o_custkey AS c, sum({_CENTS}) AS reserved FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, CAST(coalesce(settled, 0) AS BIGINT) AS settled, CAST(coalesce(reserved, 0) AS BIGINT) AS reserved,
       CAST(greatest(0, coalesce(settled, 0) - coalesce(reserved, 0)) AS BIGINT) AS available
FROM customer LEFT JOIN s ON s.c = c_custkey LEFT JOIN h ON h.c = c_custkey
""")
def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey")
    kind = F.when(F.col("o_orderstatus") == "O", "grant").otherwise("usage")
    operations = orders.where("o_orderstatus IN ('O', 'F')").select("c_custkey", kind.alias("kind"), F.lit(True).alias("completed"), "credits")
    return ledger.balances(table(spark, sf_dir, "customer"), operations, orders.where("o_orderstatus = 'P'").select("c_custkey", F.lit("reserved").alias("status"), "credits"), "c_custkey")


@query(f"""
WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, {_CENTS} AS credits, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (
  SELECT o_custkey, o_orderkey, credits, n, credits <= 40000000 AS admitted, CASE WHEN credits <= 40000000 THEN credits ELSE 0 END AS used FROM r WHERE n = 1
  UNION ALL
  SELECT r.o_custkey, r.o_orderkey, r.credits, r.n, f.used + r.credits <= 40000000, f.used + CASE WHEN f.used + r.credits <= 40000000 THEN r.credits ELSE 0 END
  FROM f JOIN r ON r.o_custkey = f.o_custkey AND r.n = f.n + 1)
SELECT o_custkey, o_orderkey AS id, credits, admitted, CAST(used AS BIGINT) AS used FROM f
""")
def ledger_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("id"), "credits", F.col("o_orderdate").cast("timestamp").alias("at"))
    return folds.admissions(requests, "o_custkey", ["at", "id"], 40_000_000)


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS q,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS running_q, sum(CAST(l_quantity AS BIGINT)) OVER w <= 100 AS within
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING)
""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    out = ledger.budget_prefix(rows, "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"], {"q": 100})
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "q", "running_q", "within")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.insert_or_ignore(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
WITH f AS (SELECT event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1),
d AS (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS day_rank FROM f)
SELECT e.event_id, d.day_rank, CASE WHEN d.day_rank IS NULL THEN 'ALREADY_GRANTED' WHEN d.day_rank > 25 THEN 'DAILY_CAP' ELSE 'GRANTED' END AS reason
FROM events e LEFT JOIN d USING (event_id)
""")
def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ledger.daily_grants(rows, "user_id", "ts", "event_id", 25).select("event_id", F.col("rank").alias("day_rank"), "reason")


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT o_orderkey AS transaction_id, CASE WHEN n IS NULL THEN 'NO_GRANT' WHEN n > 1 THEN 'REPEATED_GRANT' ELSE 'WRONG_AMOUNT' END AS issue
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey WHERE n IS NULL OR n > 1 OR q <> 25
""")
def purchase_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.lit(25).cast("long").alias("credits"))
    grants = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("transaction_id"), F.col("l_quantity").cast("long").alias("credits"))
    return ledger.purchase_audit(purchases, grants)


@query("""
WITH h AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || ':' || o_orderpriority) AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", stable_uuid(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority")).alias("id"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'view' THEN 'reserve' WHEN 'click' THEN 'consume' WHEN 'error' THEN 'release' WHEN 'purchase' THEN 'compensate' ELSE 'other' END AS a FROM events),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS seq, 'absent' AS state, '' AS outcome FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT f.user_id, e.seq,
    CASE WHEN a = 'reserve' AND state = 'absent' THEN 'reserved' WHEN a = 'consume' AND state = 'reserved' THEN 'consumed' WHEN a = 'release' AND state = 'reserved' THEN 'released' WHEN a = 'compensate' AND state = 'consumed' THEN 'compensated' ELSE state END,
    CASE WHEN a = 'reserve' THEN CASE state WHEN 'absent' THEN 'admitted' WHEN 'released' THEN 'replay_released' WHEN 'compensated' THEN 'refused' ELSE 'replay' END
      WHEN a = 'consume' THEN CASE state WHEN 'reserved' THEN 'consumed' WHEN 'consumed' THEN 'unchanged' ELSE 'refused' END WHEN a = 'release' THEN CASE state WHEN 'reserved' THEN 'released' WHEN 'released' THEN 'unchanged' ELSE 'refused' END
      WHEN a = 'compensate' THEN CASE state WHEN 'consumed' THEN 'compensated' WHEN 'compensated' THEN 'unchanged' ELSE 'refused' END ELSE 'refused' END
  FROM f JOIN e ON e.user_id = f.user_id AND e.seq = f.seq + 1)
SELECT user_id, seq, state, outcome FROM f WHERE seq > 0
""")
def reservation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as requests on one reservation."""
    names = {"view": "reserve", "click": "consume", "error": "release", "purchase": "compensate"}
    action = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")], F.lit("other"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", action.alias("action"))
    return machines.reservation_states(rows, "user_id", ["ts", "event_id"])
