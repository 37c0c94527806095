"""Queries over conversations and event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import board, folds, machines, profile, report
from ..sources.tables import table
from .registry import query


@query("""
WITH f AS (SELECT conv_id, min(CASE WHEN length(text) > 400 THEN turn END) AS first_retrieved, min(CASE WHEN role = 'assistant' AND length(text) > 200 THEN turn END) AS first_candidate,
  min(CASE WHEN contains(text, 'ion') AND role = 'user' THEN turn END) AS first_recommended, min(CASE WHEN text LIKE '%ing.' THEN turn END) AS first_final, count(*) AS n_turns FROM conversations GROUP BY conv_id)
SELECT *, CASE WHEN n_turns < 2 THEN 'inconclusive' WHEN first_final IS NOT NULL THEN 'final_choice' WHEN first_recommended IS NOT NULL THEN 'recommended' WHEN first_candidate IS NOT NULL THEN 'candidate' WHEN first_retrieved IS NOT NULL THEN 'retrieved' ELSE 'absent' END AS outcome FROM f
""")
def first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.length("text"), F.col("text")
    flags = {"retrieved": n > 400, "candidate": (F.col("role") == "assistant") & (n > 200), "recommended": t.contains("ion") & (F.col("role") == "user"), "final": t.endswith("ing.")}
    out = report.first_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", flags)
    return out.withColumn("outcome", report.outcome(F.col("first_final"), F.col("first_recommended"), F.col("first_candidate"), F.col("first_retrieved"), F.col("n_turns") < 2))


@query("SELECT conv_id, count(*) AS n, bool_and(turn = r - 1) AS contiguous FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id")
def turn_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("r")).groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(F.col("turn") == F.col("r") - 1).alias("contiguous"))


@query("""
WITH t AS (SELECT conv_id, turn, length(text) > 150 AS present, CASE WHEN role = 'user' THEN 'explore' ELSE 'compare' END AS action FROM conversations),
g AS (SELECT *, coalesce(max(CASE WHEN NOT present THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM t)
SELECT conv_id, turn, CASE WHEN present THEN 'seen' WHEN action = 'explore' THEN 'open' WHEN gone = 1 THEN 'closed' ELSE 'absent' END AS path FROM g
""")
def candidate_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return report.candidate_path(turns, "conv_id", "turn", F.length("text") > 150, F.when(F.col("role") == "user", "explore").otherwise("compare")).select("conv_id", "turn", "path")


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh FROM events),
i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT event_id, fresh, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1 AS idle FROM i
""")
def novelty_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return report.novelty(rows, "user_id", ["ts", "event_id"], "event_type").select("event_id", "fresh", F.col("idle").cast("long").alias("idle"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS t FROM events),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS t, 'draft' AS status, false AS dead FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT f.user_id, e.seq, e.t,
    CASE WHEN f.dead THEN f.status WHEN e.t = 'signup' AND f.status = 'draft' THEN 'protocol_ready' WHEN e.t = 'view' AND f.status = 'protocol_ready' THEN 'queued'
      WHEN e.t = 'purchase' AND f.status IN ('queued', 'running') THEN 'budget_exhausted' WHEN e.t = 'error' AND f.status IN ('draft', 'protocol_ready', 'queued', 'running') THEN 'cancelled' ELSE f.status END,
    f.dead OR NOT (e.t = 'signup' AND f.status = 'draft' OR e.t = 'view' AND f.status = 'protocol_ready' OR e.t = 'purchase' AND f.status IN ('queued', 'running') OR e.t = 'error' AND f.status IN ('draft', 'protocol_ready', 'queued', 'running'))
  FROM f JOIN e ON e.user_id = f.user_id AND e.seq = f.seq + 1)
SELECT user_id, seq, status, dead AS failed FROM f WHERE seq > 0
""")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"signup": "PROTOCOL_APPROVED", "view": "SESSION_QUEUED", "purchase": "BUDGET_EXHAUSTED", "error": "SESSION_CANCELLED", "click": "TURN_COMPLETED"}
    event = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", event.alias("event"), F.lit(None).cast("int").alias("ordinal"))
    return machines.session_states(rows, "user_id", order=["ts", "event_id"]).select("user_id", "seq", "status", F.col("error").isNotNull().alias("failed"))


@query()
def controller_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as assessed turns; the decision depends on all earlier ones, so tests check it by cases."""
    t = table(spark, sf_dir, "conversations")
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " "), lambda w: F.length(w) > 5)
    n = F.length("text")
    turns = t.select(
        "conv_id", "turn", F.when(n % 5 == 0, "finish").otherwise("verify").alias("proposed"), F.substring("text", 1, 20).alias("quote"), (n % 10 == 0).alias("quote_names_full"), (n % 13 == 0).alias("drift"),
        (n % 4).cast("int").alias("full"), (n % 7).cast("int").alias("plausible"), F.slice(words, 1, 3).alias("signatures"), F.slice(words, 1, (n % 3).cast("int")).alias("unresolved"), F.slice(words, 1, 1).alias("hard"),
    )
    return folds.decisions(turns, "conv_id")


@query("""
SELECT e.event_id, floor(e.gap / 1000000)::BIGINT AS gap_seconds FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) e WHERE floor(e.gap / 1000000) > 28800
""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return board.idle_gaps(rows, "user_id", "ts", "event_id", 28_800).select("event_id", F.col("gap_seconds").cast("long").alias("gap_seconds"))


@query("""
WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'discovery' WHEN role = 'assistant' THEN 'comparison' ELSE 'refinement' END AS stage, CASE WHEN n % 4 = 0 THEN 'execute' WHEN n % 4 = 1 THEN 'advance' WHEN n % 4 = 2 THEN 'reconcile' ELSE 'ignore' END AS replay FROM c
""")
def turn_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text") % 4
    action = F.when(F.col("role") == "user", "explore").when(F.col("role") == "assistant", "compare").otherwise("finish")
    status = F.when(n == 0, "reserved").when(n == 1, "completed").when(n == 2, "running").otherwise("failed")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", report.stage(action).alias("stage"), report.replay_action(status).alias("replay"))


@query("""
SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn, CAST(count(CASE WHEN length(text) < 60 THEN 1 END) AS BIGINT) AS short_turns,
  CASE WHEN count(CASE WHEN length(text) < 20 THEN 1 END) > 0 THEN 'blocked' ELSE 'complete' END AS gate FROM conversations GROUP BY conv_id
""")
def interruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.count_if(n < 60).alias("short_turns"), F.when(F.count_if(n < 20) > 0, "blocked").otherwise("complete").alias("gate"))


@query("""
WITH s AS (SELECT user_id, max(ts) AS updated_at, arg_max(event_type, ts) AS last FROM events GROUP BY user_id)
SELECT user_id AS session, epoch_us(updated_at) AS at_us FROM s WHERE last <> 'purchase' AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(updated_at) >= 480000000 ORDER BY updated_at, user_id LIMIT 20
""")
def stalled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("ts").cast("timestamp").alias("updated_at"), F.max_by("event_type", "ts").alias("last"))
    rows = last.select("session", "updated_at", F.lit("reserved").alias("status"), (F.col("last") == "purchase").alias("claimed"))
    return profile.stalled(rows, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("session", F.unix_micros("updated_at").alias("at_us"))


@query("""
WITH q AS (SELECT conv_id, turn, left(text, 12) AS quote FROM conversations WHERE role = 'assistant' AND length(text) >= 12),
o AS (SELECT DISTINCT q.conv_id, q.quote, max(q.turn) OVER (PARTITION BY q.conv_id, q.quote) AS t FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC, quote) AS k FROM o)
SELECT conv_id, string_agg(quote, '|' ORDER BY k) AS quotes FROM r WHERE k <= 3 GROUP BY conv_id
""")
def decision_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    claims = turns.where("role = 'assistant' AND length(text) >= 12").select(
        "conv_id", "turn", F.lit(0).alias("ord"), F.lit("required").alias("need_kind"), F.lit("supported").alias("status"), F.lit("cited_reference").alias("level"), F.substring("text", 1, 12).alias("quote"), F.col("turn").alias("quote_turn"))
    return profile.decision_evidence(claims, turns.select("conv_id", "turn", "text"), "conv_id").select("conv_id", F.array_join("quotes", "|").alias("quotes"))


@query("""
SELECT * FROM (VALUES ('generator', true, true, false, false), ('auditor', true, true, false, false), ('observer', false, true, true, false), ('classifier', false, true, true, false)) AS t(role, brief, transcript, identity, observations)
""")
def context_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.boundaries(spark)


@query("SELECT conv_id, CAST(count(CASE WHEN role = 'system' OR length(text) % 3 = 0 THEN 1 END) AS BIGINT) AS rejected, CASE WHEN count(CASE WHEN role = 'system' OR length(text) % 3 = 0 THEN 1 END) = 0 THEN 'accepted' WHEN count(CASE WHEN role = 'system' OR length(text) % 3 = 0 THEN 1 END) <= 2 THEN 'revise' ELSE 'failed_validation' END AS next FROM conversations GROUP BY conv_id")
def revision_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if((F.col("role") == "system") | (F.length("text") % 3 == 0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("rejected")).withColumn("next", profile.revision(F.col("rejected")))
