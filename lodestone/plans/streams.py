"""Streaming queries, each over all events that are there, and their table forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import shared_folder, table
from ..streaming import settlement, sinks, streams
from .registry import query


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type FROM events")
def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice and comes out once."""
    events = streams.source(spark, sf_dir, "events", "ts")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return streams.drain(streams.once_each(twice, "event_id", "ts"), _folder(spark)).select("event_id", "user_id", "event_type")


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 60 SECOND, ts)) AS start_us, count(*) AS n, greatest(0, count(*) - 1) AS rejected FROM events GROUP BY ALL")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.rates(rows, "user_id", "ts", "60 seconds", 1).select("user_id", F.unix_micros("start").alias("start_us"), "n", "rejected")


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 60 SECOND, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream in complete mode, kept by a table sink's last state."""
    events = streams.source(spark, sf_dir, "events", "ts")
    folder = _folder(spark)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    counted = streams.rates(events, "user_id", "ts", "60 seconds", 1)
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT event_id FROM events WHERE abs(CAST(floor((value - 50) * 7200) AS BIGINT)) <= 86400")
def skew_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("received"), F.floor((F.col("value") - 50) * 7200).cast("long").alias("off"))
    moved = events.withColumn("occurred", F.timestamp_micros(F.unix_micros("received") + F.col("off") * 1_000_000))
    return streams.in_skew(moved, "occurred", "received").select("event_id")


@query()
def lease_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event type as the job, each event a claim; custom state has no SQL, so tests compare it with a plain loop."""
    events = streams.source(spark, sf_dir, "events", "ts")
    claims = events.select("event_type", F.col("ts").alias("at"), (F.col("event_id") % 5).cast("int").alias("attempt"))
    return streams.drain(streams.leases(claims, "event_type", "string"), _folder(spark))


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000 THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY user_id, k
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


_ROLE_KINDS = ("claimed", "limited", "settled", "claimed", "limited")


@query()
def role_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as claims, rate limits and settlements of two roles, a second apart for each minute; timers have no SQL, so tests compare with a plain loop."""
    events = streams.source(spark, sf_dir, "events", "ts")
    at = F.timestamp_micros(F.floor(F.unix_micros("ts") / 60).cast("long"))
    kind = F.element_at(F.array(*[F.lit(x) for x in _ROLE_KINDS]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = events.select("user_id", F.when(F.col("event_id") % 2 == 0, "searcher").otherwise("controller").alias("role"), at.alias("at"), kind.alias("kind"))
    with settlement.rocksdb(spark):
        return streams.drain(settlement.settlements(rows, "user_id"), _folder(spark))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder that the pages went to: as a stream in batches, the first of which is then delivered once more."""
    # a table is one file or a folder of files
    pages, folder = table(spark, sf_dir, "pages"), _folder(spark)
    stream = spark.readStream.schema(pages.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/pages.parquet*")
    flag = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    long = F.length("html") > 3000
    rows = stream.withColumns({
        "collection": F.col("page_id") % 100, "captured_at": F.timestamp_seconds(F.col("page_id")), "technical": F.array_compact(F.array(flag(long, "PAGE_NOINDEX", "error"), flag(F.col("page_id") % 3 == 0, "ROBOTS_UNAVAILABLE", "warning"))),
        "record": F.array_compact(F.array(flag(~long, "MISSING_CANONICAL", "warning"))),
    })
    bodies = {"html": F.col("html"), "record": F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"url":"'), "url", F.lit('"}')))}
    keep, first = sinks.store(folder, "collection", bodies, {"technical": "technical", "record": "record"}), []

    def twice(batch: DataFrame, batch_id: int) -> None:
        keep(batch, batch_id)
        if not first:
            first.append(batch_id)
            keep(batch, batch_id)

    rows.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder


@query("""
WITH a AS (SELECT page_id % 100 AS collection, 'html' AS kind, page_id AS t, html AS body FROM pages WHERE html IS NOT NULL UNION ALL SELECT page_id % 100, 'record', page_id, '{"url":"' || url || '"}' FROM pages WHERE page_id % 2 = 0)
SELECT collection, kind, min(t) AS first_at, arg_min(sha256(body), t) AS sha256, CAST(arg_min(octet_length(encode(body)), t) AS BIGINT) AS bytes FROM a GROUP BY ALL
""")
def stored_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stored(spark, sf_dir)
    each = [sinks.first_artifacts(spark, folder, "collection", k).select("collection", F.lit(k).alias("kind"), F.unix_seconds("captured_at").alias("first_at"), "sha256", "bytes") for k in ("html", "record")]
    return each[0].unionByName(each[1])


@query("""
WITH p AS (SELECT page_id, page_id % 100 AS collection, length(html) > 3000 AS long FROM pages),
f AS (SELECT collection, 'technical' AS origin, 'PAGE_NOINDEX' AS code, 'error' AS severity FROM p WHERE long UNION ALL SELECT collection, 'technical', 'ROBOTS_UNAVAILABLE', 'warning' FROM p WHERE page_id % 3 = 0 UNION ALL SELECT collection, 'record', 'MISSING_CANONICAL', 'warning' FROM p WHERE NOT long)
SELECT collection, origin, code, severity, count(*) AS n FROM f GROUP BY ALL
""")
def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_stored(spark, sf_dir)}/findings").groupBy("collection", "origin", "code", "severity").agg(F.count("*").alias("n"))
