"""Stored batches: replays change nothing, other batches stay, upserts take the last write."""

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import sinks


def test_replayed_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 6), (1, "b", 4)], "k long, body string, at long").withColumn("captured_at", F.timestamp_seconds("at"))
    rows = rows.withColumn("t", F.array(F.struct(F.lit("X").alias("code"), F.lit("error").alias("severity")))).withColumn("r", F.array().cast("array<struct<code:string,severity:string>>"))
    keep = sinks.store(str(tmp_path), "k", {"html": F.col("body")}, {"technical": "t", "record": "r"})
    keep(rows.where("at = 5"), 0)
    keep(rows.where("at <> 5"), 1)
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/artifacts").select("k", "kind", "sha256", "batch").collect())
    once = read()
    keep(rows.where("at = 5"), 0)
    keep(rows.where("at <> 5"), 1)
    assert read() == once and len(once) == 2 and spark.read.parquet(f"{tmp_path}/findings").count() == 3
    assert [tuple(r) for r in sinks.first_artifacts(spark, str(tmp_path), "k", "html").select("k", "bytes", F.decode("body", "UTF-8")).collect()] == [(1, 1, "b")]
    with pytest.raises(ValueError):
        sinks.first_artifacts(spark, str(tmp_path), "k", "secrets")


def test_upserts(spark):
    rows = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 0, "y"), ("b", 0, 2, "z"), ("b", 0, 1, "w"), (None, 0, 0, None)], "k string, batch long, ord long, v string")
    assert sorted((tuple(r) for r in sinks.upserted(rows, ["k"], ["ord"]).select("k", "v").collect()), key=repr) == [("a", "y"), ("b", "z"), (None, None)]
