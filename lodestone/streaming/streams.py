"""Structured Streaming forms of the queue's behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, sf_dir: str, name: str, at: str) -> DataFrame:
    """A table's files as a stream, with `at` as a time that watermarks take."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a table is one file or a folder of files
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def once_each(events: DataFrame, id_col: str, at: str, delay: str = "24 hours") -> DataFrame:
    """Events without repeated deliveries of the same id within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])


def in_skew(events: DataFrame, occurred: str, received: str, seconds: int = 86_400) -> DataFrame:
    """Drops events too early or too late; a watermark bounds only one side."""
    return events.where(F.abs(F.unix_micros(occurred) - F.unix_micros(received)) <= seconds * 1_000_000)


def rates(events: DataFrame, key: str, at: str, width: str = "60 seconds", limit: int = 6) -> DataFrame:
    """Events by key and window, and how many exceed the limit. Works on streams (with a watermark) and on tables."""
    out = events.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))


def routed(batch: DataFrame, kind: str, sinks: dict[str, Callable[[DataFrame], None]], attempts: str, most: int = 3) -> None:
    """For foreachBatch: sends each kind to its sink, and what failed `most` times or has no sink to `dead`."""
    batch = batch.persist()
    try:
        spent = (F.col(attempts) >= most) | ~F.coalesce(F.col(kind).isin(*[k for k in sinks if k != "dead"]), F.lit(False))
        for name, sink in sinks.items():
            sink(batch.where(spent) if name == "dead" else batch.where(~spent & (F.col(kind) == name)))
    finally:
        batch.unpersist()


def leases(claims: DataFrame, key: str, schema_key: str, seconds: int = 300, most: int = 3) -> DataFrame:
    """claims (key, at, attempt) as granted, held (a lease runs) or failed (attempts spent), by event time and state.

    A key's claims of one trigger are put in order as a whole, however many Arrow batches they come in: two numbers a claim are in memory at once.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        parts = [pd.DataFrame({"at": pdf["at"].astype("datetime64[us]").astype("int64"), "attempt": pdf["attempt"]}) for pdf in batches]
        rows, verdicts = pd.concat(parts).sort_values(["at", "attempt"], kind="stable"), []
        for at, attempt in zip(rows["at"], rows["attempt"], strict=True):
            if attempt > most:
                verdicts.append("failed")
            elif at < until:
                verdicts.append("held")
            else:
                verdicts.append("granted")
                until = int(at) + seconds * 1_000_000
        state.update((until,))
        yield pd.DataFrame({key: [keys[0]] * len(rows), "attempt": rows["attempt"].astype("int32").to_numpy(), "verdict": verdicts})

    return claims.groupBy(key).applyInPandasWithState(step, f"{key} {schema_key}, attempt int, verdict string", "until long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet in a shared folder, and reads that."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
