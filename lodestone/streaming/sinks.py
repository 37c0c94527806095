"""Sinks that a replayed batch leaves as they are: each batch owns its partitions and overwrites them as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Kinds of stored artifacts that may be read back.
KINDS = ("html", "shopify_ajax", "robots", "record", "technical_check", "collection")


def artifacts(collections: DataFrame, key: str, bodies: dict[str, Column]) -> DataFrame:
    """A row for each body (text or bytes) that a collection has: key, kind, captured_at, body, sha256 (lower-case hex), bytes. Null bodies have none."""
    unknown = set(bodies) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), b.cast("binary").alias("body")) for k, b in bodies.items()]), lambda x: x["body"].isNotNull())).alias("a")
    rows = collections.select(key, "captured_at", each).select(key, "a.kind", "captured_at", "a.body")
    return rows.withColumn("sha256", F.sha2("body", 256)).withColumn("bytes", F.octet_length("body").cast("long"))


def findings(collections: DataFrame, key: str, origins: dict[str, str]) -> DataFrame:
    """key, origin, ord, code, severity of the findings that each origin's column (an array of code and severity) lists."""
    parts = [collections.select(key, F.lit(o).alias("origin"), F.posexplode(c).alias("ord", "f")).select(key, "origin", "ord", "f.code", "f.severity") for o, c in origins.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_batch(rows: DataFrame, batch_id: int, folder: str, by: tuple[str, ...] = ()) -> None:
    """Writes rows as batch `batch_id` of a table in the shared folder: what an earlier try of the batch wrote is replaced, other batches stay."""
    rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(folder)


def store(folder: str, key: str, bodies: dict[str, Column], origins: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch of collections into the tables `artifacts` (by kind) and `findings` below folder."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_batch(artifacts(batch, key, bodies), batch_id, f"{folder}/artifacts", ("kind",))
            write_batch(findings(batch, key, origins), batch_id, f"{folder}/findings")
        finally:
            batch.unpersist()

    return keep


def first_artifacts(spark: SparkSession, folder: str, key: str, kind: str) -> DataFrame:
    """The first artifact of a kind of each collection by capture time, ties by content: key, captured_at, body, sha256, bytes. Only the kind's partitions are read."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    rows = spark.read.parquet(f"{folder}/artifacts").where(F.col("kind") == kind)
    best = rows.groupBy(key).agg(F.min(F.struct("captured_at", "sha256", "bytes", "body")).alias("a"))
    return best.select(key, "a.captured_at", "a.body", "a.sha256", "a.bytes")


def upserted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows written in batches, each key's last by batch and then order, as a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *order)).alias("r"))
    return best.select(*keys, *[f"r.{c}" for c in rest if c != "batch"])
