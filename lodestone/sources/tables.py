"""Tables of a folder of Parquet files, and captured snapshots replayed as rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SNAPSHOT = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("requested_url", T.StringType()), T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()), T.StructField("content_type", T.StringType()), T.StructField("captured_at", T.TimestampType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType()),
    ]
)

#: The largest bodies that are read, in bytes, and content types by kind of snapshot.
BODY_CAPS = {"html": 2 << 20, "shopify_ajax": 1 << 20, "robots": 256 << 10}
CONTENT_TYPES = {"html": r"text/html|application/xhtml\+xml", "shopify_ajax": r"application/json|text/javascript|application/javascript", "robots": r"text/plain"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot_issue(kind: Column, status: Column, content_type: Column, body: Column) -> Column:
    """Why a captured body is not used; null where it is. The cap is of bytes, so it is checked before any parsing."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in BODY_CAPS.items() for x in kv]), kind)
    kinds = F.element_at(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]), kind)
    return F.when(~status.between(200, 299), "HTTP_STATUS").when(~F.regexp_like(F.lower(content_type), kinds), "CONTENT_TYPE").when(F.octet_length(body) > cap, "BODY_TOO_LARGE")


def kept_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: F.lower(k) == "x-robots-tag")


def collect_sources(snapshots: DataFrame, key: str = "capture_id") -> DataFrame:
    """One row for each usable HTML capture with its product JSON and robots text, or why one is missing.

    snapshots: key and the fields of SNAPSHOT. HTML must be usable; the others may fail and leave an error.
    """
    marked = snapshots.withColumn("issue", snapshot_issue(F.col("kind"), F.col("status"), F.col("content_type"), F.col("body")))
    html = marked.where("kind = 'html' AND issue IS NULL").select(key, "final_url", "captured_at", kept_headers(F.col("headers")).alias("headers"), F.col("body").alias("html"))
    out = html
    for kind, name in (("shopify_ajax", "ajax"), ("robots", "robots")):
        side = marked.where(F.col("kind") == kind).select(key, F.when(F.col("issue").isNull(), F.col("body")).alias(name), F.col("issue").alias("_issue"), F.lit(True).alias("_seen"))
        out = out.join(side, key, "left").withColumn(f"{name}_error", F.coalesce("_issue", F.when(F.col("_seen").isNull(), "NOT_CAPTURED"))).drop("_issue", "_seen")
    return out


def journal(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Recorded calls: replayed, changed (the request differs from the recorded one) or uncertain (no response yet).

    requests: call_id, request_sha, asked_sha; responses: call_id, body. A response is used only where it answers the same request.
    """
    state = F.when(F.col("request_sha") != F.col("asked_sha"), "changed").when(F.col("body").isNull(), "uncertain").otherwise("replayed")
    return requests.join(responses, "call_id", "left").withColumn("state", state).withColumn("body", F.when(F.col("state") == "replayed", F.col("body")))


def byte_range(spec: Column, size: Column) -> Column:
    """(first, last) of a byte range header over so many bytes; null where it can't be served."""
    a, b = F.regexp_extract(spec, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(spec, r"^bytes=(\d*)-(\d*)$", 2)
    first = F.when(a != "", a.try_cast("long")).when(b != "", F.greatest(F.lit(0), size - b.try_cast("long")))
    last = F.when((a != "") & (b != ""), F.least(b.try_cast("long"), size - 1)).otherwise(size - 1)
    return F.when(spec.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (first <= last) & (first < size), F.struct(first.alias("first"), last.alias("last")))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly to all cores: for tables of short rows that are much work each.

    A file's splits don't say how its rows lie: a row group is read by one task, however many splits it has.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if parts < cores else max(parts, 3 * cores))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a session in one process (`local`) may go without, and gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once and read from there: a lost executor's part is read again, not computed anew in another order."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
