"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in one process (`local`) may go without: it gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints df in the shared folder, so that later steps read it instead of computing it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, for a function of Arrow batches: the session hands over at most `rows` rows at once, so that long texts don't fill executors and workers.

    Sets spark.sql.execution.arrow.maxRecordsPerBatch where it is larger; a smaller setting stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that Python objects are made for few rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release() -> None:
    """Gives memory that a worker has freed back to the system; idle workers would keep it from the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this system's C library


def releasing(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, a function of a partition's batches, with release() at the end of each task."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a and b (not null) of one orderable type. Returns (node, root) with the smallest
    node of each component as root, for every node that has an edge to another node. Each step keeps
    at most as many rows as there are edges; a hub's rows are aggregated with map-side combine before
    they are joined, and the join may be split by AQE. The steps end by themselves, in a number that grows with the logarithm of the nodes.
    """
    pair = lambda x, y: F.struct(F.least(x, y).alias("b"), F.greatest(x, y).alias("a"))
    cur = cut(edges.where("a <> b").select(pair(F.col("a"), F.col("b")).alias("p")).select("p.a", "p.b").distinct())
    seen = None
    while True:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        cur = cut(small.where("a <> b").distinct())
        now = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("count(DISTINCT a)")).first()
        # settled: every node points to one root only, and two steps in a row gave the same edges
        if now == seen and now[0] == now[2]:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
