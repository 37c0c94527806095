"""Balanced label propagation: documents move to their neighbours' shards under quotas, and counts end even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, table


def _by_shard(shard: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def propagate(state: DataFrame, shards: int, quota: int, rounds: int = 8, slack: float = 0.1) -> DataFrame:
    """Moves whole units. state: (unit, home, shard, n), n rows of `unit` that began in shard `home`.

    In each round a unit that is spread prefers the shard that holds most of its rows among those with room (ties: the
    lowest) and stays where none has. A shard's room is its quota with `slack`, which the final counts take back, less
    what it holds. One that is asked for more than its room and what may leave it accepts that share of the units,
    dealt by hash. What comes to the driver are counts by shard.
    """
    for step in range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [int(quota * (1 + slack)) - load.get(s, 0) for s in range(shards)]
        here = state.groupBy("unit", "shard").agg(F.sum("n").alias("n"))
        open_ = F.when(_by_shard(F.col("shard"), room) > 0, F.struct(F.col("n"), -F.col("shard")))
        total = here.groupBy("unit").agg(F.count("*").alias("parts"), F.max(open_).alias("best"))
        wish = cut(total.where("parts > 1 AND best IS NOT NULL").select("unit", (-F.col("best.col2")).cast("int").alias("goal")))
        asked = state.join(wish, "unit").where("shard <> goal").groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()
        if not asked:
            break
        come = [sum(r["n"] for r in asked if r["goal"] == s) for s in range(shards)]
        gone = [sum(r["n"] for r in asked if r["shard"] == s) for s in range(shards)]
        share = [min(1.0, max(0, room[s] + gone[s] // 2) / come[s]) if come[s] else 1.0 for s in range(shards)]
        u = F.pmod(F.xxhash64("unit", F.lit(step)), F.lit(1 << 30)) / float(1 << 30)
        accepted = wish.where(u < F.element_at(F.array(*[F.lit(x) for x in share]), F.col("goal") + 1))
        state = cut(state.join(accepted, "unit", "left").withColumn("shard", F.coalesce("goal", "shard")).select("unit", "home", "shard", "n"))
    return state


def ranked(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with `place`, the position from 0 in the order within key. Rows are sorted over all partitions; only counts
    by partition and key, of which there are partitions x keys, are gathered to number them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [key, *order]
    dealt = cut(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = dealt.groupBy("_part", key).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    # partitions x keys rows; beyond a million of them Spark shuffles
    parts = F.broadcast(parts) if n * df.select(key).distinct().count() <= 1_000_000 else parts
    return dealt.join(parts, ["_part", key]).withColumn("place", F.col("_at") - F.col("_from") + F.col("_before")).drop("_part", "_at", "_from", "_before")


def shard_rows(docs: DataFrame, shards: int = 8, rounds: int = 8, unit_share: int = 2, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Deals docs (doc_id, text; more columns are ignored) to shards whose counts are at most one apart.

    Documents of equal text are neighbours. A group of more than 1/unit_share of a shard is split by hash into units
    below that, so no group meets in one task. Null text has size 1, checksum 0 and the neighbours of the empty
    text; repeated rows and rows without doc_id are dealt each for itself; an empty table gives no rows.
    Groups and units are broadcast only after they were counted as at most `broadcast_rows`; Spark splits hot ones beyond that.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law has none), group_rows.
    """
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    base = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"), F.monotonically_increasing_id().alias("row")))
    n = base.count()
    quota = max(1, n // shards)
    group = ["h", "text_crc32", "size"]
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    sizes = cut(base.groupBy(*group).agg(F.count("*").alias("group_rows")).where("group_rows > 1"))
    limit = max(1, quota // unit_share)
    rows = base.join(small(sizes), group, "left").withColumn("group_rows", F.coalesce("group_rows", F.lit(1)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    part = F.pmod(F.xxhash64("row", F.lit("part")), F.ceil(F.col("group_rows") / F.lit(limit)))
    rows = cut(rows.withColumn("unit", F.when(F.col("group_rows") > 1, F.xxhash64(*group, part))))
    state = cut(rows.where("unit IS NOT NULL").groupBy("unit", "home").agg(F.count("*").alias("n")).withColumn("shard", F.col("home")).select("unit", "home", "shard", "n"))
    moved = propagate(state, shards, quota, rounds).select("unit", "home", F.col("shard").alias("goal"))
    placed = rows.join(small(moved), ["unit", "home"], "left").withColumn("shard", F.coalesce("goal", "home")).withColumn("free", F.col("unit").isNull()).withColumn("mix", F.coalesce("unit", F.xxhash64("row", F.lit("mix")))).drop("goal", "home")
    placed = cut(placed)
    have = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    have = [have.get(s, 0) for s in range(shards)]
    want = [n // shards + (s < n % shards) for s in range(shards)]
    over = [max(0, a - b) for a, b in zip(have, want, strict=True)]
    under = [max(0, b - a) for a, b in zip(have, want, strict=True)]
    # rows beyond a shard's count, those without neighbours first, fill the places that others lack
    p = ranked(placed, "shard", "free", "mix", "row")
    spare = F.col("place") - _by_shard(F.col("shard"), want) + _by_shard(F.col("shard"), [sum(over[:s]) for s in range(shards)])
    goal, slot = F.lit(0), F.lit(0)
    for s in reversed(range(shards)):
        if under[s]:
            inside = F.col("spare") >= sum(under[:s])
            goal = F.when(inside & (F.col("spare") < sum(under[: s + 1])), s).otherwise(goal)
            slot = F.when(inside & (F.col("spare") < sum(under[: s + 1])), F.col("spare") - sum(under[:s]) + have[s]).otherwise(slot)
    stays = F.col("place") < _by_shard(F.col("shard"), want)
    p = p.withColumn("spare", spare)
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(stays, F.col("shard")).otherwise(goal).cast("int").alias("shard"), F.when(stays, F.col("place")).otherwise(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_rows")


def op8_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
