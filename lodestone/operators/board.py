"""Operator statistics: count vectors, exclusions, bills, recent lists, history of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def names(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A small table of fixed values with their order."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("ord", name))


def count_vector(events: DataFrame, vocabulary: DataFrame, name: str, person: str) -> DataFrame:
    """Counts by fixed name, 0 where there is none; other names are left out."""
    got = events.groupBy(name).agg(F.count("*").alias("n"), F.count_distinct(person).alias("people"))
    return vocabulary.join(got, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("people", F.lit(0)).alias("people"))


def excluded(c: Column, values: list[str], keep_null: bool) -> Column:
    """Whether a row stays: null counts as a guest and stays, or is dropped with the strict form; no values exclude nothing."""
    if not values:
        return F.lit(True)
    return F.coalesce(~c.isin(*values), F.lit(keep_null))


def recent(parts: list[DataFrame], order: list, most: int) -> DataFrame:
    """The newest rows of several lists; each is cut before they meet, and order must be total."""
    out = None
    for p in parts:
        p = p.orderBy(*order).limit(most)
        out = p if out is None else out.unionByName(p)
    return out.orderBy(*order).limit(most)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order, as a partial aggregate."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return best.select(key, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])


def newest_of_each(rows: DataFrame, key: str, at: str, most: int = 20) -> DataFrame:
    """The newest row of each key, of these the `most` newest."""
    return latest(rows, key, [at]).orderBy(F.desc(at), key).limit(most)


def bill(calls: DataFrame, role: str, cost: str, *sums: str) -> DataFrame:
    """Calls, priced calls and sums by role with a total row; unknown cost is not zero, and complete means that every call is priced.
    No calls give no rows."""
    known = F.count(cost)
    out = calls.rollup(role).agg(
        F.grouping(role).alias("is_total"), F.count("*").alias("calls"), known.alias("priced_calls"), F.coalesce(F.sum(cost), F.lit(0)).alias("cost"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums]
    )
    usd = F.format_string("%d.%06d", (F.col("cost") / 1_000_000).cast("long"), (F.col("cost") % 1_000_000).cast("long"))
    out = out.withColumn("complete", (F.col("calls") > 0) & (F.col("calls") == F.col("priced_calls"))).withColumn("usd", usd)
    return out.select(F.when(F.col("is_total") == 1, "total").otherwise(F.col(role)).alias(role), "calls", "priced_calls", "cost", *sums, "complete", "usd")


def poisoned_sum(c: Column) -> Column:
    """A sum that is unknown as soon as one part is."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def publishers(sources: DataFrame, label: str, url: str, order: str) -> DataFrame:
    """Sources by publisher: count, first address, and the distinct addresses in first-seen order as one text."""
    one = sources.groupBy(label, url).agg(F.min(order).alias("o"), F.count("*").alias("c"))
    return one.groupBy(label).agg(F.sum("c").alias("n"), F.min_by(url, "o").alias("first_url"), F.count("*").alias("n_urls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", url))), lambda x: x[url]), " ").alias("urls"))


def idle_gaps(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """Events after which a key was silent for more than `seconds`, with the length of the silence."""
    w = W.partitionBy(key).orderBy(at, tie)
    gap = F.unix_micros(F.lead(at).over(w)) - F.unix_micros(F.col(at))
    return events.withColumn("gap_seconds", F.floor(gap / 1_000_000)).where(F.col("gap_seconds") > seconds)
