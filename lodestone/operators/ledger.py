"""Credits: balances, idempotent inserts, daily caps, purchases, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Signs of completed ledger operations, and the price catalog's arithmetic.
SIGNS = {"grant": 1, "compensation": 1, "reversal": 1, "usage": -1}
CREDITS_PER_USD, CREDITS_PER_TASK = 10, 30


def signed(kind: Column, credits: Column) -> Column:
    return F.when(kind == "usage", -credits).when(kind.isin("grant", "compensation", "reversal"), credits).otherwise(0)


def balances(accounts: DataFrame, operations: DataFrame, reservations: DataFrame, key: str) -> DataFrame:
    """settled, reserved and available credits of every account. operations: key, kind, completed, credits; reservations:
    key, status, credits. What is being reconciled is still reserved, and available is never negative."""
    settled = operations.where("completed").groupBy(key).agg(F.sum(signed(F.col("kind"), F.col("credits"))).alias("settled"))
    held = reservations.where("status IN ('reserved', 'reconciling')").groupBy(key).agg(F.sum("credits").alias("reserved"))
    out = accounts.select(key).join(settled, key, "left").join(held, key, "left")
    out = out.select(key, F.coalesce("settled", F.lit(0)).alias("settled"), F.coalesce("reserved", F.lit(0)).alias("reserved"))
    return out.withColumn("available", F.greatest(F.lit(0), F.col("settled") - F.col("reserved")))


def insert_or_ignore(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, as a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])


def daily_grants(requests: DataFrame, person: str, at: str, id_col: str, cap: int) -> DataFrame:
    """Every request with its reason: ALREADY_GRANTED after a person's first, DAILY_CAP beyond `cap` firsts of a UTC day, else GRANTED.

    Firsts of a day are ranked within the day's hours first, so that no day's rows meet in one task: counts of the
    hours before add to the place within the hour.
    """
    first = requests.groupBy(person).agg(F.min(F.struct(at, id_col)).alias("f")).select(F.col(f"f.{id_col}").alias(id_col), F.col(f"f.{at}").alias(at))
    first = first.withColumn("day", F.date_trunc("DAY", at)).withColumn("slot", F.date_trunc("MINUTE", at))
    per = first.groupBy("day", "slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("day").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).drop("n")
    place = F.row_number().over(W.partitionBy("day", "slot").orderBy(at, id_col))
    ranked = first.withColumn("place", place).join(per, ["day", "slot"]).select(id_col, (F.col("before") + F.col("place")).alias("rank"))
    out = requests.join(ranked, id_col, "left")
    return out.withColumn("reason", F.when(F.col("rank").isNull(), "ALREADY_GRANTED").when(F.col("rank") > cap, "DAILY_CAP").otherwise("GRANTED"))


def purchase_audit(purchases: DataFrame, grants: DataFrame) -> DataFrame:
    """Transactions whose grant is missing, repeated or of another size. purchases: transaction_id, credits; grants: transaction_id, credits."""
    got = grants.groupBy("transaction_id").agg(F.count("*").alias("grants"), F.sum("credits").alias("granted"))
    out = purchases.join(got, "transaction_id", "left")
    issue = F.when(F.col("grants").isNull(), "NO_GRANT").when(F.col("grants") > 1, "REPEATED_GRANT").when(F.col("granted") != F.col("credits"), "WRONG_AMOUNT")
    return out.select("transaction_id", issue.alias("issue")).where("issue IS NOT NULL")


def catalog_issue(usd: Column, credits: Column, bonus: Column, tasks: Column) -> Column:
    return F.when(credits != usd * CREDITS_PER_USD + bonus, "CREDITS").when(tasks != F.floor(credits / CREDITS_PER_TASK), "TASKS")


def settle(status: Column) -> Column:
    return F.when(status == "completed", "consume").when(status.isin("incomplete", "budget_exhausted", "cancelled", "failed_validation", "blocked"), "release")


def budget_prefix(rows: DataFrame, key: str, order: list[str], amounts: dict[str, int]) -> DataFrame:
    """Rows with running sums by key of each amount and whether all stay within their limits; the first breach ends a key, so sums of all rows do."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out, ok = rows, F.lit(True)
    for name, limit in amounts.items():
        out = out.withColumn(f"running_{name}", F.sum(name).over(w))
        ok &= F.col(f"running_{name}") <= limit
    return out.withColumn("within", ok)


def offer_remaining(accounts: DataFrame, grants: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    """(key, granted, remaining) of each account's free offer: one is left while it was granted and not consumed."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = accounts.select(key).join(flag(grants, "_granted"), key, "left").join(flag(consumed, "_used"), key, "left")
    granted = F.coalesce("_granted", F.lit(False))
    return out.select(key, granted.alias("granted"), F.when(granted & F.col("_used").isNull(), 1).otherwise(0).alias("remaining"))


def compare_and_set(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """rows (key, status, version) after updates (key, from_status, from_version, to_status), of which one a key: it applies where both guards hold, and raises the version."""
    out = rows.join(updates, key, "left")
    hit = F.coalesce((F.col("status") == F.col("from_status")) & (F.col("version") == F.col("from_version")), F.lit(False))
    return out.select(key, F.when(hit, F.col("to_status")).otherwise(F.col("status")).alias("status"), (F.col("version") + hit.cast("int")).alias("version"), hit.alias("applied"))


def purchase_issue(items: Column, quantity: Column, account: Column, expected_account: Column, price: Column, expected_price: Column) -> Column:
    """Why a payment event is refused: one item, of quantity one, and the account and price that were asked for."""
    return F.when(items != 1, "ITEM_COUNT").when(quantity != 1, "QUANTITY").when(~account.eqNullSafe(expected_account), "ACCOUNT").when(~price.eqNullSafe(expected_price), "PRICE")
