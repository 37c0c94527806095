"""Money, ids, limits and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def minor_of_decimal(c: Column) -> Column:
    """Minor units of a decimal amount, half up on the double product; blank text is zero, other text null."""
    text = F.trim(c.cast("string"))
    d = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when((d >= 0) & (d < float("inf")), F.floor(d * 100.0 + 0.5)).cast("long")


def minor_of_integer(c: Column) -> Column:
    """Minor units that are integers already; blank, negative and broken ones are null."""
    d = F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string"))).try_cast("double")
    return F.when((d >= 0) & (d < float("inf")) & (d == F.floor(d)), d).cast("long")


def currency(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z]{3}$"), t)


def sha_id(prefix: str, *parts: Column) -> Column:
    """A prefixed id of 16 hexadecimal digits of what the parts, one a line, hash to."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16))


def stable_uuid(c: Column) -> Column:
    """A UUID that the text decides, with version 5 and variant a."""
    h = F.sha2(c, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def retry_delay(attempt: Column, delays: tuple[int, ...] = (45, 120)) -> Column:
    """Seconds before attempt + 1; null where there is no further one."""
    return F.try_element_at(F.array(*[F.lit(d) for d in delays]), (attempt + 1).cast("int"))


def token_estimate(chars: Column, searches: Column, attempts: Column, overhead: int = 2000, per_search: int = 8000) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / 2) + overhead + F.when(searches, per_search).otherwise(0)) * attempts


def micro_usd(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("long")


def within_skew(occurred: Column, now: Column, seconds: int = 86_400) -> Column:
    """Whether a time is at most so far from now, on either side."""
    return F.abs(F.unix_micros(now) - F.unix_micros(occurred)) <= seconds * 1_000_000


def availability(c: Column) -> Column:
    """True, false or unknown (null) from the last path segment of a schema address or plain token."""
    t = F.element_at(F.split(F.lower(c), "/"), -1)
    return F.when(t.isin("instock", "in_stock"), True).when(t.isin("outofstock", "out_of_stock", "soldout"), False)


def stock(value: Column, kind: Column) -> Column:
    """availability() of a JSON scalar: booleans stand for themselves, numbers for nothing."""
    return F.when(kind == "b", value == "true").when(kind == "s", availability(value))
