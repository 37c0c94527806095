"""Observations in long form and what they settle: field states, preferences, scoped prices, findings, evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.values import sha_id

#: States of a field.
STATES = ("verified", "single_source", "conflicted", "missing", "incomplete")


def state_of(keys: Column, sources: Column, available: Column | None = None) -> Column:
    """The state that a count of distinct values and of distinct sources stands for."""
    none = F.when(~available, "incomplete").otherwise("missing") if available is not None else F.lit("missing")
    return F.when(F.coalesce(keys, F.lit(0)) == 0, none).when(keys > 1, "conflicted").when(sources >= 2, "verified").otherwise("single_source")


def resolve_field(observations: DataFrame, entities: DataFrame | None, keys: list[str], available: str | None = None) -> DataFrame:
    """One row for each of `entities` (keys and maybe a boolean `available`): state, value, n_observations, n_sources, n_values.

    observations: keys, source, ord, vkey (what values compare by), value. The value is the first by ord, and null
    where values conflict. Without `entities`, those that have an observation. Everything is a partial aggregate over one
    reading of the observations, so a hot entity is no hot task.
    """
    rows = observations if entities is None else observations.where("vkey IS NOT NULL")
    voting = lambda c: F.when(F.col("vkey").isNotNull(), F.col(c)) if entities is None else F.col(c)
    out = rows.groupBy(*keys).agg(F.count("vkey").alias("n_observations"), F.count_distinct(voting("source")).alias("n_sources"), F.count_distinct("vkey").alias("n_values"), F.min_by(voting("value"), voting("ord")).alias("first_value"))
    out = out if entities is None else entities.join(out, keys, "left")
    state = state_of(F.col("n_values"), F.col("n_sources"), F.col(available) if available else None)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_observations", "n_sources", "n_values")]
    return out.withColumn("state", state).select(*keys, "state", F.when(F.col("state") != "conflicted", F.col("first_value")).alias("value"), *zero)


def prefer_field(observations: DataFrame, keys: list[str], catalog: str) -> DataFrame:
    """Fields of two tiers: tier 2 counts only where tier 1 is empty. Where tier 1 conflicts, the catalog source's value
    wins if a second source has it as well. observations: keys, tier, source, ord, vkey, value; they are read once, rows with a null key are left out.
    """
    whole = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "tier", "vkey")))
    one = observations.where(whole).groupBy(*keys, "tier", "vkey", "source").agg(F.min(F.struct("ord", "value")).alias("f"))
    # each as a value's row and as a source's
    each = one.select(*keys, "tier", "f", (F.col("source") == catalog).cast("int").alias("c"), F.explode(F.array(F.struct("vkey", F.lit(None).cast("string").alias("source"), F.col("source").isNotNull().cast("long").alias("s")), F.struct(F.lit(None).cast("string").alias("vkey"), "source", F.lit(None).cast("long").alias("s")))).alias("x"))
    groups = each.groupBy(*keys, "tier", "x.vkey", "x.source").agg(F.sum("x.s").alias("s"), F.min("f").alias("f"), F.max("c").alias("c"))
    tiers = groups.groupBy(*keys, "tier").agg(
        F.count("vkey").alias("n_values"), F.count("source").alias("n_sources"), F.min(F.when(F.col("vkey").isNotNull(), F.col("f"))).alias("f"), F.min(F.when(F.col("vkey").isNotNull() & (F.col("c") == 1) & (F.col("s") >= 2), F.col("f"))).alias("win")
    )
    used = F.min_by(F.struct("tier", "n_values", "n_sources", "f", "win"), "tier").alias("x")
    out = tiers.groupBy(*keys).agg(used).select(*keys, "x.*")
    state = F.when((F.col("n_values") > 1) & F.col("win").isNotNull(), "verified").otherwise(state_of(F.col("n_values"), F.col("n_sources")))
    value = F.when(F.col("n_values") == 1, F.col("f.value")).otherwise(F.col("win.value"))
    return out.select(*keys, "tier", state.alias("state"), value.alias("value"), "n_values", "n_sources")


def match_variants(offers: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """offers (key, offer_id, page_key, url_variant, sku) with the variant each is about, or null.

    A variant number in an offer's address on the product's own page decides, even where it names no variant;
    otherwise a stock number that exactly one variant has. variants: key, variant_id, page_key, sku.
    """
    by_url = variants.select(key, "page_key", F.col("variant_id").alias("url_variant"), F.col("variant_id").alias("by_url"))
    by_sku = variants.where("sku IS NOT NULL").groupBy(key, "sku").agg(F.count("*").alias("n"), F.min("variant_id").alias("by_sku")).where("n = 1").drop("n")
    out = offers.join(by_url, [key, "page_key", "url_variant"], "left").join(by_sku, [key, "sku"], "left")
    return out.withColumn("variant_id", F.when(F.col("url_variant").isNotNull(), F.col("by_url")).otherwise(F.col("by_sku"))).drop("by_url", "by_sku")


def scoped_price(products: DataFrame, variants: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """The price a page stands for: its chosen variant's, or the lowest with the range.

    products: key, chosen (variant or null), currency (or null); variants: key, variant_id, price; evidence: key,
    variant_id, price, currency. Offers in the page's currency about a known variant are compared with the variant's
    price; any difference, also between two offers on one variant, conflicts, and a price is verified only where every variant in scope
    is confirmed. A chosen number that names no variant leaves the price open.
    """
    base = variants.join(products.select(key, "chosen", F.col("currency").alias("page_currency")), key)
    known = base.groupBy(key).agg(F.max(F.coalesce(F.col("variant_id") == F.col("chosen"), F.lit(False))).alias("found"))
    scope = base.join(known, key).where("chosen IS NULL OR variant_id = chosen")
    offers = evidence.groupBy(key, "variant_id", "currency").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    both = scope.join(offers, [key, "variant_id"], "left")
    same = F.col("currency") == F.col("page_currency")
    per = both.groupBy(key, "variant_id", "price").agg(
        F.max(F.coalesce(same & ((F.col("low") != F.col("price")) | (F.col("low") != F.col("high"))), F.lit(False)) | F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("bad"),
        F.max(F.coalesce(same & (F.col("low") == F.col("price")) & (F.col("high") == F.col("price")), F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("currency") != F.col("page_currency"), F.lit(False))).alias("other_currency"),
    )
    out = per.groupBy(key).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.max("bad").alias("bad"), F.min("good").alias("good"), F.max("other_currency").alias("other"))
    out = products.select(key, "chosen").join(known, key, "left").join(out, key, "left")
    lost = F.col("chosen").isNotNull() & ~F.coalesce("found", F.lit(False))
    state = F.when(lost | F.col("low").isNull(), "incomplete").when(F.col("bad"), "conflicted").when(F.col("good"), "verified").otherwise("single_source")
    return out.select(
        key, F.when(lost, "unresolved").when(F.col("chosen").isNotNull(), "variant").otherwise("product_minimum").alias("scope"), state.alias("price_state"),
        F.when(~lost & ~F.coalesce("bad", F.lit(False)), F.col("low")).alias("price"), F.when(F.col("chosen").isNull(), F.col("low")).alias("range_low"), F.when(F.col("chosen").isNull(), F.col("high")).alias("range_high"),
        F.when(F.coalesce("other", F.lit(False)), "conflicted").alias("currency_note"),
    )


def variant_summary(variants: DataFrame, key: str) -> DataFrame:
    """Counts over variants (key, sku, available, price); available is true where any is, null where none is known."""
    return variants.groupBy(key).agg(
        F.count("*").alias("n_variants"), F.count("sku").alias("n_with_sku"), F.count_if(F.col("available")).alias("n_available"), F.count_if(F.col("available").isNull()).alias("n_unknown"),
        F.bool_or("available").alias("available"), F.min("price").alias("price_min"), F.max("price").alias("price_max"),
    )


def collection_status(password: Column, challenge: Column, ajax: Column) -> Column:
    return F.when(password | challenge, "blocked").when(ajax.isNotNull(), "complete").otherwise("partial")


def evidence_pack(items: DataFrame, key: str, most: int = 200) -> DataFrame:
    """At most `most` items of each key with ids from their content. items: key, ord, source, path, text.

    Items of equal source, path and text are one, at the first one's place. Within a key only as many are ranked
    as are left after this partial aggregate.
    """
    one = items.where("text IS NOT NULL AND text <> ''").groupBy(key, "source", "path", "text").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("ord", "source", "path", "text"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("id", sha_id("ev_", F.col("source"), F.col("path"), F.col("text")))


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (claim_id, evidence_id, quote) with what is wrong: UNKNOWN_ID, NOT_IN_TEXT or null. evidence: evidence_id, text."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = claims.join(evidence.select("evidence_id", F.col("text").alias("cited")), "evidence_id", "left")
    return out.select("claim_id", "evidence_id", F.when(F.col("cited").isNull(), "UNKNOWN_ID").when(~F.contains(flat(F.col("cited")), flat(F.col("quote"))), "NOT_IN_TEXT").alias("issue"))


def contained_texts(needles: DataFrame, texts: DataFrame, needle: str, text: str, words: int = 5) -> DataFrame:
    """Pairs (needle id, text id) where a text holds a needle, white space aside; both frames have (id, text) columns by these names.

    Words 2 to `words` + 1 of a needle stand whole in any text that holds it, so that window is hash-joined before texts
    are compared. A needle of 3 to words + 1 words joins by all its inner words, one of 1 or 2 by up to 8 characters of its
    longer word, which a word of the text must hold; an empty one is in every text. The lengths in use are collected.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    a = needles.where("text IS NOT NULL").select(needle, flat(F.col("text")).alias("q")).withColumn("w", F.split("q", " "))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    n = F.size("w")
    # so many whole words, or below zero so many characters
    kind = F.when(n > 2, F.least(n - 2, F.lit(words))).otherwise(-F.least(longest["n"], F.lit(8)))
    a = a.withColumn("kind", kind).withColumn("h", F.when(F.col("kind") > 0, F.xxhash64(F.expr("slice(w, 2, greatest(kind, 0))"))).otherwise(F.xxhash64(longest["x"].substr(F.lit(1), -F.col("kind")))))
    a = a.select(needle, "q", "kind", "h")
    kinds = [r[0] for r in a.select("kind").distinct().collect()]
    b = texts.where("text IS NOT NULL").select(text, F.explode(F.array(F.split(flat(F.col("text")), " "))).alias("w"))
    whole = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice("w", i, k)))
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.length("x") - k + 1), lambda i: F.xxhash64(F.col("x").substr(i, F.lit(k))))
    pairs = a.where("kind = 0").crossJoin(texts.where("text IS NOT NULL").select(text)).select(needle, text, "q").distinct() if 0 in kinds else None
    for k in sorted(x for x in kinds if x):
        if k > 0:
            rows = b.where(F.size("w") >= k).select(text, F.explode(F.array_distinct(whole(k))).alias("h"))
        else:
            rows = b.select(text, F.explode(F.array_distinct("w")).alias("x")).where(F.length("x") >= -k).select(text, F.explode(grams(-k)).alias("h"))
        found = rows.join(a.where(F.col("kind") == k), "h").select(needle, text, "q").distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = a.crossJoin(texts.select(text)).where("1 = 0").select(needle, text, "q")
    return pairs.join(texts.select(text, flat(F.col("text")).alias("t")), text).where(F.contains("t", "q")).select(needle, text)
