"""Product profiles, target identities, briefs and what each model role may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls

#: What each role is shown.
BOUNDARIES = {
    "generator": {"brief": True, "transcript": True, "identity": False, "observations": False},
    "auditor": {"brief": True, "transcript": True, "identity": False, "observations": False},
    "observer": {"brief": False, "transcript": True, "identity": True, "observations": False},
    "classifier": {"brief": False, "transcript": True, "identity": True, "observations": False},
}
#: The columns a question controller works from; none is about the target.
BLIND = ("session", "turn", "needs", "question", "answer", "sources", "decision")


def profile(fields: DataFrame, key: str, names: list[str], most: int = 8000) -> DataFrame:
    """Long fields (key, field, state, value) as one row: a column for each name, cut to `most` characters, and a map of states."""
    wide = [F.max(F.when((F.col("field") == n) & (F.col("state") != "conflicted"), F.substring("value", 1, most))).alias(n) for n in names]
    states = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "state")))).alias("states")
    return fields.groupBy(key).agg(*wide, states)


def target_identity(products: DataFrame, variants: DataFrame, key: str, most: int = 100) -> DataFrame:
    """name (title, else from the handle), brand (else the host), codes (distinct stock numbers and barcodes in order) and addresses.

    products: key, title, brand, url, final_url; variants: key, ord, sku, barcode.
    """
    code = F.explode(F.filter(F.array(F.struct(F.lit(0).alias("i"), F.col("sku").alias("c")), F.struct(F.lit(1).alias("i"), F.col("barcode").alias("c"))), lambda x: F.coalesce(x["c"], F.lit("")) != "")).alias("x")
    one = variants.select(key, "ord", code).groupBy(key, F.col("x.c").alias("c")).agg(F.min(F.struct(F.col("x.i"), F.col("ord"))).alias("o"))
    codes = one.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]), 1, most).alias("codes"))
    named = F.initcap(F.replace(urls.handle(F.col("url")), F.lit("-"), F.lit(" ")))
    out = products.join(codes, key, "left")
    return out.select(key, F.coalesce("title", named).alias("name"), F.coalesce("brand", urls.site(F.col("url"))).alias("brand"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.array_distinct(F.array_compact(F.array("url", "final_url"))).alias("addresses"))


def merged(own: Column, generated: Column, most: int | None = None) -> Column:
    """A list that the user gave, else the generated one."""
    out = F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(generated)
    return F.slice(out, 1, most) if most else out


def appended(own: Column, generated: Column, most: int = 16) -> Column:
    return F.slice(F.array_distinct(F.concat(own, generated)), 1, most)


def boundaries(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(r).alias("role"), *[F.lit(v).alias(k) for k, v in b.items()]) for r, b in BOUNDARIES.items()])
    return spark.range(1).select(F.inline(rows))


def blind_context(turns: DataFrame) -> DataFrame:
    """What a controller may see; a column that is not on the list can't get through."""
    return turns.select(*[c for c in BLIND if c in turns.columns])


def known_sources(cited: Column, captured: Column) -> Column:
    """Cited sources that were captured, in the citation's order."""
    return F.array_intersect(cited, captured)


def undeclared(declared: DataFrame, provided: DataFrame, key: str, url: str) -> DataFrame:
    """Addresses an answer declares that its provider did not give; all of them where it gave none."""
    a = declared.select(key, url, urls.provider_key(F.col(url)).alias("_k"))
    b = provided.select(key, urls.provider_key(F.col(url)).alias("_k")).distinct()
    return a.join(b, [key, "_k"], "left_anti").select(key, url)


def resolve_account(events: DataFrame, identities: DataFrame, checkouts: DataFrame, accounts: DataFrame) -> DataFrame:
    """The account of each payment event (event_id, customer_id, checkout_id, email): by customer identity, else the
    checkout's account if that has an address, else the account of the address, else the checkout's account."""
    by_customer = identities.select("customer_id", F.col("account_id").alias("a1"))
    by_checkout = checkouts.select("checkout_id", F.col("account_id").alias("a2")).join(accounts.select(F.col("account_id").alias("a2"), F.col("email").alias("e2")), "a2", "left")
    by_email = accounts.where("email IS NOT NULL").select("email", F.col("account_id").alias("a3"))
    out = events.join(by_customer, "customer_id", "left").join(by_checkout, "checkout_id", "left").join(by_email, "email", "left")
    return out.select("event_id", F.coalesce("a1", F.when(F.col("e2").isNotNull(), F.col("a2")), "a3", "a2").alias("account_id"))


def decision_evidence(assessments: DataFrame, turns: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The newest supported and cited claims of a session whose quotes stand in their turns, one for each quote, at most `most`.

    assessments: key, turn, ord, need_kind, status, level, quote, quote_turn; turns: key, turn, text.
    """
    said = turns.select(key, F.col("turn").alias("quote_turn"), "text")
    good = assessments.where("need_kind IN ('job', 'required') AND status = 'supported' AND level = 'cited_reference' AND quote IS NOT NULL").join(said, [key, "quote_turn"]).where(F.contains("text", "quote"))
    one = good.groupBy(key, "quote").agg(F.min(F.struct((-F.col("turn")).alias("t"), F.col("ord"))).alias("o"))
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "quote"))), lambda x: x["quote"]), 1, most)
    return one.groupBy(key).agg(top.alias("quotes"))


def config_issues(configs: DataFrame) -> DataFrame:
    """Model configurations (name, body) that are no JSON, name no model or use an endpoint without https."""
    c = configs.withColumn("j", F.try_parse_json("body"))
    at = lambda p: F.try_variant_get("j", p, "string")
    issue = F.when(F.col("j").isNull(), "NOT_JSON").when(F.coalesce(at("$.model"), F.lit("")) == "", "NO_MODEL").when(~F.coalesce(at("$.endpoint"), F.lit("https://")).startswith("https://"), "ENDPOINT_NOT_HTTPS")
    return c.select("name", issue.alias("issue")).where("issue IS NOT NULL")


def parsed_answer(status: Column, body: Column) -> Column:
    """Why a classifier's reply can't be used, or null: bad status, no JSON, chat-shaped, or without answers."""
    j = F.try_parse_json(body)
    return (
        F.when(~status.between(200, 299), "http_status").when(j.isNull(), "not_json").when(F.try_variant_get(j, "$.choices", "variant").isNotNull(), "chat_shaped")
        .when(F.try_variant_get(j, "$.answers", "variant").isNull(), "missing_answers")
    )


def direct_retrieval(matched: Column, name: Column, source_ids: Column, known: Column) -> Column:
    return matched & (F.coalesce(name, F.lit("")) != "") & (F.size(source_ids) > 0) & (F.size(F.array_except(source_ids, known)) == 0)


def stalled(sessions: DataFrame, now: Column, seconds: int = 480, most: int = 20) -> DataFrame:
    """The longest-idle reserved sessions (session, status, claimed, updated_at) that nobody holds."""
    idle = F.unix_micros(now) - F.unix_micros("updated_at") >= seconds * 1_000_000
    return sessions.where((F.col("status") == "reserved") & ~F.col("claimed") & idle).orderBy("updated_at", "session").limit(most)


def revision(rejected: Column, most: int = 2) -> Column:
    """What follows so many rejected questions."""
    return F.when(rejected == 0, "accepted").when(rejected <= most, "revise").otherwise("failed_validation")
