"""Product captures made of parts, usage of recorded calls, session reports, and the smaller expressions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx, urls, values
from ..operators import evidence, ledger, preview, product, readiness, report
from ..sources.tables import spread, table
from .registry import query

_SHOP = "https://shop.example/products/p-"
_K, _CENTS, _FULL = "CAST(p_partkey AS VARCHAR)", "CAST(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS VARCHAR)", "CAST(CAST(floor(p_retailprice) AS BIGINT) * 100 + 50 AS VARCHAR)"
_IMAGE = f"'https://shop.example/i/' || {_K} || '.png?width=100'"
_EACH = [
    ("product_id", 0, "shopify_ajax", "id", _K), ("handle", 0, "shopify_ajax", "handle", f"'p-' || {_K}"), ("handle", 1, "html_meta", "url.handle", f"'p-' || {_K}"),
    ("canonical_url", 0, "html_meta", "link[rel=canonical]", f"'{_SHOP}' || {_K}"), ("title", 0, "shopify_ajax", "title", "p_name"), ("title", 1, "json_ld", "products[0].name", "p_name || '/'"),
    ("title", 2, "visible_html", "h1", "upper(p_name)"), ("title", 3, "html_meta", "og:title", "p_name"), ("description", 0, "shopify_ajax", "description", "p_name || ' size ' || CAST(p_size AS VARCHAR)"),
    ("vendor_brand", 0, "shopify_ajax", "vendor", "p_brand"), ("vendor_brand", 1, "json_ld", "products[0].brand", "p_brand"), ("product_type_category", 0, "shopify_ajax", "type", "p_type"),
    ("currency", 0, "html_meta", "product:price:currency", "'USD'"), ("currency", 1, "json_ld", "products[0].offers[0].priceCurrency", "CASE WHEN p_size % 3 = 0 THEN 'EUR' ELSE 'USD' END"),
    ("price", 0, "shopify_ajax", "price", _CENTS), ("price", 2, "json_ld", "products[0].offers[0].price", _FULL), ("availability", 0, "shopify_ajax", "available", "CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END"),
    ("availability", 2, "json_ld", "products[0].offers[0].availability", "'true'"), ("sku", 0, "shopify_ajax", "variants[0].sku", f"'S' || {_K}"), ("sku", 1, "json_ld", "products[0].sku", f"'S' || {_K}"),
    ("image", 0, "shopify_ajax", "images[0]", _IMAGE), ("image", 2, "shopify_ajax", "images[0]", _IMAGE),
    ("taxonomy_hints", 0, "json_ld", "breadcrumbs[0].itemListElement[0].name", "p_type"), ("taxonomy_hints", 1, "json_ld", "breadcrumbs[0].itemListElement[1].name", "p_brand"), ("taxonomy_hints", 2, "shopify_ajax", "tags[0]", "p_type"),
]
_OBS = "obs AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS part, '{f}' AS field, {o} AS ord, {2 if f == 'image' and o == 2 or (f, o) == ('title', 3) else 1} AS tier, '{s}' AS source, '{path}' AS path, {v} AS value FROM part" for f, o, s, path, v in _EACH
) + ")"


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product feed and a page for each part."""
    p = spread(table(spark, sf_dir, "part"))
    k, cents = F.col("p_partkey").cast("string"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").cast("string")
    feed = F.to_json(F.struct(
        F.col("p_partkey").alias("id"), F.concat(F.lit("p-"), k).alias("handle"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("type"),
        F.concat(F.lit("<p>"), "p_name", F.lit(" <b>size</b> "), F.col("p_size").cast("string"), F.lit("</p>")).alias("description"), F.array(F.concat(F.lit("/i/"), k, F.lit(".png?width=100"))).alias("images"), F.array("p_type", F.lit(" ")).alias("tags"),
        F.array(F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("S"), k).alias("sku"), cents.alias("price"), (F.col("p_size") % 2 == 0).alias("available"))).alias("variants"),
    ))
    offer = F.to_json(F.struct(F.concat(F.floor("p_retailprice").cast("long").cast("string"), F.lit(".50")).alias("price"), F.when(F.col("p_size") % 3 == 0, "EUR").otherwise("USD").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability")))
    node = F.concat(F.lit('{"@graph":[{"@type":["Thing","Product"],"name":"'), "p_name", F.lit('/","brand":{"name":"'), "p_brand", F.lit('"},"sku":"S'), k, F.lit('","gtin13":" ","offers":['), offer, F.lit("]},"))
    crumbs = F.concat(F.lit('{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"'), "p_brand", F.lit('"},{"position":1,"item":{"name":"'), "p_type", F.lit('"}}]}]}'))
    page = F.concat(
        F.lit('<html><head><link rel="canonical" href="/products/p-'), k, F.lit('"><meta property="product:price:currency" content="USD"><meta property="og:title" content="'), "p_name", F.lit('"><script type="application/ld+json">'),
        node, crumbs, F.lit('</script><script type="application/ld+json">{broken</script></head><body><h1> '), F.upper("p_name"), F.lit(" </h1></body></html>"),
    )
    return p.select(F.col("p_partkey").alias("part"), F.concat(F.lit(_SHOP), k).alias("url"), feed.alias("feed_body"), page.alias("page_html"))


@query(f"WITH {_OBS} SELECT * FROM obs")
def product_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product.observations(_captures(spark, sf_dir), "part").select("part", "field", "ord", "tier", "source", "path", "value")


@query(f"""
WITH {_OBS}, v AS (SELECT *, CASE WHEN field = 'image' THEN regexp_replace(value, '^https://|[?].*$', '', 'g') ELSE regexp_replace(lower(value), '/$', '') END AS k FROM obs WHERE field NOT IN ('title', 'description', 'barcode', 'image', 'taxonomy_hints')),
g AS (SELECT part, field, count(*) AS n_observations, count(DISTINCT source) AS n_sources, count(DISTINCT k) AS n_values, arg_min(value, ord) AS v FROM v GROUP BY ALL)
SELECT part, field, CASE WHEN n_values > 1 THEN 'conflicted' WHEN n_sources >= 2 THEN 'verified' ELSE 'single_source' END AS state, CASE WHEN n_values = 1 THEN v END AS value, n_observations, n_sources, n_values FROM g
""")
def product_field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = product.observations(_captures(spark, sf_dir), "part", [f for f in product.FIELDS if f not in (*product.PREFERRED, "taxonomy_hints")])
    return evidence.resolve_field(rows, None, ["part", "field"])


@query(f"""
WITH {_OBS}, v AS (SELECT *, regexp_replace(lower(value), '/$', '') AS k FROM obs WHERE field IN ('title', 'description')), u AS (SELECT part, field, min(tier) AS tier FROM v GROUP BY ALL),
g AS (SELECT part, field, tier, count(DISTINCT source) AS n_sources, count(DISTINCT k) AS n_values, arg_min(value, ord) AS v FROM v JOIN u USING (part, field, tier) GROUP BY ALL)
SELECT part, field, tier, CASE WHEN n_values > 1 THEN 'conflicted' WHEN n_sources >= 2 THEN 'verified' ELSE 'single_source' END AS state, CASE WHEN n_values = 1 THEN v END AS value, n_values, n_sources FROM g
""")
def product_preferred_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = product.observations(_captures(spark, sf_dir), "part", ["title", "description"])
    return evidence.prefer_field(rows, ["part", "field"], "shopify_ajax")


@query("SELECT p_partkey AS part, 'verified' AS state, 'breadcrumb: ' || p_type || ' > ' || p_brand || '; ajax_tag: ' || p_type AS value FROM part")
def product_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product.taxonomy_hints(product.observations(_captures(spark, sf_dir), "part", ["taxonomy_hints"]), "part")


@query("""
WITH e AS (SELECT user_id, event_type <> 'error' AS ok, event_id % 4 AS kind, event_id % 100 AS i, event_id % 50 AS o, (event_id % 8) / 4.0 AS cost FROM events)
SELECT user_id, count(*) AS model_calls, CAST(sum(CASE WHEN kind < 3 THEN i ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN kind < 3 THEN o ELSE 0 END) AS BIGINT) AS output_tokens,
  CAST(sum(CASE WHEN kind = 0 THEN 3 ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(sum(CASE WHEN kind = 0 THEN i + o + 1 WHEN kind < 3 THEN i + o ELSE 0 END) AS BIGINT) AS total_tokens,
  CAST(sum(CASE WHEN kind = 1 THEN 2 ELSE 0 END) AS BIGINT) AS web_search_requests,
  CASE WHEN count(CASE WHEN ok AND kind >= 2 AND user_id % 2 = 0 THEN 1 END) = 0 THEN CAST(sum(CASE WHEN ok THEN cost ELSE 0 END) AS DOUBLE) END AS cost_usd
FROM e GROUP BY user_id
""")
def captured_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), lambda k: (F.col("event_id") % k).cast("string")
    cost = F.concat(F.lit(',"cost":'), ((F.col("event_id") % 8) / 4.0).cast("string"))
    first = F.concat(F.lit('{"usage":{"prompt_tokens":'), n(100), F.lit(',"completion_tokens":'), n(50), F.lit(',"total_tokens":'), (F.col("event_id") % 100 + F.col("event_id") % 50 + 1).cast("string"), F.lit(',"completion_tokens_details":{"reasoning_tokens":3}'), cost, F.lit("}}"))
    second = F.concat(F.lit('{"usage":{"input_tokens":'), n(100), F.lit(',"output_tokens":'), n(50), F.lit(',"server_tool_use":{"web_search_requests":2}'), cost, F.lit("}}"))
    bill = F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(cost)
    third = F.concat(F.lit('{"usage":{"input_tokens":'), n(100), F.lit(',"output_tokens":'), n(50), bill, F.lit("}}"))
    broken = F.when(F.col("user_id") % 2 == 0, F.lit("{not json")).otherwise(F.concat(F.lit('{"usage":{"cost":'), ((F.col("event_id") % 8) / 4.0).cast("string"), F.lit("}}")))
    kind = F.col("event_id") % 4
    body = F.when(kind == 0, first).when(kind == 1, second).when(kind == 2, third).otherwise(broken)
    return product.captured_usage(e.select("user_id", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), body.alias("body")), "user_id")


@query("""
WITH t AS (SELECT conv_id, turn, length(text) % 2 = 0 AS retrieved, length(text) % 3 = 0 AS candidate, length(text) % 7 = 0 AS recommended, length(text) % 11 = 0 AS final, length(text) % 5 AS publisher FROM conversations),
g AS (SELECT conv_id, min(CASE WHEN retrieved THEN turn END) AS first_retrieved, min(CASE WHEN candidate THEN turn END) AS first_candidate, min(CASE WHEN recommended THEN turn END) AS first_recommended, min(CASE WHEN final THEN turn END) AS first_final, count(*) AS n_turns FROM t GROUP BY 1),
s AS (SELECT conv_id, count(DISTINCT turn) AS turns_with_sources, count(*) AS source_records, count(DISTINCT publisher) AS unique_source_domains FROM t WHERE turn % 2 = 1 GROUP BY 1),
c AS (SELECT g.*, coalesce(turns_with_sources, 0) AS turns_with_sources, coalesce(source_records, 0) AS source_records, coalesce(unique_source_domains, 0) AS unique_source_domains, conv_id % 5 <> 0 AS terminal,
  CASE WHEN conv_id % 3 = 0 THEN 'unknown' WHEN conv_id % 4 = 0 THEN 'issues_found' WHEN conv_id % 2 = 0 THEN 'readable' ELSE 'partial' END AS technical,
  CASE WHEN conv_id % 7 = 0 THEN 'inconclusive' WHEN first_final IS NOT NULL THEN 'final_choice' WHEN first_recommended IS NOT NULL THEN 'recommended' WHEN first_candidate IS NOT NULL THEN 'candidate' WHEN first_retrieved IS NOT NULL THEN 'retrieved' ELSE 'absent' END AS outcome FROM g LEFT JOIN s USING (conv_id)),
n AS (SELECT *, CASE WHEN technical = 'issues_found' THEN 'Resolve the captured technical eligibility issue first.' WHEN outcome = 'absent' THEN 'Investigate category association and external product evidence before rewriting the page.'
  WHEN outcome IN ('candidate', 'retrieved') THEN 'Clarify the comparison fact that matters at the observed exit point.' ELSE 'Preserve the baseline; do not manufacture a fix.' END AS next_title FROM c)
SELECT conv_id, terminal, CASE WHEN terminal THEN outcome END AS outcome, CASE WHEN terminal THEN next_title END AS next_title, CASE WHEN terminal THEN first_retrieved END AS first_retrieved, CASE WHEN terminal THEN first_candidate END AS first_candidate,
  CASE WHEN terminal THEN first_recommended END AS first_recommended, CASE WHEN terminal THEN first_final END AS first_final, CASE WHEN terminal THEN n_turns END AS n_turns, CASE WHEN terminal THEN turns_with_sources END AS turns_with_sources,
  CASE WHEN terminal THEN source_records END AS source_records, CASE WHEN terminal THEN unique_source_domains END AS unique_source_domains, CASE WHEN terminal THEN technical END AS technical FROM n
""")
def session_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, size = table(spark, sf_dir, "conversations"), F.length("text")
    turns = t.select("conv_id", "turn", *[(size % k == 0).alias(n) for n, k in (("retrieved", 2), ("candidate", 3), ("recommended", 7), ("final", 11))])
    sources = t.where("turn % 2 = 1").select("conv_id", "turn", (size % 5).alias("publisher"))
    sessions = t.select("conv_id").distinct()
    codes = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("PAGE_NOINDEX"))).otherwise(F.array(F.lit("MISSING_CANONICAL")))
    checks = sessions.where("conv_id % 3 <> 0").select("conv_id", F.when(F.col("conv_id") % 2 == 0, "complete").otherwise("partial").alias("status"), codes.alias("codes"))
    return report.session_reports(sessions.select("conv_id", (F.col("conv_id") % 5 != 0).alias("terminal"), (F.col("conv_id") % 7 == 0).alias("interrupted")), turns, sources, checks, "conv_id")


@query("""
WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, CASE WHEN n % 5 = 0 THEN 'not observed' WHEN n % 7 = 0 THEN 'final choice' WHEN n % 7 = 1 THEN 'recommended' WHEN n % 3 = 0 THEN 'in candidate set' WHEN n % 2 = 0 THEN 'retrieved only' ELSE 'absent' END AS state FROM t
""")
def turn_target_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    state = report.target_state(n % 5 != 0, F.when(n % 7 == 0, "final_choice").when(n % 7 == 1, "recommended").otherwise("not_recommended"), F.when(n % 3 == 0, "included").otherwise("absent"), F.when(n % 2 == 0, "retrieved"))
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", state.alias("state"))


_SEVERITY = "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END"


@query(f"SELECT user_id, count(CASE WHEN s = 'error' THEN 1 END) AS error, count(CASE WHEN s = 'warning' THEN 1 END) AS warning, count(CASE WHEN s = 'info' THEN 1 END) AS info FROM (SELECT user_id, {_SEVERITY} AS s FROM events) GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.severity_histogram(table(spark, sf_dir, "events").select("user_id", F.expr(_SEVERITY).alias("severity")), "user_id")


@query(f"""
WITH f AS (SELECT event_id, user_id, {_SEVERITY} AS severity FROM events)
SELECT user_id, event_id, severity, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, event_id) AS place FROM f
""")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.expr(_SEVERITY).alias("severity"))
    return readiness.by_severity(rows, "user_id").select("user_id", F.col("ord").alias("event_id"), "severity", F.col("place").cast("long").alias("place"))


_PATHS = ["robots.txt", "meta[name=robots]", "x-robots-tag", "variants[0].sku", "id", "handle", "products[0].offers[1].price", "offers[0]", "h1"]


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, (['robots.txt', 'meta[name=robots]', 'x-robots-tag', 'variants[0].sku', 'id', 'handle', 'products[0].offers[1].price', 'offers[0]', 'h1'])[p_partkey % 9 + 1] AS path FROM part)
SELECT p_partkey, (['robots', 'html_meta', 'html_meta', 'shopify_ajax', 'shopify_ajax', 'shopify_ajax', 'json_ld', 'json_ld', 'html_meta'])[p_partkey % 9 + 1] AS source,
  CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'field' END AS field, CASE p_size % 3 WHEN 0 THEN 'general' WHEN 1 THEN replace(p_name, ' ', '_') ELSE 'unknown' END AS agent,
  CASE WHEN p_size % 4 = 0 THEN 'No captured field produced this result.' ELSE 'title from catalog · ' || path || ' = "' || p_brand || '"; price from page' || CASE WHEN p_size % 4 = 1 THEN ' = 5' ELSE '' END END AS line FROM p
""")
def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("path", F.element_at(F.array(*[F.lit(x) for x in _PATHS]), (F.col("p_partkey") % 9 + 1).cast("int")))
    size = F.col("p_size")
    field, agent = F.when(size % 2 == 0, F.col("p_name")).otherwise("field"), F.when(size % 3 == 0, "*").when(size % 3 == 1, F.col("p_name"))
    item = lambda field, source, path, value: F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"), path.alias("path"), value.alias("value"))
    none = F.lit(None).cast("string")
    items = F.array(item("title", "catalog", F.col("path"), F.concat(F.lit('"'), "p_brand", F.lit('"'))), item("price", "page", none, F.when(size % 4 == 1, "5")))
    line = readiness.evidence_line(F.when(size % 4 == 0, F.slice(items, 1, 0)).otherwise(items))
    return p.select("p_partkey", readiness.source_of_path(F.col("path")).alias("source"), field.alias("field"), preview.agent_id(agent).alias("agent"), line.alias("line"))


@query("""
SELECT c_custkey, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) > 0 AS granted, CASE WHEN count(CASE WHEN o_orderstatus = 'O' THEN 1 END) > 0 AND count(CASE WHEN o_orderstatus = 'F' THEN 1 END) = 0 THEN 1 ELSE 0 END AS remaining
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def offer_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ledger.offer_remaining(table(spark, sf_dir, "customer"), orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), "c_custkey")


@query("""
WITH u AS (SELECT l_orderkey AS o, count(*) % 3 AS v, CASE WHEN max(CAST(l_quantity AS BIGINT)) % 2 = 0 THEN 'O' ELSE 'F' END AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN s = o_orderstatus AND v = o_orderkey % 3 THEN 'done' ELSE o_orderstatus END AS status, o_orderkey % 3 + CASE WHEN s = o_orderstatus AND v = o_orderkey % 3 THEN 1 ELSE 0 END AS version,
  coalesce(s = o_orderstatus AND v = o_orderkey % 3, false) AS applied FROM orders LEFT JOIN u ON o = o_orderkey
""")
def guarded_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).alias("version"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") % 3).alias("from_version"), F.when(F.max(F.col("l_quantity").cast("long")) % 2 == 0, "O").otherwise("F").alias("from_status"))
    return ledger.compare_and_set(rows, lines.withColumn("to_status", F.lit("done")), "o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'ITEM_COUNT' WHEN o_orderkey % 7 = 0 THEN 'QUANTITY' WHEN o_custkey % 3 = 0 THEN 'ACCOUNT' WHEN o_custkey % 2 = 0 THEN 'PRICE' END AS payment_issue,
  CASE WHEN o_orderstatus = 'F' THEN 'consume' WHEN o_orderstatus = 'P' THEN 'release' END AS settlement, CASE WHEN o_orderkey % 2 = 0 THEN 'CREDITS' WHEN o_orderkey % 3 = 0 THEN 'TASKS' END AS price_issue,
  CASE o_orderkey % 3 WHEN 0 THEN 45 WHEN 1 THEN 120 END AS delay, CAST(greatest(1, (o_orderkey + 1) // 2 + 2000 + CASE WHEN o_orderstatus = 'O' THEN 8000 ELSE 0 END) * 3 AS BIGINT) AS tokens,
  CAST(floor(o_totalprice * 1e6 + 0.5) AS BIGINT) AS micro, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS BIGINT) END AS minor, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' END AS currency,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS available FROM orders
""")
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    issue = ledger.purchase_issue(F.when(k % 5 == 0, 2).otherwise(1), F.when(k % 7 == 0, 3).otherwise(1), F.when(c % 3 == 0, F.lit(None)).otherwise("a"), F.lit("a"), F.when(c % 2 == 0, "p1").otherwise("p2"), F.lit("p2"))
    settled = ledger.settle(F.when(status == "F", "completed").when(status == "P", "cancelled").otherwise("running"))
    price = ledger.catalog_issue(F.lit(10), F.when(k % 2 == 0, 99).otherwise(105), F.lit(5), F.when(k % 3 == 0, 2).otherwise(3))
    shown = F.when(k % 2 == 0, " usd ").otherwise("US dollars")
    stock = F.when(k % 3 == 0, "https://schema.org/InStock").when(k % 3 == 1, "out_of_stock").otherwise("PreOrder")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", issue.alias("payment_issue"), settled.alias("settlement"), price.alias("price_issue"), values.retry_delay(k % 3).alias("delay"), values.token_estimate(k, status == "O", F.lit(3)).cast("long").alias("tokens"), values.micro_usd(F.col("o_totalprice")).alias("micro"),
        values.minor_of_integer(F.when(status == "P", k.cast("string")).when(status == "O", "").otherwise("-4")).alias("minor"), values.currency(shown).alias("currency"), values.availability(stock).alias("available"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS filled, [p_name, p_brand, p_type] AS items, '&lt;b a=&quot;' || replace(p_brand, '&', '&amp;') || '&quot;&gt;&#39;&amp;' AS escaped,
  CASE WHEN length(p_name) <= 9 THEN p_name ELSE rtrim(substr(p_name, 1, 8)) || '…' END AS excerpt, lpad(CAST(p_size AS VARCHAR), 6, '0') AS padded,
  CASE WHEN regexp_matches(p_name, 'widget') THEN 'w' WHEN regexp_matches(p_name, '^[a-l]') THEN 'early' ELSE 'late' END AS kind, CASE WHEN p_size % 3 > 0 THEN 'u' || p_partkey || '@a.org' END AS email,
  p_name || ' und ' || lower(p_type) AS identity, CASE WHEN p_size % 2 = 0 THEN 'Big ' || p_name END AS quote FROM part
""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, even = F.col("p_name"), F.col("p_size") % 2 == 0
    email = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit(" U"), F.col("p_partkey").cast("string"), F.lit("@A.org "))).when(F.col("p_size") % 3 == 2, F.concat(F.lit("u"), F.col("p_partkey").cast("string"), F.lit("@a.org"))).otherwise("no address")
    said = F.concat(F.lit("They say: **Big**  "), F.replace(name, F.lit(" "), F.lit("\n ")), F.lit(" is good"))
    found = F.regexp_replace(F.regexp_replace(tx.anchor_quote(F.when(even, F.concat(F.lit("big "), name)).otherwise("never said"), said), r"[*]", ""), r"\s+", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.blank_to_null(F.when(even, F.concat(F.lit(" \t"), name, F.lit("﻿"))).otherwise("   ")).alias("filled"), tx.list_items(F.concat(name, F.lit(" ,, "), "p_brand", F.lit("\n"), "p_type")).alias("items"),
        tx.html_escape(F.concat(F.lit('<b a="'), "p_brand", F.lit("\">'&"))).alias("escaped"), tx.excerpt(name, 9).alias("excerpt"), tx.padded(F.col("p_size")).alias("padded"),
        tx.first_match(name, [("widget", "w"), ("^[a-l]", "early")], "late").alias("kind"), tx.email_normal(email).alias("email"), tx.identity_key(F.concat(F.lit("*"), name, F.lit("*  `ＵＮＤ` "), "p_type")).alias("identity"), found.alias("quote"),
    )


_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_QUERY = f"list_sort(list_filter(string_split(regexp_extract(url, {_U}, 6), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('width', 'height', 'crop', 'format')))"


@query(f"""
WITH p AS (SELECT page_id, url || CASE WHEN contains(url, '?') OR contains(url, '#') THEN '' ELSE '?width=5&b=2&a=1' END AS url FROM pages), q AS (SELECT *, {_QUERY} AS kept, lower(regexp_extract(url, {_U}, 3)) AS host, regexp_extract(url, {_U}, 5) AS path FROM p)
SELECT page_id, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS image_key, 'item-' || page_id AS handle, lower(regexp_extract(url, {_U}, 1)) || '://' || host || regexp_replace(path, '/$', '') || '.js' AS json_url FROM q
""")
def url_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    url = F.concat(u, F.when(F.contains(u, F.lit("?")) | F.contains(u, F.lit("#")), "").otherwise("?width=5&b=2&a=1"))
    shop = F.concat(F.lit("https://a.example/en/products/item-"), F.col("page_id").cast("string"), F.lit("/reviews?x=1"))
    return table(spark, sf_dir, "pages").select("page_id", urls.image_key(url).alias("image_key"), urls.handle(shop).alias("handle"), urls.product_json_url(url).alias("json_url"))


_KINDS = ["an instant download of songs", "custom gift card", "handmade oak table", "watch with a UPC label", "plain shirt", "hand made barcode scanner", "gaming laptop", "mattress made to order"]


@query("""
WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS code, p_size % 3 = 0 AS brand, p_partkey % 8 AS k FROM part), t AS (SELECT *, k IN (0, 1) AS digital FROM p)
SELECT p_partkey, digital, NOT digital AND (code OR k IN (3, 5) OR (brand AND k NOT IN (2, 5, 7))) AS identifier_relevant, NOT digital AND k IN (3, 6, 7) AS warranty_relevant FROM t
""")
def relevance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    found = readiness.relevance(text, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in found.items()])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (-F.col("value")).alias("down"), "event_id", "value")
    return readiness.first_of_each(rows, ["user_id", "event_type"], ["down", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH e AS (SELECT event_id, event_type, user_id % 4 AS u FROM events)
SELECT event_id, CASE u WHEN 0 THEN 'unknown' WHEN 1 THEN 'issues_found' WHEN 2 THEN 'readable' ELSE 'partial' END AS technical, CASE event_type WHEN 'view' THEN 'discovery' WHEN 'click' THEN 'comparison' WHEN 'error' THEN 'caveat_check' ELSE 'refinement' END AS stage,
  CASE event_type WHEN 'view' THEN 'execute' WHEN 'click' THEN 'advance' WHEN 'error' THEN 'reconcile' ELSE 'ignore' END AS replay, CASE u WHEN 0 THEN 'shop.org' WHEN 1 THEN 'host.net' ELSE 'A long title' END AS label FROM e
""")
def report_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, kind = F.col("user_id") % 4, F.col("event_type")
    status = F.when(u == 0, F.lit(None).cast("string")).when(u == 2, "complete").otherwise("partial")
    codes = F.when(u == 1, F.array(F.lit("X"), F.lit("CRAWLER_BLOCKED"))).otherwise(F.array(F.lit("MISSING_CANONICAL")))
    action = F.when(kind == "view", "explore").when(kind == "click", "compare").when(kind == "error", "verify").otherwise("finish")
    call = F.when(kind == "view", "reserved").when(kind == "click", "completed").when(kind == "error", "running").otherwise("failed")
    title = F.when(u == 0, "www.shop.org").when(u == 1, "Some title").otherwise("A long title")
    host = F.when(u == 1, "www.host.net").otherwise("vertexaisearch.cloud.google.com")
    return table(spark, sf_dir, "events").select("event_id", report.technical_summary(status, codes).alias("technical"), report.stage(action).alias("stage"), report.replay_action(call).alias("replay"), report.publisher_label(title, host).alias("label"))
