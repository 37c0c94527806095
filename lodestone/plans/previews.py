"""Captured products settled field by field and checked by rules: pages of twelve variants, and pages with one thing wrong each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls
from ..operators import preview, readiness, record, robots
from ..sources.tables import spread, table
from .registry import query

_FIELDS = ("sku", "barcode", "price", "currency", "availability", "image", "canonical_url")
_IMAGE = "//cdn.shopify.com/s/files/1/0014/3514/files/c.jpg?v=1"


def _variant_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with twelve variants for each supplier; s_suppkey % 10 says what one of its nodes has wrong."""
    k, case = F.col("s_suppkey"), F.col("s_suppkey") % 10
    url = F.concat(F.lit("https://shop.example/products/c-"), k.cast("string"))
    number = lambda i: (k * 100 + i).cast("string")
    price = lambda i: 84900 + i * 100
    wrong = lambda n, i, at: (case == n) & (i == at)

    def node(i: Column) -> Column:
        offer = F.struct(
            F.lit("Offer").alias("@type"), F.concat(url, F.lit("?variant="), number(i)).alias("url"), F.when(wrong(2, i, 10), 1.0).otherwise(price(i) / 100).alias("price"), F.lit("INR").alias("priceCurrency"),
            F.concat(F.lit("https://schema.org/"), F.when((i < 4) | wrong(3, i, 10), "InStock").otherwise("OutOfStock")).alias("availability"),
        )
        image = F.when(wrong(5, i, 0), "https://shop.example/cdn/shop/files/other.jpg?v=1").when(wrong(6, i, 0), "http://shop.example/cdn/shop/files/c.jpg?v=1").when(wrong(7, i, 0), "https://shop.example/cdn/shop/files/c.jpg?v=2").otherwise("https://shop.example/cdn/shop/files/c.jpg?v=1&width=1200")
        return F.struct(
            F.lit("Product").alias("@type"), F.concat(url, F.lit("?variant="), number(i)).alias("url"), F.lit("Cushion").alias("name"), F.when(wrong(1, i, 10), "WRONG").otherwise(F.concat(F.lit("SKU-"), number(i))).alias("sku"),
            F.when(wrong(4, i, 10), "WRONG").otherwise(F.concat(F.lit("89"), number(i))).alias("gtin"), image.alias("image"), offer.alias("offers"),
        )

    nodes = F.transform(F.sequence(F.lit(0), F.lit(11)), node)
    nodes = F.when(case == 8, F.concat(nodes, F.array(F.element_at(nodes, 1).withField("offers.price", F.lit(100.0))))).otherwise(nodes)
    variant = lambda i: F.struct(number(i).alias("id"), F.concat(F.lit("Shade "), i.cast("string")).alias("title"), F.concat(F.lit("SKU-"), number(i)).alias("sku"), F.concat(F.lit("89"), number(i)).alias("barcode"), (i < 4).alias("available"), price(i).alias("price"))
    feed = F.struct(F.lit(42).alias("id"), F.lit("c").alias("handle"), F.lit("Cushion").alias("title"), F.lit("Face").alias("type"), F.lit("Brand").alias("vendor"), F.lit(True).alias("available"), F.lit(84900).alias("price"), F.lit(_IMAGE).alias("featured_image"), F.array(F.lit(_IMAGE)).alias("images"), F.transform(F.sequence(F.lit(0), F.lit(11)), variant).alias("variants"))
    group = F.struct(F.lit("ProductGroup").alias("@type"), nodes.alias("hasVariant"))
    page = F.concat(F.lit('<script>Shopify.currency = {"active":"INR"};</script><link rel="canonical" href="'), url, F.lit('"><h1>Cushion</h1><script type="application/ld+json">'), F.to_json(group), F.lit("</script>"))
    # the last case chooses a variant in its address; a part of them one that isn't there
    chosen = F.when(case == 9, F.concat(url, F.lit("?variant="), F.when(k % 20 == 9, number(F.lit(2))).otherwise("7"))).otherwise(url)
    return spread(table(spark, sf_dir, "supplier")).select(k.alias("supplier"), chosen.alias("url"), F.to_json(feed).alias("feed_body"), page.alias("page_html"))


def _long(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"fields.{f}.state").alias("state"), F.col(f"fields.{f}.value").alias("value"), F.try_element_at(F.col(f"fields.{f}.observations"), F.lit(1))["path"].alias("first_path")) for f in fields])
    return rows.select(key, F.explode(each).alias("f")).select(key, "f.*")


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 10 AS c, s_suppkey % 20 = 9 AS there FROM supplier),
f AS (SELECT k, c, there, unnest(['sku', 'barcode', 'price', 'currency', 'availability', 'image', 'canonical_url']) AS field FROM s),
t AS (SELECT *, CASE WHEN c = 9 AND NOT there AND field IN ('sku', 'barcode', 'price', 'availability') THEN 'incomplete' WHEN c = 9 AND NOT there AND field = 'currency' THEN 'single_source'
  WHEN (c = 1 AND field = 'sku') OR (c IN (2, 8) AND field = 'price') OR (c = 3 AND field = 'availability') OR (c = 4 AND field = 'barcode') OR (c IN (5, 7) AND field = 'image') THEN 'conflicted' ELSE 'verified' END AS state FROM f)
SELECT k AS supplier, field, state,
  CASE WHEN state IN ('verified', 'single_source') THEN CASE field WHEN 'sku' THEN 'SKU-' || (k * 100 + CASE WHEN c = 9 THEN 2 ELSE 0 END) WHEN 'barcode' THEN '89' || (k * 100 + CASE WHEN c = 9 THEN 2 ELSE 0 END)
    WHEN 'price' THEN CASE WHEN c = 9 THEN '85100' ELSE '84900' END WHEN 'currency' THEN 'INR' WHEN 'availability' THEN 'true' WHEN 'image' THEN 'https://cdn.shopify.com/s/files/1/0014/3514/files/c.jpg?v=1' ELSE 'https://shop.example/products/c-' || k END END AS value,
  CASE WHEN state = 'incomplete' THEN NULL WHEN field = 'image' THEN 'featured_image' WHEN field = 'canonical_url' THEN 'link[rel=canonical]' WHEN field = 'currency' THEN 'Shopify.currency.active'
    WHEN c = 9 THEN 'variants[2].' || CASE field WHEN 'price' THEN 'price_minor' WHEN 'availability' THEN 'available' ELSE field END
    WHEN field = 'price' THEN CASE c WHEN 2 THEN 'variants[10].price_minor' WHEN 8 THEN 'variants[0].price_minor' ELSE 'price (product minimum)' END
    WHEN state = 'conflicted' THEN 'variants[10].' || CASE field WHEN 'availability' THEN 'available' ELSE field END
    ELSE CASE field WHEN 'availability' THEN 'available' ELSE 'variants[0].' || field END END AS first_path
FROM t
""")
def variant_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(record.records(_variant_captures(spark, sf_dir), _FIELDS), "supplier", _FIELDS)


_SITES = (("s0", "User-agent: GPTBot\nDisallow: /products/\n"), ("s1", "User-agent: *\nDisallow: /products/p-1\n"))


def _preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """previews() of a capture for each part; p_partkey % 12 says what is wrong with it, p_size % 2 whose crawler rules hold."""
    p = spread(table(spark, sf_dir, "part"))
    k, case = F.col("p_partkey").cast("string"), F.col("p_partkey") % 12
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    image = F.concat(F.lit("/i/"), k, F.lit(".png"))
    title = F.when(case == 8, F.concat(F.lit("Gift card "), "p_name")).otherwise(F.col("p_name"))
    variant = F.struct(k.alias("id"), F.concat(F.lit("S"), k).alias("sku"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("0"), k)).alias("barcode"), cents.alias("price"), F.lit(True).alias("available"))
    feed = F.to_json(F.struct(k.alias("id"), F.concat(F.lit("p-"), k).alias("handle"), title.alias("title"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("type"), image.alias("featured_image"), F.array(image).alias("images"), F.array(variant).alias("variants")))
    ships = lambda days: F.struct(F.lit("x").alias("@context"), F.lit("OfferShippingDetails").alias("@type"), F.lit(days).alias("days"), F.lit("  ").alias("note"))
    offer = F.struct(
        F.concat((cents / 100).cast("decimal(18,2)").cast("string"), F.lit("")).alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"), F.concat(F.lit("S"), k).alias("sku"),
        F.when(case == 10, ships(5)).when(case != 8, ships(3)).alias("shippingDetails"),
    )
    name = F.when(case == 7, "Other").otherwise(title)
    node = F.to_json(F.struct(
        F.lit("Product").alias("@type"), name.alias("name"), F.concat(F.lit("S"), k).alias("sku"), F.struct(F.col("p_brand").alias("name")).alias("brand"), image.alias("image"), F.array(offer).alias("offers"), F.when(case != 8, ships(3)).alias("shippingDetails"),
        F.when(case != 8, F.struct(F.lit(30).alias("days"))).alias("hasMerchantReturnPolicy"), F.when(F.col("p_size") % 3 == 0, "2 years").alias("warranty"),
    ))
    more = F.when(case == 9, F.concat(F.lit(',{"@type":"Product","name":"'), title, F.lit('"}'))).otherwise("")
    blocks = F.when(case == 2, '<script type="application/ld+json">{"@type":</script>').otherwise(F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"deep":['), node, F.lit("]}"), more, F.lit("]}</script>")))
    link = F.when(case == 1, "").otherwise(F.concat(F.lit('<link rel="canonical" href="/products/p-'), k, F.lit('">')))
    robots_tag = F.when(case == 5, '<meta name="robots" content="NOINDEX, follow">').otherwise("")
    whole = F.concat(F.lit('<script>Shopify.currency = {"active":"USD","rate":"1.0"};</script>'), link, robots_tag, blocks, F.lit("<h1>"), name, F.lit("</h1>"))
    page = F.when(case == 4, F.concat(link, F.lit('<div class="shopify-section-password">closed</div>'))).when(case == 11, F.concat(link, F.lit("<p>Please verify you are human</p>"))).otherwise(whole)
    captures = p.select(
        F.col("p_partkey").alias("part"), F.concat(F.lit("s"), (F.col("p_size") % 2).cast("string")).alias("site"), F.concat(F.lit("https://shop.example/products/p-"), k).alias("url"), F.when(case != 3, feed).alias("feed_body"), page.alias("page_html"),
        F.when(case == 6, 503).otherwise(200).alias("robots_status"), F.when(case == 5, "none").alias("x_robots"),
    )
    parsed = robots.rules(spark.createDataFrame(list(_SITES), "site string, body string"), "site")
    access = robots.access(captures.select(F.col("part").alias("page"), "site", urls.part(F.col("url"), 5).alias("path")), parsed, "site")
    return preview.previews(record.records(preview.technical(captures, access, "part")), None, "part")


# shut: nothing but the feed can be read; one: the site closes these products to all
_CASES = """p AS (SELECT p_partkey AS part, CAST(p_partkey AS VARCHAR) AS k, p_partkey % 12 AS c, p_size % 2 = 0 AS coded, p_size % 3 = 0 AS warranted, p_partkey % 12 IN (4, 11) AS shut,
  p_size % 2 = 1 AND CAST(p_partkey AS VARCHAR) LIKE '1%' AS one FROM part),
x AS (
SELECT part, 'finding:PAGE_NOINDEX' AS id, 'present' AS status, 'error' AS severity, true AS relevant, 3 AS n FROM p WHERE c = 5
UNION ALL SELECT part, 'finding:CRAWLER_BLOCKED:' || a, 'present', CASE WHEN a = 'GPTBot' THEN 'warning' ELSE 'error' END, true, 1 FROM p, (VALUES ('general'), ('OAI-SearchBot'), ('GPTBot')) v(a) WHERE c <> 6 AND (one OR (coded AND a = 'GPTBot'))
UNION ALL SELECT part, 'finding:ROBOTS_UNAVAILABLE', 'unavailable', 'warning', true, 1 FROM p WHERE c = 6
UNION ALL SELECT part, 'finding:MISSING_CANONICAL', 'missing', 'warning', true, 1 FROM p WHERE c = 1
UNION ALL SELECT part, 'finding:MALFORMED_JSON_LD', 'unavailable', 'warning', true, 1 FROM p WHERE c = 2
UNION ALL SELECT part, 'finding:MULTIPLE_PRODUCT_JSON_LD', 'present', 'info', true, 1 FROM p WHERE c = 9
UNION ALL SELECT part, CASE c WHEN 4 THEN 'finding:PASSWORD_PAGE' ELSE 'finding:CHALLENGE_PAGE' END, 'unavailable', 'error', true, 1 FROM p WHERE shut
UNION ALL SELECT part, 'finding:AJAX_PRODUCT_UNAVAILABLE', 'unavailable', 'warning', true, 1 FROM p WHERE c = 3
UNION ALL SELECT part, 'finding:FIELD_CONFLICT:title', 'conflicting', 'warning', true, 3 FROM p WHERE c = 7
UNION ALL SELECT part, 'finding:FIELD_CONFLICT:shipping_details', 'conflicting', 'warning', true, 2 FROM p WHERE c = 10
UNION ALL SELECT part, 'presence:' || t, CASE WHEN c = 8 THEN 'missing' ELSE 'unavailable' END, CASE WHEN c = 8 THEN 'info' ELSE 'warning' END, c <> 8, 1 FROM p, (VALUES ('shipping'), ('returns')) v(t) WHERE c IN (2, 8) OR shut
UNION ALL SELECT part, 'presence:warranty', CASE WHEN c = 2 OR shut THEN 'unavailable' ELSE 'missing' END, CASE WHEN c = 2 OR shut THEN 'warning' ELSE 'info' END, false, 1 FROM p WHERE c = 2 OR shut OR NOT warranted
UNION ALL SELECT part, 'presence:gtin', CASE WHEN c = 3 OR shut THEN 'unavailable' ELSE 'missing' END, CASE WHEN c = 3 OR shut THEN 'warning' ELSE 'info' END, false, 1 FROM p WHERE c = 3 OR NOT coded
UNION ALL SELECT part, 'presence:' || t, 'unavailable', 'warning', true, 1 FROM p, (VALUES ('json_ld_product'), ('json_ld_offer')) v(t) WHERE c = 2 OR shut
UNION ALL SELECT part, 'field:category', 'unavailable', 'warning', true, 1 FROM p WHERE c = 3
UNION ALL SELECT part, 'field:currency', 'missing', 'error', true, 1 FROM p WHERE shut)"""


@query(f"WITH {_CASES} SELECT part, id, status, severity, relevant, n FROM x")
def preview_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _preview_rows(spark, sf_dir).select("part", F.explode("findings").alias("f"))
    return f.select("part", F.col("f.definition_id").alias("id"), "f.status", "f.severity", "f.relevant", F.size("f.evidence").alias("n"))


_OUT = "CASE severity WHEN 'error' THEN 'fail' WHEN 'warning' THEN 'warn' ELSE 'pass' END"


@query(f"""
WITH {_CASES}, f AS (SELECT part, CASE id WHEN 'finding:FIELD_CONFLICT:title' THEN 'field:title' WHEN 'finding:FIELD_CONFLICT:shipping_details' THEN 'presence:shipping' WHEN 'finding:PAGE_NOINDEX' THEN 'indexable' WHEN 'finding:MISSING_CANONICAL' THEN 'canonical'
  WHEN 'finding:ROBOTS_UNAVAILABLE' THEN 'robots' WHEN 'finding:CRAWLER_BLOCKED:general' THEN 'crawler:*' ELSE replace(id, 'finding:CRAWLER_BLOCKED:', 'crawler:') END AS id, CASE WHEN id LIKE 'finding:CRAWLER%' THEN 'fail' ELSE {_OUT} END AS outcome FROM x),
e AS (SELECT part, c, unnest(['completeness', 'field:title', 'field:category', 'field:price', 'field:currency', 'field:availability', 'presence:brand', 'presence:sku', 'presence:gtin', 'presence:image', 'presence:shipping', 'presence:returns', 'presence:warranty',
  'presence:json_ld_product', 'presence:json_ld_offer', 'indexable', 'canonical', 'robots', 'crawler:*', 'crawler:OAI-SearchBot', 'crawler:GPTBot']) AS id FROM p)
SELECT coalesce(e.part, f.part) AS part, coalesce(e.id, f.id) AS id, CASE WHEN c = 6 AND (e.id = 'completeness' OR e.id LIKE 'crawler:%') THEN 'warn' ELSE coalesce(outcome, 'pass') END AS outcome FROM e FULL JOIN f ON e.part = f.part AND e.id = f.id
""")
def preview_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _preview_rows(spark, sf_dir).select("part", F.explode("checks").alias("c"))
    return c.select("part", "c.id", "c.outcome")


@query(f"""
WITH {_CASES}, n AS (SELECT part, count(CASE WHEN severity = 'error' THEN 1 END) AS e, count(CASE WHEN severity = 'warning' THEN 1 END) AS w, count(CASE WHEN severity = 'info' THEN 1 END) AS i FROM x GROUP BY part), q AS (SELECT p_partkey AS part, p_name, p_type, p_brand, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM part)
SELECT p.part, CASE WHEN c = 6 THEN 'partial' ELSE 'complete' END AS status, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(i, 0) AS infos, CASE WHEN c = 3 THEN 0 ELSE 1 END AS variants, CASE WHEN c = 3 THEN 0 ELSE 1 END AS available,
  CASE WHEN shut THEN 'single_source' WHEN c IN (2, 3) THEN 'single_source' ELSE 'verified' END AS price_state, CAST(cents AS VARCHAR) AS price, cents AS minimum_minor, CASE WHEN NOT shut THEN 'USD' END AS currency,
  CASE WHEN c = 7 THEN NULL WHEN c = 8 THEN 'Gift card ' || p_name ELSE p_name END AS title, CASE WHEN c = 3 THEN NULL ELSE p_type END AS category,
  CASE WHEN shut OR c = 2 THEN 'shopify_ajax' WHEN c = 3 THEN 'json_ld' ELSE 'shopify_ajax json_ld' END AS brand_sources, CASE c WHEN 7 THEN 'title from Shopify Ajax /products/{{handle}}.js · title = "' || p_name || '"; title from JSON-LD on the product page · products[0].name = "Other"; title from Visible product HTML · h1 = "Other"' END AS title_conflict,
  CASE c WHEN 10 THEN '{{"@type":"OfferShippingDetails","days":3}}' END AS shipping_value
FROM p JOIN q USING (part) LEFT JOIN n USING (part)
""")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _preview_rows(spark, sf_dir)
    found = lambda fid: F.try_element_at(F.filter("findings", lambda f: f["definition_id"] == fid), F.lit(1))["evidence"]
    title, ships = found("finding:FIELD_CONFLICT:title"), found("finding:FIELD_CONFLICT:shipping_details")
    return rows.select(
        "part", "status", F.col("finding_counts.error").alias("errors"), F.col("finding_counts.warning").alias("warnings"), F.col("finding_counts.info").alias("infos"), F.col("variant_summary.total").cast("int").alias("variants"), F.col("variant_summary.available").cast("int").alias("available"),
        F.col("fields.price.state").alias("price_state"), F.col("fields.price.value").alias("price"), "price_context.minimum_minor", "price_context.currency", F.col("fields.title.value").alias("title"), F.col("fields.category.value").alias("category"),
        F.array_join(F.element_at("presence", 1)["sources"], " ").alias("brand_sources"), F.when(title.isNotNull(), readiness.evidence_line(title)).alias("title_conflict"), F.get_json_object(F.concat(F.lit("["), F.element_at(ships, 1)["value"], F.lit("]")), "$[0]").alias("shipping_value"),
    )
