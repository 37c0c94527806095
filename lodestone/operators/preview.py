"""A settled capture checked against a versioned catalogue of rules: presence, findings with evidence, readiness checks, one nested preview a row.

The catalogue is a small table. It is compiled into one expression over a record's nested fields, so rows are neither
exploded nor shuffled; only crawler rules, which belong to a site, are joined in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rows import once
from . import readiness, robots

#: A catalogue with more rules than this is refused: it becomes part of the plan.
MOST_RULES = 1000
VERSION = "2026-10-05.1"

_PRODUCT = "Shopify admin → Products → this product"
#: The rules' texts. A rule's messages go by the state it reports; {…} stands for what is filled in.
RULES = [
    # rule, code, severity (null: from the state), messages by state, guidance
    ("finding:PAGE_NOINDEX", "PAGE_NOINDEX", "error", {"present": "The product page declares noindex/none in page-level robots directives."}, "Shopify admin → Online Store → Themes (product template) or the SEO app on this product. Remove noindex or none from the page meta robots / X-Robots-Tag."),
    ("finding:CRAWLER_BLOCKED", "CRAWLER_BLOCKED", None, {"present": "{agent} is blocked from the captured product path by robots.txt."}, "Inspect /robots.txt for this hostname. Shopify: Online Store → Themes → robots.txt.liquid, or the app that publishes robots rules. Allow this /products/{handle} path for the blocked user-agent."),
    ("finding:ROBOTS_UNAVAILABLE", "ROBOTS_UNAVAILABLE", "warning", {"unavailable": "{reason} This preview could not verify crawler rules; that is a failed read, not proof the storefront blocks crawlers."}, "Open https://{shop}/robots.txt in a browser. Shopify serves this automatically; a 404 or timeout here is a capture limit until the file responds."),
    ("finding:MISSING_CANONICAL", "MISSING_CANONICAL", "warning", {"missing": "No canonical product URL was found."}, "Theme product template should output <link rel=\"canonical\" href=\"https://…/products/{handle}\">. Check a custom theme or SEO app if Shopify’s default canonical was removed."),
    ("finding:MALFORMED_JSON_LD", "MALFORMED_JSON_LD", "warning", {"unavailable": "{count} JSON-LD block(s) could not be parsed. Structured product fields that only exist in those blocks could not be verified."}, "View Source on the product URL and fix invalid application/ld+json in the product template or SEO app. Do not treat the unreadable blocks as missing merchant fields."),
    ("finding:MULTIPLE_PRODUCT_JSON_LD", "MULTIPLE_PRODUCT_JSON_LD", "info", {"present": "Multiple Product JSON-LD nodes were found and all were retained."}, "Review the Product entries in the theme or SEO app. Multiple entries may describe valid variants; correct conflicting duplicates without removing valid variant data."),
    ("finding:PASSWORD_PAGE", "PASSWORD_PAGE", "error", {"unavailable": "The storefront returned a password page."}, "Shopify admin → Online Store → Preferences → Password protection. Turn the storefront password off so this product URL is public."),
    ("finding:CHALLENGE_PAGE", "CHALLENGE_PAGE", "error", {"unavailable": "The storefront returned a bot challenge."}, "A bot challenge replaced the product HTML. Check storefront bot protection, a security app, or a challenge interstitial on this URL."),
    ("finding:AJAX_PRODUCT_UNAVAILABLE", "AJAX_PRODUCT_UNAVAILABLE", "warning", {"unavailable": "{reason} Fields that come from Shopify Ajax were marked incomplete instead of missing."}, "Open /products/{handle}.js while logged out. If that payload is blocked, a theme or app is hiding Shopify Ajax product JSON. This is a failed source read, not a blank catalog field."),
    ("finding:FIELD_CONFLICT", "FIELD_CONFLICT", "warning", {"conflicting": "Sources disagree on {label}."}, f"Compare {_PRODUCT} with the theme JSON-LD for {{label}}. Align the disagreeing source; do not guess which value shopping systems will keep."),
    ("presence:shipping", "SHIPPING_NOT_IN_CAPTURE", None, {"missing": "Shipping details were not found in product structured data. Visible shipping text and separate policy pages have not been verified.", "unavailable": "Shipping information could not be verified because this preview could not finish reading the product-page sources that would contain it."}, "This preview only inspects the submitted product URL. Check Shopify admin → Settings → Shipping and delivery, or Online Store → Pages / Policies → Shipping policy. To expose shipping on the product itself, add OfferShippingDetails in the product template JSON-LD."),
    ("presence:returns", "RETURNS_NOT_IN_CAPTURE", None, {"missing": "Return-policy details were not found in product structured data. Visible return statements and separate policy pages have not been verified.", "unavailable": "Return-policy information could not be verified from the captured product-page sources."}, "Check Shopify admin → Settings → Policies → Refund policy, or the product template JSON-LD hasMerchantReturnPolicy node. A store-wide policy page is outside this product capture."),
    ("presence:warranty", "WARRANTY_NOT_IN_CAPTURE", None, {"missing": "Warranty details weren’t found in the captured product data for this product.", "irrelevant": "Warranty details weren’t found in the captured product data. This preview does not treat a warranty as required for this product.", "unavailable": "Warranty information could not be verified from the captured product-page sources."}, "Shopify has no dedicated warranty field. If this product needs one, add it in the product description or a WarrantyPromise JSON-LD node on the product template. Skip this when warranty does not apply."),
    ("presence:gtin", "GTIN_NOT_IN_CAPTURE", None, {"missing": "No GTIN/barcode was found on the captured variants for this product.", "irrelevant": "No GTIN/barcode was found in the captured product data. This preview does not treat a barcode as required for this product.", "unavailable": "A GTIN/barcode could not be verified because a product-page source was incomplete."}, "Shopify admin → Products → this product → Variants → Barcode (ISBN, UPC, GTIN-13, or GTIN-14). Leave blank for handmade, custom, or digital products that do not have a trade identifier."),
    *[(f"presence:{key}", f"PRESENCE_{key.upper()}", None, {"missing": f"{label} was not found in captured product data.", "unavailable": f"{label} could not be read because a product-page source was incomplete."}, guidance) for key, label, guidance in (
        ("brand", "Brand", f"{_PRODUCT} → Vendor. Review the brand in Ajax and JSON-LD."), ("sku", "SKU", f"{_PRODUCT} → Variants → SKU. Give each variant its own SKU."),
        ("image", "Image", f"{_PRODUCT} → Media. Review featured image, og:image and Product.image."), ("json_ld_product", "JSON-LD Product", "Theme product template or SEO app: emit Product JSON-LD on this URL."),
        ("json_ld_offer", "JSON-LD Offer", "Theme product template or SEO app: emit Offer price and availability matching the same Shopify variant and currency."),
    )],
    *[(f"field:{name}", f"FIELD_{name.upper()}", None, {"missing": f"{name.capitalize()} was not found in captured data.", "unavailable": f"{name.capitalize()} could not be resolved from the captured sources."}, "Inspect explicit currency codes in Shopify runtime data and Offer.priceCurrency; a dollar symbol does not establish a currency." if name == "currency" else
       "Review the submitted product or variant in Shopify admin → Products and its theme structured data. Recheck incomplete sources before adding catalog fields.") for name in ("title", "category", "price", "currency", "availability")],
]
#: What a presence tile reads (key, label, field, whether only JSON-LD has it), and the evidence named where there is none (source, path).
TILES = [
    ("brand", "Brand", "vendor_brand", False, ("shopify_ajax", "vendor_brand")), ("sku", "SKU", "sku", False, ("shopify_ajax", "sku")), ("gtin", "GTIN", "barcode", False, ("shopify_ajax", "variants[].barcode / Product.gtin*")), ("image", "Image", "image", False, ("shopify_ajax", "image")),
    ("shipping", "Shipping", "shipping_details", True, ("json_ld", "Product.shippingDetails / Offer.shippingDetails")), ("returns", "Returns", "merchant_return_policy", True, ("json_ld", "Product.hasMerchantReturnPolicy / Offer.hasMerchantReturnPolicy")),
    ("warranty", "Warranty", "warranty", True, ("json_ld", "Product.warranty / Product.hasWarrantyPromise")),
]
#: Fields as messages name them, previewed fields, crawlers' labels, findings' labels, and codes that have a check of their own.
FIELD_LABELS = {"product_id": "product identity", "canonical_url": "canonical URL", "vendor_brand": "brand / vendor", "product_type_category": "product type / category", "taxonomy_hints": "collection-or-taxonomy hints", "merchant_return_policy": "merchant return policy", "shipping_details": "shipping details"}
PREVIEWED = {"title": "title", "category": "product_type_category", "price": "price", "currency": "currency", "availability": "availability"}
CRAWLERS = {"*": "General crawlers", "OAI-SearchBot": "OpenAI SearchBot", "GPTBot": "GPTBot"}
CHECK_LABELS = {"PASSWORD_PAGE": "Public storefront", "CHALLENGE_PAGE": "No challenge page", "MALFORMED_JSON_LD": "Parseable JSON-LD", "MULTIPLE_PRODUCT_JSON_LD": "Product data entries", "AJAX_PRODUCT_UNAVAILABLE": "Shopify Ajax JSON"}
OWN_CHECK = ("PAGE_NOINDEX", "CRAWLER_BLOCKED", "ROBOTS_UNAVAILABLE", "MISSING_CANONICAL", "SHIPPING_NOT_IN_CAPTURE", "RETURNS_NOT_IN_CAPTURE", "WARRANTY_NOT_IN_CAPTURE", "GTIN_NOT_IN_CAPTURE")
NOTE = "This free preview checks observable product data only. It does not run the controlled AI shopping test."
_TEXT = ("title", "product_type_category", "description", "taxonomy_hints", "vendor_brand")


def catalogue(spark: SparkSession) -> DataFrame:
    """The rules as a table: rule, version, code, severity, messages (a map by state), guidance."""
    return spark.createDataFrame([(rule, VERSION, *rest) for rule, *rest in RULES], "rule string, version string, code string, severity string, messages map<string,string>, guidance string")


def evidence(field: str, source: Column | str, path: Column | str, value: Column | None = None) -> Column:
    """A piece of evidence; value is a JSON text or null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(field).alias("field"), lit(source).alias("source"), lit(path).alias("path"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def _json(value: Column, kind: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.when(kind == "s", F.substring(quoted, 2, F.length(quoted) - 2)).otherwise(value)


def _observed(field: str, obs: Column, most: int = 4) -> Column:
    return F.transform(F.slice(obs, 1, most), lambda o: evidence(field, o["source"], o["path"], _json(o["value"], o["kind"])))


def agent_id(agent: Column) -> Column:
    """A crawler's name in a rule's id."""
    return F.when(agent == "*", "general").otherwise(F.replace(F.coalesce(agent, F.lit("unknown")), F.lit(" "), F.lit("_")))


def technical(captures: DataFrame, access: DataFrame, key: str) -> DataFrame:
    """captures (key, robots_status, maybe robots_error) with `robots_ok`, `robots_reason` and `crawler_access`.

    access: robots.access() rows by `page` (the key). Every crawler is unknown where the site's rules couldn't be read. A page has one row
    for each crawler there, so what is collected of it is bounded.
    """
    by_page = access.groupBy(F.col("page").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("allowed", "rule")))).alias("_access"))
    rows = captures.join(by_page, key, "left")
    ok = F.coalesce(F.col("robots_status").between(200, 299), F.lit(False))
    reason = F.concat(F.lit("robots.txt returned HTTP "), F.coalesce(F.col("robots_status").cast("string"), F.lit("unknown")), F.lit("."))

    def one(purpose: str, agent: str) -> Column:
        found = F.try_element_at("_access", F.lit(purpose))
        allowed = F.coalesce(found["allowed"], F.lit(True))
        rule = F.when(ok & found["rule"].isNotNull(), F.concat(F.when(allowed, "allow: ").otherwise("disallow: "), found["rule"]))
        return F.struct(F.lit(agent).alias("agent"), F.lit(purpose).alias("purpose"), F.when(~ok, "unknown").when(allowed, "allowed").otherwise("blocked").alias("result"), rule.alias("rule"))

    crawlers = F.array(*[one(p, a) for p, a in robots.AGENTS.items()])
    given = F.col("robots_error") if "robots_error" in captures.columns else F.lit(None).cast("string")
    return once(rows, robots_ok=ok, robots_reason=F.coalesce(given, reason), crawler_access=crawlers).drop("_access")


def _relevance(text: Column, variants: Column, brand: Column) -> dict[str, Column]:
    digital = text.rlike(readiness.DIGITAL)
    some = F.exists(variants, lambda v: v["barcode"].isNotNull())
    gaps = some & F.exists(variants, lambda v: v["barcode"].isNull())
    return {
        "shipping": ~digital, "returns": ~digital, "gtin": ~digital & (gaps | text.rlike(readiness.IDENTIFIER) | (brand.isNotNull() & ~text.rlike(readiness.HANDMADE) & some)),
        "warranty": ~digital & text.rlike(readiness.WARRANTY + r"|(?i)\bwarrant(y|ies)\b"),
    }


def with_presence(rows: DataFrame) -> DataFrame:
    """record.records() rows with `presence`: nine tiles (key, label, field, state, sources, relevant), and the limits they were judged by."""
    fields = F.col("fields")
    text = F.array_join(F.filter(F.array(*[F.when(fields[f]["kind"] == "s", fields[f]["value"]) for f in _TEXT]), lambda x: x.isNotNull()), " ")
    names = [f.name for f in rows.schema["fields"].dataType.fields]
    in_offer = lambda o: (o["source"] == "json_ld") & F.contains(o["path"], F.lit(".offers["))
    offered = F.exists(F.array(*[F.exists(fields[f]["observations"], in_offer) for f in names]), lambda x: x)
    rows = once(rows, product_text=text, n_nodes=F.size("page.products"), offered=offered, blocked=F.col("collection_status") == "blocked")
    variants = F.coalesce("feed.variants", F.array().cast(rows.schema["feed"].dataType["variants"].dataType))
    rows = once(rows, relevant=F.struct(*[c.alias(n) for n, c in _relevance(F.col("product_text"), variants, fields["vendor_brand"]["value"]).items()]), unreadable=(F.col("n_nodes") == 0) & (F.col("page.errors") > 0))

    def tile(key: str, label: str, field: str, state: Column, sources: Column) -> Column:
        relevant = F.col(f"relevant.{key}") if key in ("shipping", "returns", "gtin", "warranty") else F.lit(True)
        return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(field).alias("field"), state.alias("state"), sources.alias("sources"), relevant.alias("relevant"))

    def of_field(key: str, label: str, field: str, json_ld_only: bool, _: tuple) -> Column:
        f = fields[field]
        readable = ~F.col("blocked") & ~(F.col("unreadable") if json_ld_only else F.lit(False))
        return tile(key, label, field, readiness.presence(f["state"], readable), F.array_distinct(F.transform(f["observations"], lambda o: o["source"])))

    def of_node(key: str, label: str, found: Column) -> Column:
        none = F.array().cast("array<string>")
        state = F.when(found, "present").when(F.col("blocked") | F.col("unreadable"), "unavailable").otherwise("missing")
        return tile(key, label, key, state, F.when(found, F.array(F.lit("json_ld"))).otherwise(none))

    tiles = [of_field(*t) for t in TILES] + [of_node("json_ld_product", "JSON-LD Product", F.col("n_nodes") > 0), of_node("json_ld_offer", "JSON-LD Offer", F.col("offered"))]
    return once(rows, presence=F.array(*tiles))


def with_findings(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """with_presence() and technical() rows with `findings`, the first of each (definition_id, code, message), in the order of the rules' kinds.

    rules: a table like catalogue(), the built-in one by default. Rules without a row there report nothing; further rules are not known here.
    """
    rules = catalogue(rows.sparkSession) if rules is None else rules
    table = rules.limit(MOST_RULES + 1).collect()
    if len(table) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    known = {r["rule"]: r for r in table}
    fields, page = F.col("fields"), F.col("page")
    names = [f.name for f in rows.schema["fields"].dataType.fields]
    made: list[Column] = []

    def fill(text: str, given: dict[str, Column | str]) -> Column:
        out = F.lit(text)
        for name, value in given.items():
            out = F.replace(out, F.lit(f"{{{name}}}"), value if isinstance(value, Column) else F.lit(value))
        return out

    def add(rule: str, on: Column, found: Column, state: Column | str, relevant: Column | bool = True, severity: Column | None = None, suffix: Column | str | None = None, **given: Column | str) -> None:
        r = known.get(rule)
        if r is None:
            return
        state, relevant = (x if isinstance(x, Column) else F.lit(x) for x in (state, relevant))
        said = F.lit(None).cast("string")
        for s, text in r["messages"].items():
            if s != "irrelevant":
                said = F.when(state == s, F.when(~relevant, fill(r["messages"].get("irrelevant", text) if s == "missing" else text, given)).otherwise(fill(text, given))).otherwise(said)
        rule_id = F.lit(rule) if suffix is None else F.concat(F.lit(f"{rule}:"), suffix if isinstance(suffix, Column) else F.lit(suffix))
        level = F.lit(r["severity"]) if severity is None else severity
        guidance = {k: v for k, v in given.items() if k == "label"}
        out = F.struct(
            rule_id.alias("definition_id"), F.lit(r["version"]).alias("definition_version"), F.lit(r["code"]).alias("code"), level.alias("severity"), state.alias("status"), said.alias("message"),
            found.alias("evidence"), fill(r["guidance"], guidance).alias("guidance"), relevant.alias("relevant"),
        )
        made.append(F.when(on, out))

    header = F.coalesce(F.transform(F.filter(F.split(F.col("x_robots") if "x_robots" in rows.columns else F.lit(None).cast("string"), ","), lambda d: F.trim(d) != ""), lambda d: F.lower(F.trim(d))), F.array().cast("array<string>"))
    rows = once(rows, header_robots=header)
    directives = F.concat(page["robots"], "header_robots")
    add("finding:PAGE_NOINDEX", robots.noindex(directives), F.concat(F.transform(page["robots"], lambda d: evidence("page_directives", "html_meta", F.concat(F.lit("meta[robots]="), d))), F.transform("header_robots", lambda d: evidence("page_directives", "page_directives", F.concat(F.lit("x-robots-tag="), d)))), "present")
    for i, agent in enumerate(robots.AGENTS.values()):
        c = F.element_at("crawler_access", i + 1)
        rule = F.when(c["rule"].isNotNull(), F.array(evidence("crawler_access", "robots", F.concat(F.lit("robots.txt:"), c["rule"])))).otherwise(F.array().cast("array<struct<field:string,source:string,path:string,value:string>>"))
        add("finding:CRAWLER_BLOCKED", c["result"] == "blocked", rule, "present", severity=F.lit("warning" if agent == "GPTBot" else "error"), suffix=agent_id(F.lit(agent)), agent=agent)
    add("finding:ROBOTS_UNAVAILABLE", ~F.col("robots_ok"), F.array(evidence("robots.txt", "robots", "/robots.txt")), "unavailable", reason=F.col("robots_reason"))
    add("finding:MISSING_CANONICAL", page["canonical"]["value"].isNull(), F.array(evidence("canonical_url", "html_meta", "link[rel=canonical]")), "missing")
    add("finding:MALFORMED_JSON_LD", page["errors"] > 0, F.array(evidence("json_ld", "json_ld", "script[type=application/ld+json]")), "unavailable", count=page["errors"].cast("string"))
    loose = F.exists(page["products"], lambda n: n["variant"].isNull())
    add("finding:MULTIPLE_PRODUCT_JSON_LD", (F.col("n_nodes") > 1) & loose, F.array(evidence("json_ld_product", "json_ld", F.concat(F.lit("Product nodes: "), F.col("n_nodes").cast("string")))), "present")
    for code, flag, shown in (("PASSWORD_PAGE", "password", "password page"), ("CHALLENGE_PAGE", "challenge", "challenge page")):
        add(f"finding:{code}", page[flag], F.array(evidence("storefront", "visible_html", shown)), "unavailable")
    no_feed = F.coalesce(F.col("feed_error") if "feed_error" in rows.columns else F.lit(None).cast("string"), F.lit("Shopify Ajax product JSON was unavailable."))
    add("finding:AJAX_PRODUCT_UNAVAILABLE", F.col("feed").isNull(), F.array(evidence("shopify_ajax", "shopify_ajax", "/products/{handle}.js")), "unavailable", reason=no_feed)
    for f in names:
        add("finding:FIELD_CONFLICT", fields[f]["state"] == "conflicted", _observed(f, fields[f]["observations"]), "conflicting", suffix=f, label=FIELD_LABELS.get(f, f.replace("_", " ")))
    # a conflict has been reported already; what is missing or unreadable has a rule by tile
    tiles = [(t[0], t[2], t[4]) for t in TILES] + [("json_ld_product", None, ("json_ld", "Product")), ("json_ld_offer", None, ("json_ld", "Product.offers"))]
    place = {key: i + 1 for i, (key, _, _) in enumerate(tiles)}
    for key, field, (source, path) in sorted(tiles, key=lambda t: ["shipping", "returns", "warranty", "gtin"].index(t[0]) if t[0] in ("shipping", "returns", "warranty", "gtin") else 4):
        t = F.element_at("presence", place[key])
        found = F.array(evidence(field or key, source, path))
        if field:
            found = F.when(F.size(fields[field]["observations"]) > 0, _observed(field, fields[field]["observations"])).otherwise(found)
        add(f"presence:{key}", t["state"].isin("missing", "unavailable"), found, t["state"], t["relevant"], readiness.severity(t["state"], F.lit(key), t["relevant"]))
    for name, field in PREVIEWED.items():
        state = F.when(fields[field]["state"] == "missing", "missing").otherwise("unavailable")
        add(f"field:{name}", fields[field]["state"].isin("missing", "incomplete"), F.array(evidence(field, "captured_data", field)), state, severity=F.when(state == "missing", "error").otherwise("warning"))
    rows = once(rows, findings=F.filter(F.array(*made), lambda x: x.isNotNull()))
    rows = once(rows, _keys=F.transform("findings", lambda x: F.xxhash64(x["definition_id"], x["code"], x["message"])))
    return once(rows, findings=F.filter("findings", lambda x, i: F.array_position("_keys", F.element_at("_keys", i + 1)) == i + 1)).drop("_keys", "header_robots")


def with_checks(rows: DataFrame) -> DataFrame:
    """with_findings() rows with `checks` (id, definition_version, label, outcome, detail): the snapshot that a later run is compared with.

    A finding without a check of its own sets the outcome of the check it is about, or becomes one.
    """
    fields, findings = F.col("fields"), F.col("findings")

    def check(cid: Column | str, label: Column | str, outcome: Column, detail: Column | str | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(cid).alias("id"), F.lit(VERSION).alias("definition_version"), lit(label).alias("label"), outcome.alias("outcome"), lit(detail).cast("string").alias("detail"))

    said = lambda code: F.try_element_at(F.filter(findings, lambda f: f["code"] == code), F.lit(1))["message"]
    ok = lambda bad, level: F.when(bad, level).otherwise("pass")
    checks = [check("completeness", "Preview complete", ok(~F.col("robots_ok"), "warn"), F.when(F.col("robots_ok"), "The collect finished.").otherwise("This preview only read part of the page. Incomplete sources are not treated as missing merchant fields."))]
    for name, field in PREVIEWED.items():
        state = fields[field]["state"]
        detail = F.when(state == "verified", "Captured sources agree within the compared scope; product truth is not independently verified.").when(state == "single_source", "Extracted from one source.").otherwise(F.replace(state, F.lit("_"), F.lit(" ")))
        checks.append(check(f"field:{name}", name.capitalize(), F.when(state == "missing", "fail").when(state.isin("conflicted", "incomplete"), "warn").otherwise("pass"), detail))

    def tile(t: Column) -> Column:
        sources = F.when(F.size(t["sources"]) > 0, F.concat(F.lit(" Sources: "), F.array_join(t["sources"], ", "), F.lit("."))).otherwise("")
        policy = F.when(t["key"] == "shipping", "Shipping details were not found in structured data. Visible text and policy pages are not verified.").when(t["key"] == "returns", "Return details were not found in structured data. Visible text and policy pages are not verified.")
        detail = (
            F.when(t["state"] == "present", F.concat(F.lit("Present in captured product data."), sources)).when(t["state"] == "conflicting", F.concat(F.lit("Captured sources disagree on "), t["field"], F.lit("."), sources))
            .when(t["state"] == "unavailable", F.concat(F.lit("Could not verify "), F.lower(t["label"]), F.lit(" because a product-page source was incomplete. This is not a missing catalog field.")))
            .when(~t["relevant"], F.concat(t["label"], F.lit(" wasn’t found in the captured product data. This preview does not treat it as required for this product."))).otherwise(F.coalesce(policy, F.concat(F.lit("Not found in captured product data (field: "), t["field"], F.lit(")."))))
        )
        return check(F.concat(F.lit("presence:"), t["key"]), t["label"], readiness.outcome(readiness.severity(t["state"], t["key"], t["relevant"])), detail)

    noindex, canonical, unread = said("PAGE_NOINDEX"), said("MISSING_CANONICAL"), said("ROBOTS_UNAVAILABLE")
    page = [
        check("indexable", "Indexable", ok(noindex.isNotNull(), "fail"), F.coalesce(noindex, F.lit("No page-level noindex directive was observed."))),
        check("canonical", "Canonical URL", ok(canonical.isNotNull(), "warn"), F.coalesce(canonical, F.lit("A canonical product URL was found."))),
        check("robots", "robots.txt", ok(unread.isNotNull(), "warn"), F.coalesce(unread, F.lit("robots.txt was reachable."))),
    ]

    def crawler(c: Column) -> Column:
        name = F.when(c["agent"] == "*", "General").otherwise(c["agent"])
        detail = F.concat(name, F.lit(": "), F.when(c["result"] == "unknown", "unknown because robots.txt was unavailable.").otherwise(c["result"]))
        return check(F.concat(F.lit("crawler:"), c["agent"]), readiness.lookup(CRAWLERS, c["agent"]), F.when(c["result"] == "allowed", "pass").when(c["result"] == "blocked", "fail").otherwise("warn"), detail)

    about = {"product_type_category": "field:category", "vendor_brand": "presence:brand", "barcode": "presence:gtin", "shipping_details": "presence:shipping", "merchant_return_policy": "presence:returns", **{f: f"field:{f}" for f in PREVIEWED if f != "category"}}
    conflict = lambda f: f["code"] == "FIELD_CONFLICT"
    subject = lambda f: F.element_at(F.split(f["definition_id"], ":"), -1)

    def left(f: Column) -> Column:
        target = F.when(conflict(f), F.coalesce(readiness.lookup(about, subject(f)), F.concat(F.lit("presence:"), subject(f)))).otherwise(f["definition_id"])
        label = F.when(conflict(f), F.concat(F.replace(subject(f), F.lit("_"), F.lit(" ")), F.lit(" agreement"))).otherwise(F.coalesce(readiness.lookup(CHECK_LABELS, f["code"]), f["code"]))
        return F.struct(target.alias("target"), check(f["definition_id"], label, readiness.outcome(f["severity"]), F.concat(f["message"], F.lit(" "), readiness.evidence_line(f["evidence"]))).alias("check"))

    rows = once(rows, checks=F.concat(F.array(*checks), F.transform("presence", tile), F.array(*page), F.transform("crawler_access", crawler)), _left=F.transform(F.filter(findings, lambda f: ~f["code"].isin(*OWN_CHECK)), left))
    rows = once(rows, _ids=F.transform("checks", lambda c: c["id"]))
    last = lambda c: F.try_element_at(F.filter("_left", lambda x: x["target"] == c["id"]), F.lit(-1))["check"]
    told = lambda c: c.withField("outcome", F.coalesce(last(c)["outcome"], c["outcome"])).withField("detail", F.coalesce(last(c)["detail"], c["detail"]))
    more = F.transform(F.filter("_left", lambda x: ~F.array_contains("_ids", x["target"])), lambda x: x["check"])
    return once(rows, checks=F.concat(F.transform("checks", told), more)).drop("_left", "_ids")


def previews(records: DataFrame, access: DataFrame | None, key: str, rules: DataFrame | None = None) -> DataFrame:
    """One nested row a capture: key, status, product_url, rule_catalog_version, fields, presence, crawler_access, findings, checks, counts, variants, price_context.

    records: record.records() rows with key, url, robots_status, and maybe x_robots (the header), robots_error, feed_error. The status is that of the crawler rules' read.
    access: None where the captures went through technical() before they were settled, so that the join takes narrow rows.
    """
    rows = records if access is None else technical(records, access, key)
    rows = with_checks(with_findings(with_presence(rows), rules))
    count = lambda items, cond: F.size(F.filter(items, cond)).cast("long")
    variants = F.coalesce("feed.variants", F.array().cast(rows.schema["feed"].dataType["variants"].dataType))
    counts = F.struct(*[count("findings", (lambda s: lambda f: f["severity"] == s)(s)).alias(s) for s in readiness.SEVERITIES])
    summary = F.struct(F.size(variants).cast("long").alias("total"), count(variants, lambda v: v["sku"].isNotNull()).alias("with_sku"), count(variants, lambda v: v["available"]).alias("available"), count(variants, lambda v: v["available"].isNull()).alias("unknown_availability"))
    shown = F.struct(*[F.struct(F.col(f"fields.{f}.state").alias("state"), F.col(f"fields.{f}.value").alias("value")).alias(n) for n, f in PREVIEWED.items()])
    return rows.select(
        key, F.when(F.col("robots_ok"), "complete").otherwise("partial").alias("status"), F.col("url").alias("product_url"), F.lit(VERSION).alias("rule_catalog_version"), shown.alias("fields"), "presence", "crawler_access", "findings", "checks",
        counts.alias("finding_counts"), summary.alias("variant_summary"), "price_context", F.lit(NOTE).alias("note"),
    )
