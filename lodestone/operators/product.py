"""Captured products: what the product feed and the page say of each field, source by source."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html, text as tx, urls, values
from ..functions.captures import IDENTIFIERS, parse_capture
from ..functions.rows import once

#: The feed's schema. Numbers may come as texts, so both are read as text.
_VARIANT = "struct<id:string,title:string,sku:string,barcode:string,price:string,compare_at_price:string,available:boolean,options:array<string>>"
FEED = f"id string, handle string, title string, vendor string, type string, description string, available boolean, price string, compare_at_price string, featured_image string, images array<string>, tags array<string>, variants array<{_VARIANT}>"

_FEED_VARIANT = "struct<id:string,title:string,sku:string,barcode:string,price_minor:bigint,compare_at_price_minor:bigint,available:boolean,options:array<string>>"
#: Fields whose second tier counts only where the first is empty.
PREFERRED = ("title", "description", "barcode", "image")
_LINKS = ("canonical_url", "image")


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _listed(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _feed_variants(raw: Column) -> Column:
    def variant(v: Column) -> Column:
        price, compare = values.minor_of_integer(v["price"]), values.minor_of_integer(v["compare_at_price"])
        return F.struct(v["id"].alias("id"), v["title"].alias("title"), _filled(v["sku"]).alias("sku"), _filled(v["barcode"]).alias("barcode"), price.alias("price_minor"), compare.alias("compare_at_price_minor"), v["available"].alias("available"), _listed(v["options"], "string").alias("options"))

    return F.transform(_listed(raw["variants"], _VARIANT), variant)


def _feed(raw: Column, variants: Column) -> Column:
    known = F.filter(F.transform(variants, lambda v: v["available"]), lambda a: a.isNotNull())
    least = lambda name: F.array_min(F.transform(variants, lambda v: v[name]))
    filled = lambda c: F.filter(F.transform(_listed(c, "string"), _filled), lambda x: x.isNotNull())
    out = F.struct(
        raw["id"].alias("id"), raw["handle"].alias("handle"), raw["title"].alias("title"), _filled(raw["vendor"]).alias("vendor"), _filled(raw["type"]).alias("type"), _filled(html.inline_text(raw["description"])).alias("description"),
        F.coalesce(raw["available"], F.when(F.size(known) > 0, F.exists(known, lambda a: a))).alias("available"), F.coalesce(values.minor_of_integer(raw["price"]), least("price_minor")).alias("price_minor"),
        F.coalesce(values.minor_of_integer(raw["compare_at_price"]), least("compare_at_price_minor")).alias("compare_at_price_minor"), _filled(raw["featured_image"]).alias("featured_image"),
        filled(raw["images"]).alias("images"), filled(raw["tags"]).alias("tags"), variants.alias("variants"),
    )
    return F.when(_filled(raw["id"]).isNotNull() & _filled(raw["handle"]).isNotNull() & _filled(raw["title"]).isNotNull(), out)


def with_feed(rows: DataFrame, body: str = "feed_body") -> DataFrame:
    """rows with `feed`, the feed body as a struct; null where it is no product (broken JSON, or no id, handle or title).

    Money is in minor units. A missing availability is that of the variants, missing prices are their smallest; blank texts are null.
    The body is parsed once a row: used in place, each member would be a parse of its own.
    """
    rows = once(rows, _raw=F.from_json(body, FEED))
    rows = once(rows, _variants=_feed_variants(F.col("_raw")))
    return once(rows, feed=_feed(F.col("_raw"), F.col("_variants"))).drop("_raw", "_variants")


#: What is read of a provider's answer; texts are no numbers here.
_USAGE = (
    "usage struct<prompt_tokens:bigint,input_tokens:bigint,completion_tokens:bigint,output_tokens:bigint,total_tokens:bigint,cost:double,"
    "completion_tokens_details:struct<reasoning_tokens:bigint>,server_tool_use:struct<web_search_requests:bigint>>"
)


def usage(u: Column) -> Column:
    """Token counts and cost of a provider's answer, read by _USAGE, in whichever spelling it has them. Counts that are no numbers are 0, such a cost is unknown."""
    number = lambda *values: F.coalesce(*[F.nullif(v, F.lit(0)) for v in values], F.lit(0))
    plain_in, plain_out = number(u["input_tokens"]), number(u["output_tokens"])
    total = F.coalesce(F.nullif(u["total_tokens"], F.lit(0)), plain_in + plain_out)
    cost = u["cost"]
    return F.struct(
        number(u["prompt_tokens"], u["input_tokens"]).alias("input_tokens"), number(u["completion_tokens"], u["output_tokens"]).alias("output_tokens"), number(u["completion_tokens_details"]["reasoning_tokens"]).alias("reasoning_tokens"),
        total.alias("total_tokens"), number(u["server_tool_use"]["web_search_requests"]).alias("web_search_requests"), F.when((cost >= 0) & (cost < float("inf")), cost).alias("cost"),
    )


def captured_usage(captures: DataFrame, key: str) -> DataFrame:
    """Usage by key of captures (key, status, body): a call that succeeded without a bill makes the cost unknown, a failed one costs nothing."""
    rows = once(captures.select(key, F.col("status").between(200, 299).alias("ok"), "body"), raw=F.from_json("body", _USAGE)["usage"])
    rows = rows.select(key, "ok", usage(F.col("raw")).alias("u"))
    sums = [F.coalesce(F.sum(f"u.{n}"), F.lit(0)).cast("long").alias(n) for n in ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "web_search_requests")]
    unbilled = F.count_if(F.col("ok") & F.col("u.cost").isNull())
    cost = F.when(unbilled == 0, F.coalesce(F.sum(F.when(F.col("ok"), F.col("u.cost"))), F.lit(0.0)))
    return rows.groupBy(key).agg(F.count("*").alias("model_calls"), *sums, cost.alias("cost_usd"))


def read_captures(captures: DataFrame) -> DataFrame:
    """captures (url, feed_body, page_html and other columns) with `feed` and `page`, each read once a row."""
    rows = with_feed(captures)
    return once(rows, page=parse_capture(F.col("page_html"), F.col("url"), F.concat(F.array("feed.featured_image"), F.coalesce("feed.images", F.array().cast("array<string>")))))


def variant_of(ref: Column, sku: Column, variants: Column) -> Column:
    """Place (from 0) of the variant that a node is about, or null: the one its address names, else the only one with its stock number.

    An address that names no variant decides too.
    """
    same = F.filter(F.transform(variants, lambda v, i: F.when(v["sku"] == sku, i)), lambda i: i.isNotNull())
    by_ref = F.array_position(F.transform(variants, lambda v: v["id"]), ref)
    return F.when(ref.isNotNull(), F.when(by_ref > 0, (by_ref - 1).cast("int"))).when(F.size(same) == 1, F.try_element_at(same, F.lit(1)))


def _seen(source: str, path: Column | str, value: Column, kind: str | Column = "s", tier: int | Column = 1, key: Column | None = None, variant: Column | None = None) -> Column:
    """An observation: its value as text (blanks are null), the JSON kind of it, what it compares by where that isn't the value, and the variant it is about."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(tier).alias("tier"), F.lit(source).alias("source"), lit(path).alias("path"), _filled(value.cast("string")).alias("value"), lit(kind).alias("kind"),
        (F.lit(None).cast("string") if key is None else key).alias("vkey"), (F.lit(None).cast("int") if variant is None else variant).alias("variant"),
    )


def _at(kind: str, i: Column) -> Column:
    return F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("]"))


def _fields(feed: Column, page: Column, url: Column) -> dict[str, Callable[[], list[Column]]]:
    """Field -> what makes its arrays of observations, in the order in which they count. Nodes have `variant`."""
    nodes = page["products"]
    meta = lambda name: F.try_element_at(page["og"], F.lit(name))
    mine = lambda path, value, kind="s", tier=1: F.array(_seen("shopify_ajax", path, value, kind, tier))
    head = lambda path, value, kind="s", tier=1: F.array(_seen("html_meta", path, value, kind, tier))
    link = lambda source, path, x, tier=1: _seen(source, path, x["value"], "s", tier, x["key"])

    def product(name: str) -> Column:
        return F.transform(nodes, lambda n, i: _seen("json_ld", F.concat(_at("products", i), F.lit(f".{name}")), n["values"][name]["value"], n["values"][name]["kind"], variant=n["variant"]))

    def offer(name: str, value: Callable[[Column], tuple[Column, Column | str]] | None = None) -> Column:
        value = value or (lambda o: (o["values"][name]["value"], o["values"][name]["kind"]))
        made = lambda n, i: F.transform(n["offers"], lambda o, j: _seen("json_ld", F.concat(_at("products", i), _at(".offers", j), F.lit(f".{name}")), *value(o), variant=F.coalesce(o["variant"], n["variant"])))
        return F.flatten(F.transform(nodes, made))

    variants, images = feed["variants"], page["feed_images"]
    first = F.try_element_at(variants, F.lit(1))
    rest = lambda: F.transform(variants, lambda v, i: _seen("shopify_ajax", F.concat(_at("variants", i), F.lit(".barcode")), F.when(i > 0, v["barcode"]), tier=2))
    main_path = F.when(feed["featured_image"].isNotNull(), "featured_image").otherwise("images[0]")
    main_image = F.try_element_at(images, F.when(feed["featured_image"].isNotNull(), 1).otherwise(2))
    more_images = lambda: F.transform(F.slice(images, 2, F.greatest(F.size(images) - 1, F.lit(0))), lambda x, i: link("shopify_ajax", _at("images", i), x, 2))
    node_images = lambda: F.flatten(F.transform(nodes, lambda n, i: F.transform(n["images"], lambda x, j: link("json_ld", F.concat(_at("products", i), F.lit(".image"), F.when(j > 0, _at("", j)).otherwise("")), x, F.when(j == 0, 1).otherwise(2)))))
    crumbs = lambda: F.flatten(F.transform(page["breadcrumbs"], lambda b, i: F.transform(b, lambda name, j: _seen("json_ld", F.concat(_at("breadcrumbs", i), _at(".itemListElement", j), F.lit(".name")), name))))
    tags = lambda: F.transform(feed["tags"], lambda t, i: _seen("shopify_ajax", _at("tags", i), t))
    stock = lambda o: (values.stock(o["values"]["availability"]["value"], o["values"]["availability"]["kind"]), "b")
    price = lambda o: (values.minor_of_decimal(o["values"]["price"]["value"]), "n")
    return {
        "product_id": lambda: [mine("id", feed["id"]), product("productID")],
        "handle": lambda: [mine("handle", feed["handle"]), head("url.handle", urls.handle(url))],
        "canonical_url": lambda: [F.array(link("html_meta", "link[rel=canonical]", page["canonical"])), F.transform(nodes, lambda n, i: link("json_ld", F.concat(_at("products", i), F.lit(".url")), n["link"]))],
        "title": lambda: [mine("title", feed["title"]), product("name"), F.array(_seen("visible_html", "h1", page["h1"])), head("og:title", meta("og:title"), tier=2)],
        "description": lambda: [mine("description", feed["description"]), product("description"), head("meta.description", page["description"], tier=2), head("og:description", meta("og:description"), tier=2)],
        "vendor_brand": lambda: [mine("vendor", feed["vendor"]), product("brand")],
        "product_type_category": lambda: [mine("type", feed["type"]), product("category")],
        "currency": lambda: [head("product:price:currency", meta("product:price:currency")), offer("priceCurrency")],
        "price": lambda: [mine("price", feed["price_minor"], "n"), head("product:price:amount", values.minor_of_decimal(meta("product:price:amount")), "n"), offer("price", price)],
        "availability": lambda: [mine("available", feed["available"], "b"), head("product:availability", values.availability(meta("product:availability")), "b"), offer("availability", stock)],
        "sku": lambda: [mine("variants[0].sku", first["sku"]), product("sku"), offer("sku")],
        "barcode": lambda: [mine("variants[0].barcode", first["barcode"]), *[product(n) for n in IDENTIFIERS], rest()],
        "image": lambda: [F.array(link("shopify_ajax", main_path, main_image)), F.array(link("html_meta", "og:image", page["og_image"])), node_images(), more_images()],
        "shipping_details": lambda: [product("shippingDetails"), offer("shippingDetails")],
        "merchant_return_policy": lambda: [product("hasMerchantReturnPolicy"), offer("hasMerchantReturnPolicy")],
        "warranty": lambda: [product(n) for n in ("warranty", "hasWarrantyPromise")] + [offer(n) for n in ("warranty", "hasWarrantyPromise")],
        "taxonomy_hints": lambda: [crumbs(), tags()],
    }


#: Fields in the order in which they are reported.
FIELDS = (
    "product_id", "handle", "canonical_url", "title", "description", "vendor_brand", "product_type_category", "currency", "price", "availability", "sku", "barcode", "image", "shipping_details", "merchant_return_policy", "warranty", "taxonomy_hints",
)


def observed(read: DataFrame, fields: Iterable[str] = FIELDS) -> DataFrame:
    """read_captures() rows with `seen`, a struct of each wanted field's observations (ord, tier, source, path, value, kind, vkey, variant), without nulls.

    ord counts the places of a field's sources, empty ones too; vkey is what values compare by.
    """
    # a node's variant is looked up once
    page, variants = F.col("page"), F.col("feed.variants")
    own = lambda x: x.withField("variant", variant_of(x["ref"], x["sku"], variants))
    rows = once(read, page=page.withField("products", F.transform(page["products"], lambda n: own(n).withField("offers", F.transform(n["offers"], own)))))
    made, none = _fields(F.col("feed"), F.col("page"), F.col("url")), F.array().cast("array<struct<tier:int,source:string,path:string,value:string,kind:string,vkey:string,variant:int>>")

    def seen(field: str) -> Column:
        def full(o: Column, i: Column) -> Column:
            by_text = tx.category_key(o["value"]) if field == "product_type_category" else tx.comparison_key(o["value"])
            return F.struct(i.alias("ord"), *[o[n].alias(n) for n in ("tier", "source", "path", "value", "kind")], (o["vkey"] if field in _LINKS else by_text).alias("vkey"), o["variant"].alias("variant"))

        placed = F.transform(F.concat(*[F.coalesce(a, none) for a in made[field]()]), lambda o, i: F.struct(i.alias("i"), o.alias("o")))
        return F.transform(F.filter(placed, lambda x: x["o"]["value"].isNotNull()), lambda x: full(x["o"], x["i"])).alias(field)

    return once(rows, seen=F.struct(*[seen(f) for f in fields]))


def observations(captures: DataFrame, key: str, fields: Iterable[str] = FIELDS) -> DataFrame:
    """(key, field, ord, tier, source, path, value, vkey) of captures (key, url, feed_body, page_html): one row for each value that a source gives.

    ord follows the order in which a field's sources count; vkey is what values compare by. Links are resolved against the page. A row
    makes its own observations, so nothing is shuffled; nulls, blanks and broken JSON give none. Only the wanted fields are built.
    """
    fields = tuple(fields)
    rows = observed(read_captures(captures.select(key, "url", "feed_body", "page_html")), fields)
    named = lambda f: lambda o: F.struct(F.lit(f).alias("field"), o.alias("o"))
    each = F.flatten(F.array(*[F.transform(F.col(f"seen.{f}"), named(f)) for f in fields]))
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.field", *[f"x.o.{n}" for n in ("ord", "tier", "source", "path", "value", "vkey")])


def taxonomy_hints(rows: DataFrame, key: str) -> DataFrame:
    """(key, state, value) of the taxonomy observations: breadcrumb trails and tags, labelled and in order."""
    own = rows.where("field = 'taxonomy_hints'").withColumn("list", F.regexp_extract("path", r"^breadcrumbs\[([0-9]+)\]", 1))
    trail = own.groupBy(key, "list").agg(F.count_distinct("source").alias("s"), F.first("source").alias("source"), F.min("ord").alias("at"), F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    label = F.when(F.col("list") != "", F.concat(F.lit("breadcrumb: "), F.array_join("v.value", " > "))).otherwise(F.array_join(F.transform("v.value", lambda t: F.concat(F.lit("ajax_tag: "), t)), "; "))
    out = trail.withColumn("label", label).groupBy(key).agg(F.count_distinct("source").alias("n"), F.array_sort(F.collect_list(F.struct("at", "label"))).alias("l"))
    return out.select(key, F.when(F.col("n") >= 2, "verified").otherwise("single_source").alias("state"), F.array_join("l.label", "; ").alias("value"))
