"""Captures settled row by row: JSON-LD at any depth, compacted policies, preferred fields, and bodies that can't be read."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import captures
from lodestone.operators import preview, product, record
from lodestone.plans import previews
from .conftest import SF

URL = "https://shop.example/en/products/pendant"
FEED = {"id": 7, "handle": "pendant", "title": "Pendant", "vendor": " ", "type": "Necklaces", "images": ["//cdn.shopify.com/s/files/1/02/a.jpg?v=1&width=9"], "variants": [{"id": 1, "sku": "A", "barcode": "1", "price": 1999, "available": True}, {"id": 2, "sku": "B", "barcode": "2", "price": "2199", "available": False}]}


def page(*nodes, head="", body="<h1>Pendant</h1>"):
    blocks = "".join(f'<script type="application/ld+json">{n if isinstance(n, str) else json.dumps(n)}</script>' for n in nodes)
    return f"<html><head>{head}{blocks}</head><body>{body}</body></html>"


def node(**more):
    return {"@type": ["Thing", "product"], "name": "Pendant", "sku": "A", **more}


ROWS = [
    # the feed's title is backed by a second source, so a third one that differs doesn't matter; policies differ only in what compaction drops
    (1, URL, json.dumps(FEED), page({"@graph": [[{"a": {"b": node(name="Other", offers={"price": 19.99, "priceCurrency": "EUR", "shippingDetails": {"a": 1}}, shippingDetails={"@context": "x", "a": 1, "b": None, "c": [" ", {}]})}}]]})),
    (2, URL, json.dumps(FEED), page(node(offers=[{"price": "19.99"}, "text", {"price": "", "sku": "B"}]), "{broken", "  ", '{"@type":"Product","x":NaN}')),
    (3, URL, None, None),
    (4, None, "[]", ""),
    (5, URL + "?variant=2", json.dumps(FEED), page(node(sku="B", offers={"offers": [{"availability": "SoldOut", "price": 21.99}]}))),
    (None, URL, json.dumps(FEED | {"title": ""}), page(node(category="Rings", image=[{"contentUrl": "/b.jpg"}, ["/b.jpg", {"url": " "}]]))),
]


@pytest.fixture(scope="module")
def settled(spark):
    df = spark.createDataFrame(ROWS, "k long, url string, feed_body string, page_html string").selectExpr("*", "'x' AS first", "k AS fields")
    out = record.records(df).select("k", "collection_status", "price_context", "fields", F.size("page.products").alias("n"), "page.errors").collect()
    assert len(out) == len(ROWS)
    return {r["k"]: r for r in out}


def test_settled_fields(settled):
    state = lambda k, f: (settled[k]["fields"][f]["state"], settled[k]["fields"][f]["value"])
    assert state(1, "title") == ("verified", "Pendant") and state(1, "vendor_brand") == ("missing", None)
    assert state(1, "shipping_details") == ("single_source", '{"a":1}') and [o["path"] for o in settled[1]["fields"]["shipping_details"]["observations"]] == ["products[0].shippingDetails", "products[0].offers[0].shippingDetails"]
    assert state(1, "price") == ("single_source", "1999") and state(1, "currency") == ("single_source", "EUR") and state(1, "sku") == ("verified", "A")
    # blank prices count as zero, the offer about the other variant too; no currency is known, so nothing is compared
    assert state(2, "price") == ("single_source", "1999") and [o["value"] for o in settled[2]["fields"]["price"]["observations"]] == ["1999", "1999", "0"] and settled[2]["errors"] == 2
    assert state(5, "sku") == ("verified", "B") and state(5, "availability") == ("verified", "false") and state(5, "price") == ("single_source", "2199")
    assert settled[5]["price_context"].asDict() == {"scope": "variant", "variant_id": "2", "variant_title": None, "minimum_minor": 1999, "maximum_minor": 2199, "currency": None}


def test_bodies_that_cannot_be_read(settled):
    for k in (3, 4):
        assert settled[k]["collection_status"] == "partial" and settled[k]["n"] == 0
        states = {f: settled[k]["fields"][f]["state"] for f in product.FIELDS}
        assert {f for f, s in states.items() if s == "incomplete"} == set(record.FROM_FEED) - ({"handle"} if k == 3 else set())
    assert settled[3]["fields"]["handle"]["state"] == "single_source"
    # a feed without a title is none, the page's own values stand
    r = settled[None]["fields"]
    assert (r["title"]["value"], r["product_type_category"]["value"], r["image"]["value"]) == ("Pendant", "Rings", "https://shop.example/b.jpg") and settled[None]["collection_status"] == "partial"


def test_read_capture():
    one = captures.read_capture(page(node(price=1), {"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "b"}, {"position": "1", "item": {"name": " a "}}, {"name": " "}, 5]}), URL, [None, "//CDN.shopify.com/s/files/1/02/x/a.jpg?width=1&b=2&a=1"])
    assert one["breadcrumbs"] == [["a", "b"]] and one["feed_images"][0] is None and one["feed_images"][1]["key"] == "file:x/a.jpg?a=1&b=2"
    assert captures.image_keys(URL, [])("https://shop.example/cdn/shop/a.jpg?crop=c") == "file:a.jpg?"
    assert captures.canonical_key("https://a.b/c?variant=1&d=2#e") == "https://a.b/c?d=2"
    assert [captures.scalar(x) for x in (" ", None, [], True, 20.0, 1e-7, "a")] == [None, None, None, {"value": "true", "kind": "b"}, {"value": "20", "kind": "n"}, {"value": "1e-7", "kind": "n"}, {"value": "a", "kind": "s"}]


def test_catalogue(spark):
    rules = preview.catalogue(spark)
    assert rules.count() == rules.select("rule").distinct().count() == len(preview.RULES)
    with pytest.raises(ValueError):
        preview.with_findings(spark.range(1), spark.range(preview.MOST_RULES + 1).selectExpr("cast(id AS string) AS rule"))


def test_usage_types(spark):
    """Texts are no numbers: counts of them are 0, and such a cost leaves the sum unknown."""
    bodies = ['{"usage":{"prompt_tokens":5,"cost":0.5}}', '{"usage":{"prompt_tokens":"7","output_tokens":2,"cost":0.25}}', '{"usage":{"input_tokens":3,"total_tokens":9,"completion_tokens_details":{"reasoning_tokens":4},"cost":0.125}}']
    one = lambda rows: product.captured_usage(spark.createDataFrame(rows, "k long, status int, body string"), "k").first().asDict()
    got = one([(1, 200, b) for b in bodies] + [(1, 500, "{")])
    assert got == {"k": 1, "model_calls": 4, "input_tokens": 8, "output_tokens": 2, "reasoning_tokens": 4, "total_tokens": 11, "web_search_requests": 0, "cost_usd": 0.875}
    assert one([(1, 200, bodies[0]), (1, 200, '{"usage":{"cost":"0.5"}}')])["cost_usd"] is None


def test_crawler_rules_meet_captures_before_they_are_settled(spark, monkeypatch):
    """The join by page takes narrow rows: a settled capture is many times wider than its page's crawler access."""
    given = []
    monkeypatch.setattr(previews.record, "records", lambda captures: given.append(captures) or captures)
    monkeypatch.setattr(previews.preview, "previews", lambda rows, access, key: rows)
    rows = previews._preview_rows(spark, SF)
    assert {"robots_ok", "robots_reason", "crawler_access"} <= set(given[0].columns) and rows is given[0]
    assert rows.count() == spark.read.parquet(f"{SF}/part.parquet").count()
