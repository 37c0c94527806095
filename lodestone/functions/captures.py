"""Captured product pages as typed columns: markup, JSON-LD products with their offers, and links with what they compare by.

One Arrow UDF reads a page's markup and JSON-LD once; what follows are expressions over its columns.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import parse_qs, parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import html as markup

_S = T.StringType()
#: A scalar: its text, and s, n or b for a text, number or boolean.
VALUES = T.MapType(_S, T.StructType().add("value", _S).add("kind", _S))
LINK = T.StructType().add("value", _S).add("key", _S)
#: `ref` is the variant that the node's address on the page itself names.
OFFER = T.StructType().add("values", VALUES).add("ref", _S).add("sku", _S)
NODE = T.StructType().add("values", VALUES).add("ref", _S).add("sku", _S).add("link", LINK).add("images", T.ArrayType(LINK)).add("offers", T.ArrayType(OFFER))
CAPTURE = (
    T.StructType().add("canonical", LINK).add("title", _S).add("description", _S).add("h1", _S).add("og", T.MapType(_S, _S)).add("og_image", LINK).add("currency", _S)
    .add("robots", T.ArrayType(_S)).add("errors", "integer").add("password", "boolean").add("challenge", "boolean").add("products", T.ArrayType(NODE)).add("breadcrumbs", T.ArrayType(T.ArrayType(_S))).add("feed_images", T.ArrayType(LINK))
)

#: Members of a product and an offer that are read as scalars, and those that are read as compacted JSON.
IDENTIFIERS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "isbn", "mpn")
PRODUCT_SCALARS = ("productID", "name", "description", "category", "sku", *IDENTIFIERS)
OFFER_SCALARS = ("priceCurrency", "availability", "sku")
POLICIES = ("shippingDetails", "hasMerchantReturnPolicy", "warranty", "hasWarrantyPromise")
#: Query parameters that choose an image's size, and the network that serves the shops' files.
IMAGE_SIZES = ("width", "height", "crop", "format")
FILES_HOST, FILES_PATH, LOCAL_PATH = "cdn.shopify.com", "/s/files/", "/cdn/shop/"


def _number(x: float) -> str:
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    return text.replace("e-0", "e-").replace("e+0", "e+")


def scalar(x) -> dict | None:
    """A text, number or boolean; blanks, lists and objects are None."""
    if isinstance(x, bool):
        return {"value": "true" if x else "false", "kind": "b"}
    if isinstance(x, int | float):
        return {"value": _number(x), "kind": "n"}
    text = x.strip().strip("﻿").strip() if isinstance(x, str) else ""
    return {"value": text, "kind": "s"} if text else None


def absolute(link: str | None, page: str) -> str | None:
    """A link resolved against its page, with host in lower case and no default port; None where that gives no web address."""
    if not isinstance(link, str) or not link.strip():
        return None
    try:
        u = urlsplit(urljoin(page, link.strip()))
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return None
    return urlunsplit((u.scheme, u.hostname + port, u.path or "/", u.query, u.fragment))


def canonical_key(url: str) -> str:
    """A page without its choice of variant and fragment."""
    u = urlsplit(url)
    return urlunsplit((u.scheme, u.netloc, u.path, urlencode([p for p in parse_qsl(u.query, keep_blank_values=True) if p[0] != "variant"]), ""))


def image_keys(page: str, feed_images: list[str]) -> Callable[[str], str]:
    """A function from an image's address to what it compares by: a shop's own file is one under each address that serves it, at any size."""
    prefixes = []
    for url in feed_images:
        u = urlsplit(url)
        if u.netloc == FILES_HOST and u.path.startswith(FILES_PATH):
            parts = u.path[len(FILES_PATH) :].split("/")
            n = next((i for i, x in enumerate(parts) if not x.isdigit()), len(parts))
            if n:
                prefixes.append(FILES_PATH + "".join(x + "/" for x in parts[:n]))
    own = urlsplit(page).netloc

    def key(url: str) -> str:
        u = urlsplit(url)
        found = next((p for p in prefixes if u.netloc == FILES_HOST and u.path.startswith(p)), LOCAL_PATH if u.netloc == own and u.path.startswith(LOCAL_PATH) else None)
        if found is None:
            return url
        kept = sorted((p for p in parse_qsl(u.query, keep_blank_values=True) if p[0] not in IMAGE_SIZES), key=lambda p: p[0])
        return f"file:{u.path[len(found) :]}?{urlencode(kept)}"

    return key


def _variant(node: dict, page: str) -> str | None:
    own = urlsplit(page)
    for link in (node.get("url"), node.get("@id")):
        url = absolute(link, page)
        if url:
            u = urlsplit(url)
            if (u.scheme, u.netloc, u.path) == (own.scheme, own.netloc, own.path or "/") and (found := parse_qs(u.query).get("variant")):
                return found[0]
    return None


def _sku(node: dict) -> str | None:
    return node["sku"] if isinstance(node.get("sku"), str) else None


def image_links(value) -> list[str]:
    """Distinct addresses of a node's image, in order: a text, an object with url or contentUrl, or lists of these to any depth."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += v[::-1]
            continue
        if isinstance(v, dict):
            v = v.get("contentUrl") if v.get("url") is None else v["url"]
        if isinstance(v, str) and v.strip():
            out.append(v.strip())
    return list(dict.fromkeys(out))


def offers(node: dict) -> list[dict]:
    found = node.get("offers")
    if isinstance(found, dict):
        found = found["offers"] if isinstance(found.get("offers"), list) else [found]
    return [o for o in found if isinstance(o, dict)] if isinstance(found, list) else []


def breadcrumb_names(node: dict) -> list[str]:
    """Names of a breadcrumb list by position, ties and missing positions (0) in list order."""
    items = node.get("itemListElement")
    items = [x for x in (items if isinstance(items, list) else [items]) if isinstance(x, dict)]

    def place(x: dict) -> float:
        try:
            return float(x.get("position") or 0)
        except (TypeError, ValueError):
            return 0.0

    def name(x: dict) -> str | None:
        inner = x["item"].get("name") if isinstance(x.get("item"), dict) else None
        return next((n.strip() for n in (x.get("name"), inner) if isinstance(n, str) and n.strip()), None)

    return [n for x in sorted(items, key=place) if (n := name(x))]


def _values(node: dict, scalars: tuple[str, ...]) -> dict:
    out = {n: scalar(node.get(n)) for n in scalars} | {n: scalar(markup.compact_text(node.get(n))) for n in POLICIES}
    return {n: v for n, v in out.items() if v}


def _offer(o: dict, page: str) -> dict:
    price = o.get("lowPrice") if o.get("price") is None else o["price"]
    values = _values(o, OFFER_SCALARS)
    if isinstance(price, str):  # blanks too: they count as zero
        values["price"] = {"value": price, "kind": "s"}
    elif isinstance(price, int | float) and not isinstance(price, bool):
        values["price"] = scalar(price)
    return {"values": values, "ref": _variant(o, page), "sku": _sku(o)}


def read_capture(html: str | None, page: str | None, feed_images: list[str | None] | None) -> dict:
    page = page or ""
    out, blocks = markup.read_markup(html)
    resolved = [absolute(x, page) for x in feed_images or []]
    keys = image_keys(page, [x for x in resolved if x])
    image = lambda x: {"value": x, "key": keys(x)} if x else None
    link = lambda x: {"value": x, "key": canonical_key(x)} if x else None

    def node(n: dict) -> dict:
        values = _values(n, PRODUCT_SCALARS)
        brand = scalar(n["brand"].get("name") if isinstance(n.get("brand"), dict) else n.get("brand"))
        values |= {"brand": brand} if brand else {}
        return {
            "values": values, "ref": _variant(n, page), "sku": _sku(n), "link": link(absolute(n.get("url"), page)), "offers": [_offer(o, page) for o in offers(n)],
            "images": [image(absolute(x, page)) for x in image_links(n.get("image"))],
        }

    read = lambda v: [("p" if markup.is_type(n, "Product") else "", markup.is_type(n, "BreadcrumbList"), n) for n in markup.json_ld_nodes(v)]
    found, errors = markup.parse_blocks(blocks, lambda v: [(node(n) if product else None, breadcrumb_names(n) if crumbs else None) for product, crumbs, n in read(v)])
    return {
        "canonical": link(absolute(out["canonical"], page)), "title": out["title"], "description": out["description"], "h1": out["h1"], "og": out["og"], "og_image": image(absolute(out["og"].get("og:image"), page)), "currency": out["currency"],
        "robots": list(dict.fromkeys(d for d in (x.strip().lower() for x in (out["robots"] or "").split(",")) if d)), "errors": errors, "password": out["has_password_form"], "challenge": out["is_challenge"],
        "products": [p for each in found for p, _ in each if p is not None], "breadcrumbs": [b for each in found for _, b in each if b is not None], "feed_images": [image(x) for x in resolved],
    }


_ARROW = to_arrow_type(CAPTURE)
#: Pages that are Python objects at once.
SLICE = 256


@F.arrow_udf(CAPTURE)
def _read(html: pa.Array, page: pa.Array, feed_images: pa.Array) -> pa.Array:
    maps = lambda v: {k: list(x.items()) if k in ("values", "og") else maps(x) for k, x in v.items()} if isinstance(v, dict) else [maps(x) for x in v] if isinstance(v, list) else v
    made = []
    for at in range(0, len(html), SLICE):  # a page as Python objects takes many times its bytes
        each = zip(*(c.slice(at, SLICE).to_pylist() for c in (html, page, feed_images)), strict=True)
        made.append(pa.array([maps(read_capture(*x)) for x in each], _ARROW))
    return pa.concat_arrays(made) if made else pa.array([], _ARROW)


def parse_capture(html: Column, page: Column, feed_images: Column) -> Column:
    """A page as a struct, see CAPTURE; feed_images come back resolved, in place. Take it once a row: Spark does not prune a UDF's fields."""
    return _read(html, page, feed_images)
