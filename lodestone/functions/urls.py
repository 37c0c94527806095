"""URL expressions. Hosts compare in lower case; text that is no URL gives null."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(c: Column, n: int) -> Column:
    """1 scheme, 2 user info, 3 host, 4 port, 5 path, 6 query, 7 fragment; an absent part is empty."""
    return F.regexp_extract(c, _PARTS, n)


def host(c: Column) -> Column:
    return F.when(part(c, 3) != "", F.lower(part(c, 3)))


def site(c: Column) -> Column:
    """Host without www."""
    return F.regexp_replace(host(c), r"^www\.", "")


def _query(c: Column, drop: str) -> Column:
    kept = F.filter(F.split(part(c, 6), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).rlike(drop))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def _base(c: Column) -> Column:
    return F.concat(F.lower(part(c, 1)), F.lit("://"), host(c))


def canonical_key(c: Column) -> Column:
    """A page without its variant choice and fragment."""
    return F.concat(_base(c), F.when(part(c, 5) == "", "/").otherwise(part(c, 5)), _query(c, "^variant$"))


def provider_key(c: Column) -> Column:
    """A cited page without campaign parameters, fragment and slash at the end."""
    return F.concat(_base(c), F.regexp_replace(part(c, 5), "/$", ""), _query(c, "^(utm_.*|ref|source)$"))


def classifier_key(c: Column) -> Column:
    """A cited page without fragment and slash at the end."""
    return F.regexp_replace(F.concat(_base(c), part(c, 5), F.when(part(c, 6) != "", F.concat(F.lit("?"), part(c, 6))).otherwise("")), "/$", "")


def image_key(c: Column, prefix: Column | None = None) -> Column:
    """An image on a shop's network: without size and format parameters, the rest in order, the shop's own prefix first."""
    kept = F.array_sort(F.filter(F.split(part(c, 6), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin("width", "height", "crop", "format")))
    name = F.concat(part(c, 5), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.concat(F.coalesce(prefix, host(c)) if prefix is not None else host(c), name)


def handle(c: Column) -> Column:
    """The path segment after the last `products`; null without one."""
    found = F.regexp_extract(part(c, 5), r"^.*/products/([^/]+)", 1)
    return F.when(found != "", found)


def product_json_url(c: Column) -> Column:
    return F.concat(_base(c), F.regexp_replace(part(c, 5), "/$", ""), F.lit(".js"))


#: Hosts and host endings that must never be fetched.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "metadata.google", "instance-data")
BLOCKED_SUFFIXES = (".local", ".internal", ".localhost")


def issue(c: Column) -> Column:
    """Why a product page's URL is refused, the first reason that holds; null where it is fine."""
    h, path = F.regexp_replace(host(c), r"\.$", ""), F.filter(F.split(part(c, 5), "/"), lambda s: s != "")
    byte = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    blocked = h.isin(*BLOCKED_HOSTS) | h.rlike(rf"^{byte}(\.{byte}){{3}}$") | h.startswith("[") | (h == "")
    for s in BLOCKED_SUFFIXES:
        blocked |= h.endswith(s)
    return (
        F.when(c.isNull() | ~c.rlike(_PARTS) | h.isNull(), "INVALID_URL")
        .when(F.lower(part(c, 1)) != "https", "HTTPS_REQUIRED")
        .when(part(c, 2) != "", "CREDENTIALS_NOT_ALLOWED")
        .when(blocked, "PRIVATE_TARGET")
        .when((F.size(path) < 2) | (F.try_element_at(path, F.lit(-2)) != "products"), "UNSUPPORTED_PRODUCT_PATH")
    )


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link resolved against its page; null where that gives no web address."""

    def join(b: str | None, u: str | None) -> str | None:
        try:
            out = urljoin(b or "", (u or "").strip())
            return out if urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
        except ValueError:
            return None

    return pd.Series([join(b, u) for b, u in zip(base, link, strict=True)], dtype="object")
