"""A captured product settled: each field's state, value and evidence, decided within the row that captured it.

Votes are counts of distinct hashes, so a page with many variants costs no more than its observations, and
nothing is shuffled: no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx, values
from ..functions.rows import once
from . import product

_OBS = "struct<ord:int,tier:int,source:string,path:string,value:string,kind:string,vkey:string,variant:int>"
#: Fields that the variants of the feed settle, with the variant's member.
BY_VARIANT = {"sku": "sku", "barcode": "barcode", "availability": "available"}
#: Fields that are incomplete rather than missing without a feed.
FROM_FEED = ("product_id", "handle", "title", "description", "vendor_brand", "product_type_category", "price", "availability", "sku", "barcode")


def _empty() -> Column:
    return F.array().cast(f"array<{_OBS}>")


def _distinct(items: Column, key) -> Column:
    return F.size(F.array_distinct(F.transform(items, key)))


def _count_keys(obs: Column) -> Column:
    return _distinct(obs, lambda o: F.xxhash64(o["vkey"]))


def _settled(state: Column, value: Column, kind: Column, obs: Column) -> Column:
    shown = state.isin("verified", "single_source")
    return F.struct(state.alias("state"), F.when(shown, value).alias("value"), F.when(shown, kind).alias("kind"), obs.alias("observations"))


def _state(keys: Column, sources: Column, incomplete: Column) -> Column:
    return F.when(keys == 0, F.when(incomplete, "incomplete").otherwise("missing")).when(keys > 1, "conflicted").when(sources >= 2, "verified").otherwise("single_source")


def vote(obs: Column, incomplete: Column | None = None, shown: Column | None = None) -> Column:
    """The state, value, kind and observations of a field: one value of two sources is verified, two values conflict. `shown`: all its evidence."""
    first = F.try_element_at(obs, F.lit(1))
    state = _state(_count_keys(obs), _distinct(obs, lambda o: F.xxhash64(o["source"])), F.lit(False) if incomplete is None else incomplete)
    return _settled(state, first["value"], first["kind"], obs if shown is None else shown)


def _preferred(obs: Column, first: Column, rest: Column, own: Column, support: Column, incomplete: Column) -> Column:
    """A field of two tiers. own: the feed's first observation; support: how many sources have its value."""
    plain = vote(F.when(F.size(first) > 0, first).otherwise(rest), incomplete, obs)
    saved = (_count_keys(first) > 1) & (support >= 2)
    return F.when(saved, _settled(F.lit("verified"), own["value"], own["kind"], obs)).otherwise(plain)


def _seed(v: Column, variants: Column, member: str, kind: str) -> Column:
    value = F.try_element_at(variants, v + 1)[member].cast("string")
    path = F.concat(F.lit("variants["), v.cast("string"), F.lit(f"].{member}"))
    return F.struct(F.lit(-1).alias("ord"), F.lit(1).alias("tier"), F.lit("shopify_ajax").alias("source"), path.alias("path"), value.alias("value"), F.lit(kind).alias("kind"), tx.comparison_key(value).alias("vkey"), v.cast("int").alias("variant"))


def _money(source: str, path: Column | str, amount: Column, variant: Column | None = None, kind: str = "n") -> Column:
    """A list of one observation, or of none where there is no amount."""
    text = amount.cast("string")
    one = F.struct(F.lit(0).alias("ord"), F.lit(1).alias("tier"), F.lit(source).alias("source"), (F.lit(path) if isinstance(path, str) else path).alias("path"), text.alias("value"), F.lit(kind).alias("kind"), F.lower(text).alias("vkey"), (F.lit(None) if variant is None else variant).cast("int").alias("variant"))
    return F.when(amount.isNotNull(), F.array(one)).otherwise(_empty())


def _variant_fields(rows: DataFrame) -> DataFrame:
    """Adds `v_<field>`, what the variants make of sku, barcode and availability: matched evidence votes variant by variant, each with the feed's own value."""
    variants, chosen, pick = F.col("feed.variants"), F.col("chosen"), F.col("pick")
    kind = lambda f: "b" if f == "availability" else "s"
    pair = lambda o: F.shiftleft(o["variant"].cast("long"), 40).bitwiseOR(F.xxhash64(o["vkey"]).bitwiseAND((1 << 40) - 1))
    for_each = lambda make: {f"{name}_{f}": c for f in BY_VARIANT for name, c in make(f).items()}
    rows = once(rows, **for_each(lambda f: {"un": F.filter(F.col(f"seen.{f}"), lambda o: o["variant"].isNull()), "ma": F.filter(F.col(f"seen.{f}"), lambda o: o["variant"].isNotNull())}))
    rows = once(rows, **for_each(lambda f: {"g": F.array_distinct(F.transform(f"ma_{f}", lambda o: o["variant"]))}))
    seeds = lambda f: F.filter(F.transform(f"g_{f}", lambda v: _seed(v, variants, BY_VARIANT[f], kind(f))), lambda o: o["value"].isNotNull())
    rows = once(rows, **for_each(lambda f: {"seed": seeds(f)}))
    rows = once(rows, **for_each(lambda f: {"all": F.concat(f"seed_{f}", f"ma_{f}")}))
    rows = once(rows, **for_each(lambda f: {"p": F.array_sort(F.array_distinct(F.transform(f"all_{f}", pair)))}))
    # a variant with two values has two neighbouring entries
    rows = once(rows, **for_each(lambda f: {"c": F.array_distinct(F.filter(F.transform(f"p_{f}", lambda p, i: F.when((i > 0) & (F.shiftright(p, 40) == F.shiftright(F.when(i > 0, F.element_at(f"p_{f}", i)), 40)), F.shiftright(p, 40).cast("int"))), lambda v: v.isNotNull()))}))

    def result(f: str) -> Column:
        in_order = lambda items: F.transform(F.array_sort(F.transform(items, lambda o: F.struct(o["variant"].alias("v"), o["ord"].alias("i"), o.alias("o")))), lambda x: x["o"])
        un, every, bad = F.col(f"un_{f}"), F.col(f"all_{f}"), F.col(f"c_{f}")
        page = F.filter(un, lambda o: o["tier"] == 1) if f == "barcode" else un
        conflicted = (F.size(bad) > 0) | (_count_keys(page) > 1)
        value = (F.col("feed.available") if f == "availability" else F.try_element_at(variants, F.lit(1))[BY_VARIANT[f]]).cast("string")
        state = F.when(conflicted, "conflicted").when(value.isNull(), "incomplete").when(F.size(f"seed_{f}") == F.size(f"g_{f}"), "verified").otherwise("single_source")
        obs = F.when(conflicted, F.concat(in_order(F.filter(every, lambda o: F.array_contains(bad, o["variant"]))), un, in_order(F.filter(every, lambda o: ~F.array_contains(bad, o["variant"]))))).otherwise(F.concat(un, in_order(every)))
        voted = _settled(state, value, F.lit(kind(f)), obs)
        seed = _seed(pick, variants, BY_VARIANT[f], kind(f))
        mine = F.concat(F.when(seed["value"].isNotNull(), F.array(seed)).otherwise(_empty()), F.filter(F.col(f"ma_{f}"), lambda o: o["variant"] == pick))
        plain = F.col(f"first.{f}")
        return (
            F.when(F.col("feed").isNull(), plain).when(chosen.isNotNull() & pick.isNull(), vote(_empty(), F.lit(True)))
            .when(chosen.isNotNull(), vote(mine)).when(F.size(f"g_{f}") == 0, plain).otherwise(voted)
        )

    return once(rows, **{f"v_{f}": result(f) for f in BY_VARIANT}).drop(*[f"{n}_{f}" for f in BY_VARIANT for n in ("un", "ma", "g", "seed", "all", "p", "c")])


def _image(rows: DataFrame) -> DataFrame:
    """Adds `v_image`: the main images vote, all of the feed's images counting as one value."""
    seen = F.col("seen.image")
    rows = once(rows, im_own=F.array_distinct(F.transform(F.filter(seen, lambda o: o["source"] == "shopify_ajax"), lambda o: o["vkey"])), im_main=F.filter(seen, lambda o: ~o["path"].rlike(r"images\[|image\[")))
    rows = once(rows, im_vote=F.transform(F.when(F.size("im_main") > 0, F.col("im_main")).otherwise(seen), lambda o: o.withField("vkey", F.when(F.array_contains("im_own", o["vkey"]), "its own").otherwise(o["vkey"]))))
    return once(rows, v_image=vote(F.col("im_vote"), None, seen)).drop("im_own", "im_main", "im_vote")


def _pricing(rows: DataFrame) -> DataFrame:
    """Adds `v_price`, `v_currency` and `price_context`: offers confirm the price in scope only in the currency that the page runs in."""
    variants, chosen, pick = F.coalesce("feed.variants", F.array().cast(f"array<{product._FEED_VARIANT}>")), F.col("chosen"), F.col("pick")
    meta = lambda name: F.try_element_at("page.og", F.lit(name))
    path = lambda i, j: F.concat(F.lit("products["), i.cast("string"), F.lit("].offers["), j.cast("string"), F.lit("]"))

    def offer(o: Column, n: Column, i: Column, j: Column) -> Column:
        code = F.when(o["values"]["priceCurrency"]["kind"] == "s", values.currency(o["values"]["priceCurrency"]["value"]))
        return F.struct(path(i, j).alias("path"), F.coalesce(o["variant"], n["variant"]).alias("variant"), code.alias("code"), values.minor_of_decimal(o["values"]["price"]["value"]).alias("amount"))

    every = F.flatten(F.transform("page.products", lambda n, i: F.transform(n["offers"], lambda o, j: offer(o, n, i, j))))
    prices = F.filter(F.transform(variants, lambda v: v["price_minor"]), lambda p: p.isNotNull())
    rows = once(rows, of=F.filter(every, lambda x: chosen.isNull() | F.coalesce(x["variant"] == pick, F.lit(False))), prices=prices, n_variants=F.size(variants), runs=values.currency(F.col("page.currency")), says=values.currency(meta("product:price:currency")), tag=values.minor_of_decimal(meta("product:price:amount")))
    low = F.coalesce(F.array_min("prices"), F.when(F.size("prices") == 0, F.col("feed.price_minor")))
    base = F.when(pick.isNotNull(), F.try_element_at(variants, pick + 1)["price_minor"]).otherwise(low)
    base_path = F.when(pick.isNotNull(), F.concat(F.lit("variants["), pick.cast("string"), F.lit("].price_minor"))).otherwise("price (product minimum)")
    rows = once(rows, base=base, base_path=base_path, low=low, comparable=F.filter("of", lambda x: F.coalesce(x["code"] == F.col("runs"), F.lit(False)) & (x["variant"].isNotNull() | (F.col("n_variants") <= 1))))
    # the price that each comparable offer is held against
    against = lambda x: F.when(x["variant"].isNotNull(), F.try_element_at(variants, x["variant"] + 1)["price_minor"]).otherwise(F.col("base"))
    checks = F.transform("comparable", lambda x: F.struct(against(x).alias("own"), x["amount"].alias("amount"), x["variant"].alias("variant"), x["path"].alias("path")))
    keyed = F.filter("of", lambda x: x["variant"].isNotNull() & x["code"].isNotNull() & x["amount"].isNotNull())
    groups = lambda with_amount: F.size(F.array_distinct(F.transform(keyed, lambda x: F.xxhash64(x["variant"], x["code"], *([x["amount"]] if with_amount else [])))))
    rows = once(rows, checks=checks, twice=groups(True) > groups(False), keyed=keyed)
    bad = F.filter("checks", lambda x: F.coalesce(x["own"] != x["amount"], F.lit(False)))
    page_checked = F.coalesce((F.col("says") == F.col("runs")) & (pick.isNotNull() | (F.col("n_variants") <= 1)), F.lit(False))
    page_bad = page_checked & F.coalesce(F.col("base") != F.col("tag"), F.lit(False))
    page_good = page_checked & F.coalesce(F.col("base") == F.col("tag"), F.lit(False))
    seen_price = lambda x: _money("json_ld", F.concat(x["path"], F.lit(".price")), x["amount"], x["variant"])
    of_check = lambda x: F.concat(_money("shopify_ajax", F.when(x["variant"].isNotNull(), F.concat(F.lit("variants["), x["variant"].cast("string"), F.lit("].price_minor"))).otherwise(F.col("base_path")), x["own"], x["variant"]), seen_price(x))
    own, tag = _money("shopify_ajax", F.col("base_path"), F.col("base")), _money("html_meta", "product:price:amount", F.col("tag"))
    whole = F.concat(own, F.flatten(F.transform("of", seen_price)), tag)
    says = F.concat(
        _money("html_meta", "Shopify.currency.active", F.col("runs"), kind="s"), _money("html_meta", "product:price:currency", F.col("says"), kind="s"),
        F.flatten(F.transform("of", lambda x: _money("json_ld", F.concat(x["path"], F.lit(".priceCurrency")), x["code"], x["variant"], "s"))),
    )
    rows = once(rows, whole=whole, says_obs=says, bad=bad, page_bad=page_bad, page_good=page_good, page_obs=F.concat(own, tag), dup_obs=F.when(F.col("twice"), F.flatten(F.transform("keyed", seen_price))).otherwise(_empty()))
    rows = once(rows, cur=vote(F.col("says_obs")))
    rows = once(rows, v_currency=F.col("cur"), cur_state=F.col("cur.state"), cur_value=F.col("cur.value")).drop("cur")
    confirmed = F.size(F.array_distinct(F.transform(F.filter("comparable", lambda x: x["variant"].isNotNull()), lambda x: x["variant"])))
    covered = F.when(F.col("n_variants") == 1, F.size("comparable") > 0).when(pick.isNotNull(), F.exists("comparable", lambda x: F.coalesce(x["variant"] == pick, F.lit(False)))).otherwise((F.col("n_variants") > 0) & (confirmed == F.col("n_variants")))
    good = F.forall("checks", lambda x: F.coalesce(x["own"] == x["amount"], F.lit(False)))
    loose = F.filter(F.transform(F.filter("of", lambda x: x["variant"].isNull()), lambda x: x["amount"]), lambda a: a.isNotNull())
    conflict = (F.size("bad") > 0) | F.col("twice") | F.col("page_bad")
    verified = (F.col("cur_state") != "conflicted") & (covered & good | F.col("page_good"))
    # without a feed's price, the lowest unassigned offer stands, if the currency is clear
    open_value = F.when(F.col("cur_value").isNotNull() & (F.size(loose) > 0), F.array_min(loose))
    lost = chosen.isNotNull() & pick.isNull()
    state = F.when(lost, "incomplete").when(conflict, "conflicted").when(F.col("base").isNotNull(), F.when(verified, "verified").otherwise("single_source")).when(open_value.isNull(), "incomplete").otherwise("single_source")
    evidence = F.when(lost, _empty()).when(conflict, F.concat(F.flatten(F.transform("bad", of_check)), F.col("dup_obs"), F.when(F.col("page_bad"), F.col("page_obs")).otherwise(_empty()), F.col("whole"))).otherwise(F.col("whole"))
    by_feed = F.col("base").isNotNull() | lost | conflict
    context = F.struct(
        F.when(chosen.isNull(), "product_minimum").when(lost, "unresolved_variant").otherwise("variant").alias("scope"), chosen.alias("variant_id"), F.try_element_at(variants, pick + 1)["title"].alias("variant_title"),
        F.when(by_feed, F.col("low")).otherwise(open_value).alias("minimum_minor"), F.when(by_feed, F.array_max("prices")).otherwise(F.array_max(loose)).alias("maximum_minor"), F.col("cur_value").alias("currency"),
    )
    out = once(rows, v_price=_settled(state, F.coalesce("base", open_value).cast("string"), F.lit("n"), evidence), price_context=context)
    return out.drop("of", "prices", "n_variants", "runs", "says", "tag", "base", "base_path", "low", "comparable", "checks", "twice", "keyed", "whole", "says_obs", "bad", "page_bad", "page_good", "page_obs", "dup_obs", "cur_state", "cur_value")


def records(captures: DataFrame, fields: Iterable[str] = product.FIELDS) -> DataFrame:
    """captures (url, feed_body, page_html, maybe requested_url, and other columns) with `feed`, `page`, `fields`, `collection_status` and, with the price, `price_context`.

    fields: a struct of the wanted fields, each with state, value (null unless verified or single_source), kind (s, n or b: its JSON type) and
    observations in the order of their weight. A page may choose a variant in its address, else in the requested one; a chosen
    number that names no variant leaves stock number, barcode, availability and price open. Each row is settled by itself: repeated
    rows and null keys too, and null or broken bodies count as sources that couldn't be read. Other columns pass through, those with names of this
    function's own are replaced.
    """
    fields = tuple(fields)
    asked = F.col("requested_url") if "requested_url" in captures.columns else F.lit(None).cast("string")
    chosen = lambda u: F.nullif(F.url_decode(F.regexp_extract(u, r"^[^?#]*\?(?:[^#]*&)?variant=([^&#]*)", 1)), F.lit(""))
    rows = once(product.observed(product.read_captures(captures), fields), chosen=F.coalesce(chosen(F.col("url")), chosen(asked)))
    place = F.array_position(F.transform("feed.variants", lambda v: v["id"]), F.col("chosen"))
    rows = once(rows, pick=F.when(place > 0, (place - 1).cast("int")), no_feed=F.col("feed").isNull())
    incomplete = lambda f: F.col("no_feed") if f in FROM_FEED else F.lit(False)
    tiered = [f for f in fields if f in product.PREFERRED and f != "image"]
    if tiered:
        one = {f"t1_{f}": F.filter(F.col(f"seen.{f}"), lambda o: o["tier"] == 1) for f in tiered} | {f"t2_{f}": F.filter(F.col(f"seen.{f}"), lambda o: o["tier"] == 2) for f in tiered}
        rows = once(rows, **one)
        rows = once(rows, **{f"own_{f}": F.try_element_at(F.filter(f"t1_{f}", lambda o: o["source"] == "shopify_ajax"), F.lit(1)) for f in tiered})
        backed = lambda f: _distinct(F.filter(f"t1_{f}", lambda o: o["vkey"] == F.col(f"own_{f}.vkey")), lambda o: F.xxhash64(o["source"]))
        rows = once(rows, **{f"by_{f}": backed(f) for f in tiered})

    def first(f: str) -> Column:
        seen = F.col(f"seen.{f}")
        if f in tiered:
            return _preferred(seen, F.col(f"t1_{f}"), F.col(f"t2_{f}"), F.col(f"own_{f}"), F.col(f"by_{f}"), incomplete(f))
        if f == "taxonomy_hints":
            trails = F.transform(F.filter("page.breadcrumbs", lambda b: F.size(b) > 0), lambda b: F.concat(F.lit("breadcrumb: "), F.array_join(b, " > ")))
            tags = F.transform(F.coalesce("feed.tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("ajax_tag: "), t))
            state = F.when(F.size(seen) == 0, "missing").when(_distinct(seen, lambda o: F.xxhash64(o["source"])) >= 2, "verified").otherwise("single_source")
            return _settled(state, F.array_join(F.concat(trails, tags), "; "), F.lit("s"), seen)
        return vote(seen, incomplete(f))

    rows = once(rows, first=F.struct(*[first(f).alias(f) for f in fields])).drop(*[f"{n}_{f}" for n in ("t1", "t2", "own", "by") for f in tiered])
    if set(BY_VARIANT) <= set(fields):
        rows = _variant_fields(rows)
    if "image" in fields:
        rows = _image(rows)
    if {"price", "currency"} <= set(fields):
        rows = _pricing(rows)
    known = set(rows.columns)
    made = [f for f in fields if f"v_{f}" in known]
    status = F.when(F.col("page.password") | F.col("page.challenge"), "blocked").when(F.col("no_feed"), "partial").otherwise("complete")
    out = once(rows, fields=F.struct(*[F.col(f"v_{f}" if f in made else f"first.{f}").alias(f) for f in fields]), collection_status=status)
    return out.drop("seen", "first", "chosen", "pick", "no_feed", *[f"v_{f}" for f in made])
