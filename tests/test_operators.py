"""Operators by small cases."""

import random
import datetime as dt

import pytest
from pyspark.sql import Row, functions as F

from lodestone.functions import captures, html, text, urls, values
from lodestone.operators import board, evidence, folds, ledger, readiness, report, robots
from lodestone.plans import products
from lodestone.sources import tables
from lodestone.sources.tables import spread
from lodestone.streaming import streams

from .conftest import SF


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw, key", [("  A  B/ ", "a b"), ("x//", "x/"), ("TRUE", "true"), ("﻿a", "a")])
def test_comparison_key(spark, raw, key):
    assert one(spark, raw, text.comparison_key) == key


@pytest.mark.parametrize("raw, key", [("Batteries", "battery"), ("boxes glasses", "box glass"), ("men's shoes", "men's shoe"), ("gas", "gas"), ("class", "class"), ("ties", "tie")])
def test_category_key(spark, raw, key):
    assert one(spark, raw, text.category_key) == key


def test_text_small(spark):
    assert one(spark, "   ", text.blank_to_null) is None
    assert one(spark, "NoIndex, nofollow,noindex, ", text.directives) == ["noindex", "nofollow"]
    assert one(spark, "<a & 'b'>", text.html_escape) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, " A.B@X.org ", text.email_normal) == "a.b@x.org" and one(spark, "nobody", text.email_normal) is None
    assert one(spark, "jonathan@x.org", text.email_mask) == "j••••••n@x.org"
    assert one(spark, "*Café*  ①", text.identity_key) == "café 1"
    assert one(spark, "Café-Noir", text.token_key) == "cafe noir"
    assert one(spark, "abcdef", lambda c: text.excerpt(c, 4)) == "abc…"


def test_anchor_quote(spark):
    df = spark.createDataFrame([("the best  Choice", "I think **The  best** choice"), ("the best choice", "so The *best*\n choice it is"), ("no", "yes")], "q string, t string")
    assert [r[0] for r in df.select(text.anchor_quote("q", "t")).collect()] == [None, "The *best*\n choice", None]


@pytest.mark.parametrize(
    "url, issue",
    [
        ("https://shop.example.com/products/mug", None), ("http://shop.example.com/products/mug", "HTTPS_REQUIRED"), ("https://u:p@shop.example.com/products/mug", "CREDENTIALS_NOT_ALLOWED"),
        ("https://localhost/products/mug", "PRIVATE_TARGET"), ("https://10.0.0.1/products/mug", "PRIVATE_TARGET"), ("https://a.internal/products/mug", "PRIVATE_TARGET"),
        ("https://shop.example.com/pages/mug", "UNSUPPORTED_PRODUCT_PATH"), ("nonsense", "INVALID_URL"), (None, "INVALID_URL"),
    ],
)
def test_url_issue(spark, url, issue):
    assert one(spark, url, urls.issue) == issue


def test_url_keys(spark):
    u = "https://Shop.Example.com:443/en/products/Mug/?variant=5&utm_x=1&b=2#top"
    assert one(spark, u, urls.canonical_key) == "https://shop.example.com/en/products/Mug/?utm_x=1&b=2"
    assert one(spark, u, urls.provider_key) == "https://shop.example.com/en/products/Mug?variant=5&b=2"
    assert one(spark, u, urls.handle) == "Mug" and one(spark, u, urls.product_json_url) == "https://shop.example.com/en/products/Mug.js"
    assert one(spark, "https://www.a.org/x", urls.site) == "a.org"
    df = spark.createDataFrame([("https://a.org/b/c", "../d?x#y"), ("https://a.org", "mailto:x"), (None, None)], "b string, l string")
    assert [r[0] for r in df.select(urls.absolute("b", "l")).collect()] == ["https://a.org/d?x#y", None, None]


@pytest.mark.parametrize("raw, minor", [("", 0), ("19.99", 1999), ("1,999", None), ("-1", None), ("1.005", 100), ("abc", None), ("1e2", 10000), ("Infinity", None), ("NaN", None)])
def test_minor(spark, raw, minor):
    assert one(spark, raw, values.minor_of_decimal) == minor


def test_values(spark):
    assert one(spark, "", values.minor_of_integer) is None and one(spark, "47000", values.minor_of_integer) == 47000 and one(spark, "1.5", values.minor_of_integer) is None
    assert one(spark, " aud ", values.currency) == "AUD" and one(spark, "$", values.currency) is None
    assert [one(spark, n, values.retry_delay, "int") for n in (0, 1, 2)] == [45, 120, None]
    assert [one(spark, a, values.availability) for a in ("https://schema.org/InStock", "SoldOut", "mystery")] == [True, False, None]
    assert one(spark, "x", values.stable_uuid)[14] == "5" and one(spark, "x", values.stable_uuid)[19] == "a"


PAGE = """<html><head><title> A  b </title><link rel="canonical" href="/p"><meta property="og:title" content="first"><meta property="og:title" content="second">
<meta name="robots" content="noindex"><script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Product"], "brand": {"name": "Acme"}, "offers": [{"@type": "Offer", "price": "1"}]}]}</script>
<script type="application/ld+json">{broken</script></head><body><h1>Mug <b>big</b></h1><template>hidden</template><p>Text</p></body></html>"""


def test_references_cut_short_stay(spark):
    page = '<title>A&amp;&amp</title><meta name="description" content="x&lt y&lt;"><h1>&eacute;&#233;&#xE9 &notit; &am</h1><script type="application/ld+json">{"@type":"T","n":"a&b &amp c"}</script>'
    p = spark.createDataFrame([(page,)], "h string").select(html.parse_page("h").alias("p")).select("p.*").first()
    assert (p.title, p.h1, p.description) == ("A&&amp", "éé&#xE9 &notit; &am", "x&lt y<")
    assert p.json_ld == ['{"@type": "T", "n": "a&b &amp c"}']


def test_page(spark):
    p = spark.createDataFrame([(PAGE,), (None,), ("",)], "h string").select(html.parse_page("h").alias("p")).select("p.*")
    a, b, _ = p.collect()
    assert (a["title"], a["h1"], a["canonical"], a["og"], a["robots"], a["json_ld_errors"]) == ("A b", "Mug big", "/p", {"og:title": "first"}, "noindex", 1)
    assert len(a["json_ld"]) == 2 and "hidden" not in a["text"] and b["title"] is None
    nodes = p.where('title IS NOT NULL').select(html.product_nodes(F.col("json_ld")).alias("n")).select(F.col("n")[0].alias("n"))
    assert nodes.select(html.brand_name(F.col("n")), F.size(html.offers(F.col("n")))).first()[:] == ("Acme", 1)


def observations(spark, rows):
    return spark.createDataFrame(rows, "e long, source string, ord int, vkey string, value string")


def test_resolve_field_states_and_order(spark):
    rows = [(1, "a", 0, "x", "X"), (1, "b", 1, "x", "x"), (2, "a", 0, "x", "x"), (2, "a", 1, "x", "x"), (3, "a", 0, "x", "x"), (3, "b", 1, "y", "y")]
    entities = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False)], "e long, available boolean")
    for order in (rows, rows[::-1]):
        got = {r["e"]: (r["state"], r["value"]) for r in evidence.resolve_field(observations(spark, order), entities, ["e"], "available").collect()}
        assert got == {1: ("verified", "X"), 2: ("single_source", "x"), 3: ("conflicted", None), 4: ("missing", None), 5: ("incomplete", None)}


def test_prefer_field(spark):
    rows = [(1, 2, "html", 0, "f", "f"), (2, 1, "catalog", 0, "a", "A"), (2, 1, "html", 1, "a", "a"), (2, 1, "meta", 2, "b", "b"), (2, 2, "html", 3, "z", "z"), (3, 1, "catalog", 0, "a", "a"), (3, 1, "meta", 1, "b", "b")]
    got = {r["e"]: (r["tier"], r["state"], r["value"]) for r in evidence.prefer_field(spark.createDataFrame(rows, "e long, tier int, source string, ord int, vkey string, value string"), ["e"], "catalog").collect()}
    assert got == {1: (2, "single_source", "f"), 2: (1, "verified", "A"), 3: (1, "conflicted", None)}


@pytest.mark.parametrize(
    "chosen, offers, scope, state, price",
    [
        (101, [(101, 47000, "AUD")], "variant", "verified", 47000), (None, [(101, 47000, "AUD"), (102, 42000, "AUD")], "product_minimum", "verified", 42000), (999, [], "unresolved", "incomplete", None),
        (101, [(101, 47000, "USD")], "variant", "single_source", 47000), (101, [(101, 1, "AUD")], "variant", "conflicted", None), (101, [(101, 47000, "AUD"), (101, 46000, "AUD")], "variant", "conflicted", None),
        (None, [(101, 47000, "AUD")], "product_minimum", "single_source", 42000), (102, [], "variant", "single_source", 42000),
    ],
)
def test_scoped_price(spark, chosen, offers, scope, state, price):
    products = spark.createDataFrame([(1, chosen, "AUD")], "k long, chosen long, currency string")
    variants = spark.createDataFrame([(1, 101, 47000), (1, 102, 42000)], "k long, variant_id long, price long")
    r = evidence.scoped_price(products, variants, spark.createDataFrame([(1, *o) for o in offers], "k long, variant_id long, price long, currency string"), "k").first()
    assert (r["scope"], r["price_state"], r["price"]) == (scope, state, price)


def test_match_variants(spark):
    variants = spark.createDataFrame([(1, 10, "p", "A"), (1, 11, "p", "B"), (1, 12, "p", "B")], "k long, variant_id long, page_key string, sku string")
    offers = spark.createDataFrame([(1, 1, "p", 10, "B"), (1, 2, "p", 99, "A"), (1, 3, "p", None, "A"), (1, 4, "p", None, "B")], "k long, offer_id long, page_key string, url_variant long, sku string")
    assert {r["offer_id"]: r["variant_id"] for r in evidence.match_variants(offers, variants, "k").collect()} == {1: 10, 2: None, 3: 10, 4: None}


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b # note\nDisallow: /*.gif$\n\nUser-agent: GPTBot\nUser-agent: other\nDisallow: /\n\nUser-agent: OAI-SearchBot\nDisallow:\n"
    parsed = robots.rules(spark.createDataFrame([("s", body)], "s string, body string"), "s")
    pages = spark.createDataFrame([(1, "s", "/a/x"), (2, "s", "/a/b/c"), (3, "s", "/i.gif"), (4, "s", "/i.gifs"), (5, "s", "/(x)")], "page long, s string, path string")
    got = {(r["page"], r["kind"]): r["allowed"] for r in robots.access(pages, parsed, "s").collect()}
    assert [got[i, "general_crawl"] for i in range(1, 6)] == [False, True, False, True, True]
    assert not any(got[i, "openai_training"] for i in range(1, 6)) and all(got[i, "openai_search"] for i in range(1, 6))


def test_presence_and_recheck(spark):
    df = spark.createDataFrame([("conflicted", True), ("verified", True), ("missing", True), ("missing", False), ("incomplete", True)], "s string, r boolean")
    assert [r[0] for r in df.select(readiness.presence(F.col("s"), F.col("r"))).collect()] == ["conflicting", "present", "missing", "unavailable", "unavailable"]
    cur = spark.createDataFrame([(1, "a", 1, "pass"), (1, "b", 2, "fail"), (1, "c", 1, "warn"), (1, "d", 1, "warn"), (1, "e", 1, "pass"), (2, "a", 1, "fail")], "k long, id string, version int, outcome string")
    old = spark.createDataFrame([(1, "a", 1, "warn"), (1, "b", 1, "pass"), (1, "c", 1, "pass"), (1, "gone", 1, "fail"), (1, "e", 1, "pass")], "k long, id string, version int, outcome string")
    got = {(r["k"], r["id"]): r["bucket"] for r in readiness.recheck(cur, old, "k").collect()}
    assert got == {(1, "a"): "improved", (1, "b"): "skipped", (1, "c"): "regressed", (1, "d"): "still_open", (1, "e"): None, (2, "a"): None}


def test_admission_of_a_hundred_credits(spark):
    requests = spark.createDataFrame([(1, i, 30) for i in range(6)] + [(2, 7, 101), (2, 8, 100)], "k long, id long, credits long")
    got = {r["id"]: r["admitted"] for r in folds.admissions(requests, "k", ["id"], 100).collect()}
    assert [got[i] for i in range(6)] == [True, True, True, False, False, False] and not got[7] and got[8]


def test_session_states(spark):
    events = [("PROTOCOL_APPROVED", None), ("SESSION_QUEUED", None), ("TURN_STARTED", 1), ("TURN_COMPLETED", 1), ("TURN_STARTED", 3), ("SESSION_COMPLETED", None)]
    df = spark.createDataFrame([(1, i, e, o) for i, (e, o) in enumerate(events)], "k long, seq long, event string, ordinal int")
    got = folds.session_states(df, "k").orderBy("seq").collect()
    assert [r["error"] for r in got] == [None, None, None, None, "ORDINAL_GAP", "SESSION_FAILED"] and got[-1]["status"] == "running" and got[-1]["completed_turns"] == 1


def turn(**over):
    return {"turn": 1, "proposed": "verify", "quote": None, "quote_names_full": False, "drift": False, "full": 0, "plausible": 1, "signatures": ["a"], "unresolved": ["n1"], "hard": ["n1"]} | over


@pytest.mark.parametrize(
    "turns, last",
    [
        ([turn(plausible=0)], "explore"), ([turn()], "verify"), ([turn(full=1, unresolved=[])], "compare"), ([turn(full=2)], "compare"), ([turn(proposed="finish", quote="q", quote_names_full=True, full=1)], "finish"),
        ([turn(drift=True)], "explore"), ([turn(), turn(turn=2), turn(turn=3)], "stop"), ([turn(turn=6)], "stop"), ([turn(unresolved=[], hard=[])], "stop"),
        ([turn(turn=i, plausible=0, signatures=[str(i)]) for i in range(1, 4)], "stop"), ([turn(turn=i, signatures=[str(i)]) for i in range(1, 4)], "stop"),
        ([turn(turn=i, full=2, signatures=[str(i)], unresolved=list(n)) for i, n in ((1, "ab"), (2, "ba"), (3, "ab"))], "stop"), ([turn(turn=i, full=2, signatures=[str(i)], unresolved=list(n)) for i, n in ((1, "ab"), (2, "ac"), (3, "ab"))], "compare"),
        ([turn(turn=i, signatures=[str(i)], **m) for i, m in ((1, {}), (2, {"full": 2}), (3, {}))], "verify"),
    ],
)
def test_controller(turns, last):
    history = folds.history_start()
    assert [folds.decide(t, history)[0] for t in turns][-1] == last


def from_all_turns(turns):
    """Each decision from the whole list of turns and decisions before it, until one ends the session."""
    made = []
    for k, t in enumerate(turns):
        if any(m[0] in ("finish", "stop") for m in made):
            made.append((None, "SESSION_OVER", (), 0, 0))
            continue
        seen = {s for x in turns[:k] for s in x["signatures"]}
        idle = 0 if set(t["signatures"]) - seen else (made[-1][3] if made else 0) + 1
        repairs, needs = (made[-1][4] if made else 0), (t["unresolved"] or t["hard"])[:2]
        steps = [
            (t["proposed"] == "finish" and bool(t["quote"]) and t["quote_names_full"] and not t["drift"], "finish", "decision_supported"), (idle >= 2, "stop", "no_progress"), (t["turn"] >= 6, "stop", "turn_limit"),
            (t["drift"] or not t["plausible"], "explore", "unmet_needs"), (t["full"] >= 2, "compare", "comparison_ready"), (True, "verify", "unknown_evidence"),
        ]
        action, reason = next(x[1:] for x in steps if x[0])
        repairs += action == "explore"
        if action == "verify" and t["full"]:
            action, reason = "compare", "comparison_ready"
        same = len(made) >= 2 and all(m[0] == action and sorted(m[2]) == sorted(needs) for m in made[-2:])
        if action == "explore" and repairs > 2 or action == "verify" and not needs or action in ("verify", "compare") and same:
            action, reason = "stop", "no_progress"
        made.append((action, reason, needs, idle, repairs))
    return [m[:2] for m in made]


def test_controller_against_whole_histories(spark):
    rng = random.Random(6)
    pick = lambda most: rng.sample("abc", rng.randrange(most + 1))
    sessions = {k: [turn(turn=i + 1, proposed=rng.choice(["finish", "verify"]), quote=rng.choice([None, "q"]), quote_names_full=rng.random() < 0.3, drift=rng.random() < 0.1, full=rng.choice([0, 0, 1, 2, 2]), plausible=rng.choice([0, 1, 1, 2]),
                         signatures=[f"s{rng.randrange(9)}"], unresolved=pick(3), hard=pick(2)) for i in range(8)] for k in range(120)}
    rows = [(k, *t.values()) for k, turns in sessions.items() for t in turns]
    schema = "k long, turn long, proposed string, quote string, quote_names_full boolean, drift boolean, full int, plausible int, signatures array<string>, unresolved array<string>, hard array<string>"
    got = {(r["k"], r["turn"]): (r["action"], r["reason"]) for r in folds.decisions(spark.createDataFrame(rows, schema).repartition(5), "k").collect()}
    assert got == {(k, i + 1): x for k, turns in sessions.items() for i, x in enumerate(from_all_turns(turns))}


def test_classifier_bound_is_the_expression(spark):
    df = spark.createDataFrame([("absent", 0.9, 0.2), ("absent", 0.9, 0.19), ("recommended", 0.9, 0.79), ("final_choice", 0.69, 1.0), ("not_observed", 0.9, 0.0), ("?", 1.0, 1.0)], "c string, p double, n double")
    got = [r[0]["fallback_reason"] for r in df.select(report.classified(F.col("c"), F.col("p"), F.col("n"), F.lit("list"))).collect()]
    assert got == ["inconsistent_identity", None, "inconsistent_identity", "low_confidence", "not_observed", "unknown_option"]


def test_integrity(spark):
    a = spark.createDataFrame([("s", "c", "n1", "supported", "good", 1, ["x"]), ("s", "c", "n9", "supported", "good", 1, []), ("s", "c", "n2", "supported", "bad", 1, []), ("s", "c", "n3", "cited", None, 1, []), ("s", "d", "n1", "unknown", None, 1, ["z"])], "session string, candidate string, need_id string, status string, quote string, turn int, source_ids array<string>")
    needs = spark.createDataFrame([("s", n) for n in ("n1", "n2", "n3")], "session string, need_id string")
    issues = report.integrity_issues(a, needs, spark.createDataFrame([("s", 1, "a good text")], "session string, turn int, text string"), spark.createDataFrame([("s", "x")], "session string, source_id string"))
    assert {(r["candidate"], r["need_id"], r["issue"]) for r in issues.collect()} == {("c", "n9", "UNKNOWN_NEED"), ("c", "n2", "QUOTE_NOT_IN_TURN"), ("c", "n3", "CITED_WITHOUT_SOURCE"), ("d", "n1", "UNKNOWN_SOURCE")}
    assert {(r["candidate"], r["need_id"]) for r in report.recovered(a, issues).where("status = 'unknown'").collect()} == {("c", "n9"), ("c", "n2"), ("c", "n3"), ("d", "n1")}


def test_ledger_audit_and_exclusions(spark):
    p = spark.createDataFrame([("t1", 10), ("t2", 10), ("t3", 10), ("t4", 10)], "transaction_id string, credits long")
    g = spark.createDataFrame([("t1", 10), ("t2", 10), ("t2", 10), ("t3", 9)], "transaction_id string, credits long")
    assert {r["transaction_id"]: r["issue"] for r in ledger.purchase_audit(p, g).collect()} == {"t2": "REPEATED_GRANT", "t3": "WRONG_AMOUNT", "t4": "NO_GRANT"}
    df = spark.createDataFrame([("a",), (None,), ("x",)], "e string")
    assert df.where(board.excluded(F.col("e"), ["x"], True)).count() == 2 and df.where(board.excluded(F.col("e"), ["x"], False)).count() == 1 and df.where(board.excluded(F.col("e"), [], False)).count() == 3


def test_snapshots(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [Row("c1", "html", 200, "text/html; charset=utf-8", "<p>"), Row("c1", "robots", 404, "text/plain", ""), Row("c2", "html", 500, "text/html", ""), Row("c3", "html", 200, "text/html", "x"), Row("c3", "shopify_ajax", 200, "application/json", "{}"), Row("c3", "robots", 200, "text/plain", "a" * (256 * 1024 + 1))]
    df = spark.createDataFrame([(r[0], r[1], "u", "u", r[2], r[3], at, {"X-Robots-Tag": "none", "b": "c"}, r[4]) for r in rows], "capture_id string, kind string, requested_url string, final_url string, status int, content_type string, captured_at timestamp, headers map<string,string>, body string")
    got = {r["capture_id"]: r for r in tables.collect_sources(df).collect()}
    assert set(got) == {"c1", "c3"} and got["c1"]["robots_error"] == "HTTP_STATUS" and got["c1"]["ajax_error"] == "NOT_CAPTURED" and got["c3"]["robots_error"] == "BODY_TOO_LARGE" and got["c3"]["ajax"] == "{}" and got["c1"]["headers"] == {"X-Robots-Tag": "none"}


def test_journal_and_ranges(spark):
    req = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "a", "a")], "call_id long, request_sha string, asked_sha string")
    got = {r["call_id"]: (r["state"], r["body"]) for r in tables.journal(req, spark.createDataFrame([(1, "r"), (2, "r")], "call_id long, body string")).collect()}
    assert got == {1: ("replayed", "r"), 2: ("changed", None), 3: ("uncertain", None)}
    df = spark.createDataFrame([("bytes=0-4",), ("bytes=5-",), ("bytes=-3",), ("bytes=20-",), ("bytes=4-2",), ("x",)], "s string")
    assert [r[0] and tuple(r[0]) for r in df.select(tables.byte_range(F.col("s"), F.lit(10))).collect()] == [(0, 4), (5, 9), (7, 9), None, None, None]


def test_leases_match_a_loop(spark):
    from lodestone.plans import QUERIES

    rows = [(r["event_type"], r["ts"], r["event_id"] % 5) for r in tables.table(spark, SF, "events").collect()]
    until, expected = {}, {}
    for kind, at, attempt in sorted(rows):
        if attempt > 3:
            verdict = "failed"
        elif at < until.get(kind, dt.datetime.min):
            verdict = "held"
        else:
            verdict, until[kind] = "granted", at + dt.timedelta(seconds=300)
        expected[verdict] = expected.get(verdict, 0) + 1
    counts = lambda: {r["verdict"]: r["count"] for r in QUERIES["lease_stream"](spark, SF).groupBy("verdict").count().collect()}
    assert counts() == expected
    rows_at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_at_once)
    spark.conf.set(rows_at_once, "20")  # a key's claims come in many batches
    try:
        assert counts() == expected
    finally:
        spark.conf.set(rows_at_once, before)


def test_routing(spark):
    got = {}
    df = spark.createDataFrame([("a", 0), ("b", 1), ("a", 3), ("z", 0)], "kind string, attempts int")
    streams.routed(df, "kind", {k: (lambda d, k=k: got.__setitem__(k, d.count())) for k in ("a", "b", "dead")}, "attempts")
    assert got == {"a": 1, "b": 1, "dead": 2}


def test_short_needles_are_contained(spark):
    """Needles of no to eight words, whole or within words, as Python's `in` finds them."""
    needles = ["", "a", "at sat", "cat", "é", "cat sat on", "the cat sat on", "the cat sat on the", "cat  sat on the mat", "he cat sat on the mat to", "dog", "dog ran", "the dog sat on", "ca t", "extraordinarily", "inarily lo"]
    texts = ["the cat sat on the mat today", "concatenate", "cat", "", "café at sat", "an extraordinarily long dog", "the cat\nsat on\tthe mat", None]
    flat = lambda x: " ".join(x.split())
    a = spark.createDataFrame(list(enumerate(needles)) + [(99, None)], "item long, text string")
    b = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = sorted((r["item"], r["doc"]) for r in evidence.contained_texts(a, b, "item", "doc").collect())
    assert got == sorted((i, j) for i, x in enumerate(needles) for j, y in enumerate(texts) if y is not None and flat(x) in flat(y))
    assert evidence.contained_texts(a.where("1 = 0"), b, "item", "doc").count() == 0


def test_observations_are_read_once(spark):
    for query in (products.product_preferred_fields, products.product_field_states, products.product_taxonomy):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1 and plan.count("ArrowEvalPython") == 1, query.__name__
        # the feed's body is one parse, not one a member
        assert plan.count("from_json") == 1, query.__name__


def test_states_without_entities(spark):
    rows = [(1, "a", 2, "x", "x"), (1, "a", 1, "x", "X"), (1, "b", 3, None, "y"), (2, "a", 1, None, "z"), (None, "a", 1, "q", "q"), (None, "b", 2, "r", "r")]
    got = evidence.resolve_field(spark.createDataFrame(rows, "e long, source string, ord int, vkey string, value string"), None, ["e"]).collect()
    assert {r["e"]: r[1:] for r in got} == {1: ("single_source", "X", 2, 1, 1), 2: ("missing", None, 0, 0, 0), None: ("conflicted", None, 2, 2, 2)}


def test_preferred_counts_sources_of_the_used_tier(spark):
    rows = [(1, 1, "a", 0, "x", "x"), (1, 1, "b", 1, "y", "y"), (1, 1, "b", 2, "x", "X"), (1, 1, None, 3, "x", "x"), (1, 2, "c", 4, "z", "z"), (2, 2, None, 0, "x", "x"), (None, 1, "a", 0, "x", "x"), (3, None, "a", 0, "x", "x")]
    got = evidence.prefer_field(spark.createDataFrame(rows, "e long, tier int, source string, ord int, vkey string, value string"), ["e"], "a").collect()
    assert {r["e"]: r[1:] for r in got} == {1: (1, "verified", "x", 2, 2), 2: (2, "single_source", "x", 1, 0)}


def test_short_rows_are_dealt_evenly(spark):
    one_group = spark.range(0, 4000, 1, 4).coalesce(1).unionByName(spark.range(0, 4, 1, 3))
    assert one_group.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = [r[0] for r in spread(one_group).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 4004 and max(sizes) < 2 * 4004 / spark.sparkContext.defaultParallelism / 3


def test_captures_in_slices(spark):
    rows = spark.range(0, captures.SLICE * 2 + 3, 1, 1).select("id", F.concat(F.lit("<title>"), "id", F.lit("</title>")).alias("h"))
    got = rows.select("id", captures.parse_capture(F.col("h"), F.lit("https://a.b/"), F.array().cast("array<string>"))["title"].alias("t")).collect()
    assert all(r["t"] == str(r["id"]) for r in got) and len(got) == captures.SLICE * 2 + 3
