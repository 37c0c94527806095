"""Profiles, answers and configurations by small cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import board, ledger, profile, report


@pytest.mark.parametrize("status, body, issue", [(500, "{}", "http_status"), (200, "nope", "not_json"), (200, '{"choices": []}', "chat_shaped"), (200, '{"x": 1}', "missing_answers"), (200, '{"answers": [1]}', None)])
def test_parsed_answer(spark, status, body, issue):
    assert spark.createDataFrame([(status, body)], "s int, b string").select(profile.parsed_answer(F.col("s"), F.col("b"))).first()[0] == issue


def test_config_issues(spark):
    df = spark.createDataFrame([("a", '{"model": "m"}'), ("b", "{"), ("c", '{"endpoint": "https://x"}'), ("d", '{"model": "m", "endpoint": "http://x"}'), ("e", None)], "name string, body string")
    assert {r["name"]: r["issue"] for r in profile.config_issues(df).collect()} == {"b": "NOT_JSON", "c": "NO_MODEL", "d": "ENDPOINT_NOT_HTTPS", "e": "NOT_JSON"}


def test_lists(spark):
    df = spark.createDataFrame([(["b", "x", "a"], ["a", "b"], [])], "c array<string>, k array<string>, n array<string>")
    got = df.select(profile.known_sources(F.col("c"), F.col("k")), profile.merged(F.col("n"), F.col("k")), profile.merged(F.col("c"), F.col("k"), 2), profile.appended(F.col("k"), F.col("c"))).first()
    assert [list(x) for x in got] == [["b", "a"], ["a", "b"], ["b", "x"], ["a", "b", "x"]]
    hit = lambda m, n, s: spark.createDataFrame([(m, n, s, ["a"])], "m boolean, n string, s array<string>, k array<string>").select(profile.direct_retrieval(F.col("m"), F.col("n"), F.col("s"), F.col("k"))).first()[0]
    assert hit(True, "n", ["a"]) and not hit(True, "n", []) and not hit(True, "", ["a"]) and not hit(True, "n", ["z"]) and not hit(False, "n", ["a"])


def test_undeclared(spark):
    a = spark.createDataFrame([(1, "https://a.org/x/?utm_s=1"), (1, "https://a.org/y"), (2, "https://b.org")], "k long, url string")
    b = spark.createDataFrame([(1, "https://A.org/x#f")], "k long, url string")
    assert {tuple(r) for r in profile.undeclared(a, b, "k", "url").collect()} == {(1, "https://a.org/y"), (2, "https://b.org")}


def test_blind_context_never_shows_the_target(spark):
    df = spark.createDataFrame([(1, 1, "q", "target", 0.5)], "session long, turn long, question string, target_state string, score double")
    assert profile.blind_context(df).columns == ["session", "turn", "question"]
    for role in profile.boundaries(spark).collect():
        assert role["identity"] == (role["role"] in ("observer", "classifier")) and not role["observations"]


def test_labels_and_catalog(spark):
    df = spark.createDataFrame([("www.a.org", "x.org"), ("Some title", "www.b.org"), ("Title", "vertexaisearch.cloud.google.com")], "t string, h string")
    assert [r[0] for r in df.select(report.publisher_label(F.col("t"), F.col("h"))).collect()] == ["a.org", "b.org", "Title"]
    price = spark.createDataFrame([(10, 100, 0, 3), (10, 110, 10, 3), (10, 101, 0, 3), (10, 100, 0, 4)], "u int, c int, b int, t int")
    assert [r[0] for r in price.select(ledger.catalog_issue(F.col("u"), F.col("c"), F.col("b"), F.col("t"))).collect()] == [None, None, "CREDITS", "TASKS"]


def test_bill_of_nothing(spark):
    assert board.bill(spark.createDataFrame([], "role string, cost long, n long"), "role", "cost", "n").collect() == []
