"""Timers: the stream's rows are those of a plain loop, with leases that lapse and retries at the times they were due."""

from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.plans import QUERIES
from lodestone.plans.streams import _ROLE_KINDS
from lodestone.streaming import settlement

from .conftest import SF


def expected(roles):
    """By another way: each role's events on a line with their due times, one after the other."""
    out = []
    for role, events, last in roles:
        lease_end = wait_end = None
        limits, over = 0, False
        for at, kind in [*events, (last, None)]:
            if lease_end is not None and lease_end <= at:
                out.append((role, lease_end, "lapsed"))
                lease_end = None
            if wait_end is not None and wait_end <= at:
                out.append((role, wait_end, "retry"))
                wait_end = None
            if kind is None:
                break
            verdict = "over" if over else None
            if verdict is None and kind == "claimed":
                verdict = "granted" if lease_end is None and wait_end is None else "held"
                lease_end = at + 300_000_000 if verdict == "granted" else lease_end
            elif verdict is None and lease_end is None:
                verdict = "stale"
            elif verdict is None:
                lease_end, limits = None, limits + (kind == "limited")
                over = kind == "settled" or limits == 3
                verdict = "settled" if kind == "settled" else "terminal" if over else "waits"
                wait_end = at + (45, 120)[limits - 1] * 1_000_000 if verdict == "waits" else None
            out.append((role, at, verdict))
    return out


def test_settlements(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60).cast("long").alias("at")).collect()
    roles, last = defaultdict(list), 1000 * (max(r["at"] for r in rows) // 1000)
    for r in rows:
        roles[r["user_id"], "searcher" if r["event_id"] % 2 == 0 else "controller"].append((r["at"], _ROLE_KINDS[r["event_id"] % 5]))
    want = [(user, *x) for (user, role), events in roles.items() for x in expected([(role, sorted(events), last)])]
    got = [tuple(r) for r in QUERIES["role_settlements"](spark, SF).collect()]
    due = lambda x: x[3] in ("lapsed", "retry")
    assert sorted(got) == sorted(want) and {"lapsed", "retry", "terminal", "waits", "granted", "held", "stale"} <= {x[3] for x in got}
    assert any(due(x) for x in got)


def test_plain_loop():
    s = 1_000_000
    events = [(0, "a", "claimed"), (10 * s, "a", "claimed"), (20 * s, "a", "limited"), (30 * s, "a", "claimed"), (70 * s, "a", "claimed"), (400 * s, "b", "settled")]
    assert settlement.plain(events, 500 * s) == [
        ("a", 0, "granted"), ("a", 10 * s, "held"), ("a", 20 * s, "waits"), ("a", 30 * s, "held"), ("a", 65 * s, "retry"), ("a", 70 * s, "granted"), ("a", 370 * s, "lapsed"), ("b", 400 * s, "stale"),
    ]
