"""Folds that split a key: the same rows as a plain loop, however the rows fall into partitions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import machines


def plain(fold, rows):
    out, state, key = [], None, object()
    for k, seq, *values in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if k != key:
            key, state = k, fold.start()
        out.append((k, seq, *fold.step(state, tuple(values))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sessions_over_partitions(spark, seed):
    """One session with most of the events, long legal runs with turns, errors at times, a null key."""
    rng, rows = random.Random(seed), []
    for k in [None, 1, 2, 3, 4, *range(5, 40)]:
        n, turn, seq = 600 if k == 2 else rng.randrange(1, 30), 1, 0
        events = [("PROTOCOL_APPROVED", None), ("SESSION_QUEUED", None)]
        while len(events) < n:
            events += [("TURN_STARTED", turn)] * rng.choice([1, 1, 2]) + [("TURN_COMPLETED", turn)]
            turn += 1
        if k != 2 or seed == 1:
            events[rng.randrange(len(events))] = rng.choice([("TURN_STARTED", 3), ("TURN_COMPLETED", None), ("SESSION_CANCELLED", None), (None, 1), ("TURN_STARTED", None), ("SESSION_COMPLETED", None)])
        rows += [(k, seq + i, e, o) for i, (e, o) in enumerate(events)]
    want = plain(machines.SESSION, rows)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, seq long, event string, ordinal int").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = machines.session_states(df, "k")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
            numbered = machines.session_states(df, "k", order=["seq"]).select("k", F.col("seq") - 1, "event", "status", "completed_turns", "error")
            assert sorted(map(tuple, numbered.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert machines.session_states(df.where("1 = 0"), "k").count() == 0


def test_reservations_over_partitions(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice(["reserve", "consume", "release", "compensate", "other", None])) for k in (1, 2) for i in range(400)]
    fold = machines.table_fold(machines.RESERVATIONS, "absent")
    want = [(k, s + 1, *rest) for k, s, *rest in plain(fold, rows)]
    got = machines.reservation_states(spark.createDataFrame(rows, "k long, at long, action string").repartition(3), "k", ["at"])
    assert sorted(map(tuple, got.collect())) == sorted(want)
