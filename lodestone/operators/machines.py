"""Folds over a key's events that split a hot key: each run of events is a function from the state before it to the state after.

Rows are put in order over all partitions, so a key's events lie in one partition or in several that follow each other. Each
partition sums up its last key's events as a function of an unknown state before; only these, one a partition, come to the
driver, which strings them together. Then every partition replays its events from the state it is given. No window and no task holds a key.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import settled
from .folds import EVENTS, session_start, session_step

#: What each request does to a reservation in each state: the state after it, and the outcome.
RESERVATIONS = {
    ("absent", "reserve"): ("reserved", "admitted"), ("reserved", "reserve"): ("reserved", "replay"), ("consumed", "reserve"): ("consumed", "replay"), ("released", "reserve"): ("released", "replay_released"),
    ("reserved", "consume"): ("consumed", "consumed"), ("consumed", "consume"): ("consumed", "unchanged"), ("reserved", "release"): ("released", "released"), ("released", "release"): ("released", "unchanged"),
    ("consumed", "compensate"): ("compensated", "compensated"), ("compensated", "compensate"): ("compensated", "unchanged"),
}


@dataclass
class Fold:
    """start() and step(state, row) -> output values fold one row after the other; open() sums up rows without the state before:
    add(summary, row), then after(summary, state) is the state behind them."""

    start: Callable[[], Any]
    step: Callable[[Any, tuple], tuple]
    open: Callable[[], Any]
    add: Callable[[Any, tuple], None]
    after: Callable[[Any, Any], Any]


def run(df: DataFrame, key: str, order: list[str], columns: list[str], f: Fold, schema: str, numbered: bool = False) -> DataFrame:
    """f over each key's rows in order (nulls first): the key, the order columns (or the row's number in its key, from 1) and the outputs of step.

    schema: the output's. Equal order values of a key stand in the order of `columns`; a null key is a key. An empty table gives no rows.
    """
    kept = list(dict.fromkeys([key, *order, *columns]))
    # in order over all partitions; what comes out of a checkpoint keeps its partitions
    rows = df.select(*kept)
    ranged = settled(rows.repartitionByRange(*[F.col(c) for c in kept]).sortWithinPartitions(*kept).withColumn("_part", F.spark_partition_id()))
    at = [kept.index(c) for c in columns]
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        seen, own, summary, state = 0, 0, None, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not seen:
                    first, part, summary = row[0], row[-1], f.open()
                elif row[0] != last:
                    state, own = f.start(), 0
                seen, own, last = seen + 1, own + 1, row[0]
                if state is None:
                    f.add(summary, tuple(row[i] for i in at))
                else:
                    f.step(state, tuple(row[i] for i in at))
        if seen:
            # a key that begins here has a state already, one that may go on from before only a function
            tail = pickle.dumps((first, last, own, summary if state is None else None, state))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tail])], names=["part", "tail"])

    starts: dict[int, tuple[Any, int]] = {}
    last_key, now, count, any_row = None, None, 0, False
    for r in sorted(ranged.mapInArrow(tails, "part int, tail binary").collect(), key=lambda r: r["part"]):
        first, last, own, summary, state = pickle.loads(bytes(r["tail"]))
        goes_on = any_row and first == last_key
        if goes_on:
            starts[r["part"]] = copy.deepcopy(now), count
        if state is None:  # one key fills the partition
            state, own = f.after(summary, copy.deepcopy(now) if goes_on else f.start()), own + (count if goes_on else 0)
        last_key, now, count, any_row = last, state, own, True
    sent = df.sparkSession.sparkContext.broadcast(starts)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, number, seen = None, None, 0, False
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not seen:
                    state, number = copy.deepcopy(sent.value[row[-1]]) if row[-1] in sent.value else (f.start(), 0)
                elif row[0] != last:
                    state, number = f.start(), 0
                seen, number, last = True, number + 1, row[0]
                out.append((row[0], *([number] if numbered else row[1 : 1 + len(order)]), *f.step(state, tuple(row[i] for i in at))))
            columns = zip(*out, strict=True) if out else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds.types, strict=True)], schema=kinds)

    return ranged.mapInArrow(replay, schema)


def table_fold(table: dict[tuple[str, str], tuple[str, str]], first: str, refused: str = "refused") -> Fold:
    """A finite machine: a run of events is the vector of the states it leads to. What the table has not leaves the state as it is."""
    states = sorted({s for s, _ in table} | {s for s, _ in table.values()} | {first})

    def step(state: dict, row: tuple) -> tuple:
        state["at"], said = table.get((state["at"], row[0]), (state["at"], refused))
        return state["at"], said

    def add(summary: dict, row: tuple) -> None:
        for s, now in summary.items():
            summary[s] = table.get((now, row[0]), (now, ""))[0]

    return Fold(lambda: {"at": first}, step, lambda: {s: s for s in states}, add, lambda summary, state: {"at": summary[state["at"]]})


@dataclass
class _Run:
    """What a run of session events makes of one status before it. The turn counters before are unknown: each is checked at most once, and known from then on.

    checks: (which counter, its value, status and turns completed since when it is checked), in order."""

    status: str
    done: int = 0
    completed: int | None = None
    current: Any = "as before"
    checks: list = field(default_factory=list)
    dead: bool = False


def _grow(run: _Run, event: str, ordinal: int | None) -> None:
    if run.dead:
        return
    allowed = EVENTS.get(event)
    if allowed is None or run.status not in allowed[0]:
        run.dead = True
        return
    if event == "TURN_STARTED":
        if run.completed is None and ordinal is not None:
            run.checks.append(("completed", ordinal - 1 - run.done, run.status, run.done))
            run.completed = ordinal - 1
        elif ordinal is None or ordinal != run.completed + 1:
            run.dead = True
            return
        run.current = ordinal
    elif event == "TURN_COMPLETED":
        if run.current == "as before" and ordinal is not None:
            run.checks.append(("current", ordinal, run.status, run.done))
        elif ordinal is None or ordinal != run.current:
            run.dead = True
            return
        # a turn that is current is the next one, so its number is known now
        run.done, run.completed, run.current = run.done + 1, ordinal, None
    run.status = allowed[1] or run.status


def _after(summary: dict[str, _Run], state: dict) -> dict:
    if state["dead"]:
        return state
    r = summary[state["status"]]
    for what, value, status, done in r.checks:
        if state[what] != value:
            return {"status": status, "completed": state["completed"] + done, "current": None, "dead": True}
    return {"status": r.status, "completed": state["completed"] + r.done, "current": state["current"] if r.current == "as before" else r.current, "dead": r.dead}


def _session_row(state: dict, row: tuple) -> tuple:
    event, ordinal = row
    error = "SESSION_FAILED" if state["dead"] else session_step(state, event, ordinal)
    state["dead"] |= error is not None
    return event, state["status"], state["completed"], error


SESSION = Fold(
    session_start, _session_row, lambda: {s: _Run(s) for s in sorted({s for a, _ in EVENTS.values() for s in a} | {t for _, t in EVENTS.values() if t})},
    lambda summary, row: [_grow(r, row[0], row[1]) for r in summary.values()] and None, _after,
)


def session_states(events: DataFrame, key: str, key_type: str = "long", order: list[str] | None = None) -> DataFrame:
    """events (key, event, ordinal, and seq or `order`) with the session's status after each and the first error, after which it stands still.

    seq is the event's number in its session where `order` is given. A session may have any number of events.
    """
    by = order or ["seq"]
    rows = events.select(key, *(by if order else [F.col("seq").cast("long").alias("seq")]), "event", F.col("ordinal").cast("int").alias("ordinal"))
    return run(rows, key, by, ["event", "ordinal"], SESSION, f"{key} {key_type}, seq long, event string, status string, completed_turns int, error string", bool(order))


def reservation_states(requests: DataFrame, key: str, order: list[str], key_type: str = "long") -> DataFrame:
    """requests (key, action and `order`) by number with the reservation's state after each and the outcome: admitted, replay, consumed, released, compensated, unchanged or refused."""
    rows = requests.select(key, *order, "action")
    return run(rows, key, order, ["action"], table_fold(RESERVATIONS, "absent"), f"{key} {key_type}, seq long, state string, outcome string", True)
