"""Roles of a session settled with timers: leases that lapse and retries after a rate limit, by event time.

State is a map from role to what it waits for; timers wake a session's key when the watermark passes the next due time. Each
trigger's events are taken in order with the due times between them, so the rows don't depend on how events fall into triggers, as long
as none is later than the watermark. Needs the RocksDB state store (see rocksdb()).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a lease, and before each further attempt after a rate limit.
LEASE = 300
DELAYS = (45, 120)
OUT = "{key} {kind}, role string, at_us long, verdict string"


class Role:
    """A role of a session: `until` is the end of its lease or of its wait (0: neither), `waits` tells which; `attempts` counts rate limits."""

    __slots__ = ("until", "waits", "attempts", "over")

    def __init__(self, until: int = 0, waits: bool = False, attempts: int = 0, over: bool = False):
        self.until, self.waits, self.attempts, self.over = until, waits, attempts, over

    def due(self, now: int) -> tuple[int, str] | None:
        """What has come due by now, and when."""
        if not self.until or self.until > now:
            return None
        found = self.until, "retry" if self.waits else "lapsed"
        self.until, self.waits = 0, False
        return found

    def take(self, kind: str, at: int, lease: int, delays: tuple[int, ...]) -> str:
        """The verdict on an event: claimed, limited (by the provider's rate) or settled."""
        if self.over:
            return "over"
        leased = bool(self.until) and not self.waits
        if kind == "claimed":
            if self.until:
                return "held"
            self.until = at + lease * 1_000_000
            return "granted"
        if not leased:
            return "stale"
        self.until = 0
        if kind == "settled":
            self.over = True
            return "settled"
        self.attempts += 1
        if self.attempts > len(delays):
            self.over = True
            return "terminal"
        self.until, self.waits = at + delays[self.attempts - 1] * 1_000_000, True
        return "waits"


class _Settle(StatefulProcessor):
    def __init__(self, key: str, lease: int, delays: tuple[int, ...]):
        self.key, self.lease, self.delays = key, lease, delays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.roles = handle.getMapState("roles", "role string", "until long, waits boolean, attempts int, over boolean")

    def _open(self) -> dict[str, Role]:
        return {k[0]: Role(*v) for k, v in self.roles.iterator()}

    def _keep(self, roles: dict[str, Role]) -> None:
        """Writes the roles back and sets a timer for the next due time of any."""
        for name, r in roles.items():
            self.roles.updateValue((name,), (r.until, r.waits, r.attempts, r.over))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting := [r.until for r in roles.values() if r.until]:
            self.handle.registerTimer(-(-min(waiting) // 1000))

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, "role", "at_us", "verdict"])

    def _settle_due(self, roles: dict[str, Role], now: int, out: list[tuple]) -> None:
        found = [(name, d) for name, r in roles.items() if (d := r.due(now))]
        out += [(name, at, verdict) for name, (at, verdict) in sorted(found, key=lambda x: (x[1][0], x[0]))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        roles, out = self._open(), []
        events = sorted((at, role, kind) for pdf in rows for at, role, kind in zip(pdf["at_us"], pdf["role"], pdf["kind"], strict=True))
        for at, name, kind in events:
            self._settle_due(roles, int(at), out)
            out.append((name, int(at), roles.setdefault(name, Role()).take(kind, int(at), self.lease, self.delays)))
        self._keep(roles)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        roles, out = self._open(), []
        self._settle_due(roles, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        self._keep(roles)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that map state and timers need, for streams started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def settlements(events: DataFrame, key: str, key_type: str = "long", delay: str = "0 seconds", lease: int = LEASE, delays: tuple[int, ...] = DELAYS) -> DataFrame:
    """events (key, role, at, kind), a stream, with a verdict each, and rows of their own for what comes due.

    kind: claimed gives granted or held; settled and limited give settled, and waits or terminal (no attempt left), or stale without a running lease;
    over once the role has ended. A lease that isn't settled in time gives lapsed, and a wait that ends gives retry, at the time it was due.
    Rows without role, at or kind are left out. at_us is in microseconds.
    """
    rows = events.where("role IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL").withWatermark("at", delay)
    rows = rows.select(key, "role", "kind", "at", F.unix_micros("at").alias("at_us"))
    out = OUT.format(key=key, kind=key_type)
    return rows.groupBy(key).transformWithStateInPandas(_Settle(key, lease, delays), out, "Append", "EventTime")


def plain(events: list[tuple], last: int, lease: int = LEASE, delays: tuple[int, ...] = DELAYS) -> list[tuple]:
    """What settlements() gives for a session's (at_us, role, kind) once the watermark stands at `last`: for tables whose log is closed."""
    roles, out = {}, []

    def settle(now: int) -> None:
        found = [(name, d) for name, r in roles.items() if (d := r.due(now))]
        out.extend((name, at, verdict) for name, (at, verdict) in sorted(found, key=lambda x: (x[1][0], x[0])))

    for at, name, kind in sorted(events):
        settle(at)
        out.append((name, at, roles.setdefault(name, Role()).take(kind, at, lease, delays)))
    settle(last)
    return out
