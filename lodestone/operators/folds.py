"""Order-dependent operators: decisions that feed the next one, so a key's rows are read in order.

Rows are dealt by key, sorted by Spark and streamed through a task in Arrow batches; memory holds one key's state and
never its rows. A key's own rows can't be split, as each step needs the state before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Session events, the states each may come in, and the state after it (None: the same).
EVENTS = {
    "PROTOCOL_APPROVED": (("draft",), "protocol_ready"),
    "SESSION_QUEUED": (("protocol_ready",), "queued"),
    "TURN_STARTED": (("queued", "running"), "running"),
    "TURN_COMPLETED": (("running",), None),
    "SESSION_COMPLETED": (("running",), "completed"),
    "SESSION_INCOMPLETE": (("queued", "running"), "incomplete"),
    "BUDGET_EXHAUSTED": (("queued", "running"), "budget_exhausted"),
    "SESSION_CANCELLED": (("draft", "protocol_ready", "queued", "running"), "cancelled"),
}


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """Applies step(state, row) -> output row to each key's rows in order; the state lives from row to row of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        names = [f.strip().split()[0] for f in schema.split(",")]
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if now is None or row[key] != now:
                    now, state = row[key], start()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def session_step(state: dict, event: str, ordinal: int | None) -> str | None:
    """Moves a session's state on by one event; returns what forbids it, and then changes nothing."""
    allowed = EVENTS.get(event)
    if allowed is None or state["status"] not in allowed[0]:
        return "ILLEGAL_EVENT"
    if event == "TURN_STARTED":
        if ordinal != state["completed"] + 1:
            return "ORDINAL_GAP"
        state["current"] = ordinal
    elif event == "TURN_COMPLETED":
        if ordinal is None or ordinal != state["current"]:
            return "ORDINAL_MISMATCH"
        state["completed"], state["current"] = ordinal, None
    state["status"] = allowed[1] or state["status"]
    return None


def session_start() -> dict:
    return {"status": "draft", "completed": 0, "current": None, "dead": False}


def session_states(events: DataFrame, key: str, key_type: str = "long") -> DataFrame:
    """events (key, seq, event, ordinal) with the session's status after each and the first error, after which it stands still."""

    def step(state: dict, row: dict) -> dict:
        ordinal = None if pd.isna(row["ordinal"]) else int(row["ordinal"])
        error = "SESSION_FAILED" if state["dead"] else session_step(state, row["event"], ordinal)
        state["dead"] |= error is not None
        return {key: row[key], "seq": row["seq"], "event": row["event"], "status": state["status"], "completed_turns": state["completed"], "error": error}

    return fold(events.select(key, "seq", "event", "ordinal"), key, ["seq"], session_start, step, f"{key} {key_type}, seq long, event string, status string, completed_turns int, error string")


def admissions(requests: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """requests (key, id, credits) admitted in order while the key's `limit` credits last; a rejected one uses none."""

    def step(state: dict, row: dict) -> dict:
        ok = state["used"] + row["credits"] <= limit
        state["used"] += row["credits"] if ok else 0
        return {key: row[key], "id": row["id"], "credits": row["credits"], "admitted": bool(ok), "used": state["used"]}

    cols = dict.fromkeys([key, "id", "credits", *order])
    return fold(requests.select(*cols), key, order, lambda: {"used": 0}, step, f"{key} long, id long, credits long, admitted boolean, used long")


def decide(a: dict, history: dict, max_turns: int = 6, max_repairs: int = 2, stalled: int = 2) -> tuple[str, str]:
    """(action, reason) of one assessed turn; history is kept from turn to turn of a session.

    a: turn, proposed, quote (of a decision), quote_names_full, drift, full (fully supported candidates), plausible,
    signatures (set), unresolved and hard (lists of need ids).
    """
    fresh = set(a["signatures"]) - history["seen"]
    history["seen"] |= set(a["signatures"])
    history["idle"] = 0 if fresh else history["idle"] + 1
    needs = tuple((a["unresolved"] or a["hard"])[:2])
    if a["proposed"] == "finish" and a["quote"] and a["quote_names_full"] and not a["drift"]:
        action, reason = "finish", "decision_supported"
    elif history["idle"] >= stalled:
        action, reason = "stop", "no_progress"
    elif a["turn"] >= max_turns:
        action, reason = "stop", "turn_limit"
    elif a["drift"] or not a["plausible"]:
        action, reason = "explore", "unmet_needs"
    elif a["full"] >= 2:
        action, reason = "compare", "comparison_ready"
    else:
        action, reason = "verify", "unknown_evidence"
    if action == "explore":
        history["repairs"] += 1
        if history["repairs"] > max_repairs:
            action, reason = "stop", "no_progress"
    if action == "verify" and a["full"]:
        action, reason = "compare", "comparison_ready"
    if action == "verify" and not needs:
        action, reason = "stop", "no_progress"
    # the same check of the same needs, in any order, a third time in a row
    asked = (action, sorted(needs))
    if action in ("verify", "compare") and history["last"][-2:] == [asked] * 2:
        asked, action, reason = ("stop", asked[1]), "stop", "no_progress"
    history["last"].append(asked)
    del history["last"][:-2]
    return action, reason


def history_start() -> dict:
    return {"seen": set(), "idle": 0, "repairs": 0, "last": []}


def decisions(turns: DataFrame, key: str) -> DataFrame:
    """Controller decisions of assessed turns (key and the fields of decide(), lists as arrays), in order of turn; a session ends with finish or stop."""

    def step(state: dict, row: dict) -> dict:
        if state.get("over"):
            return {key: row[key], "turn": row["turn"], "action": None, "reason": "SESSION_OVER"}
        a = row | {k: list(row[k]) if row[k] is not None else [] for k in ("signatures", "unresolved", "hard")}
        action, reason = decide(a, state)
        state["over"] = action in ("finish", "stop")
        return {key: row[key], "turn": row["turn"], "action": action, "reason": reason}

    return fold(turns, key, ["turn"], history_start, step, f"{key} long, turn long, action string, reason string")
