"""Dictation sessions as a stateful stream: chunks come in any order, and a finished session is decided once.

Events (session, kind, index, text, reason, event_time), of kinds

* ``start``: a session begins anew; what was known under its name goes;
* ``chunk``: chunk ``index`` is being recognised; ``done``: it has become ``text``, and ``reason``, if given, makes the session
  risky for good;
* ``finish``: no more chunks come; ``cancel``: the session goes without a result.

A finished session is decided as ``clean`` at once where nothing made it risky, as ``complete`` once no chunk is
pending, or as ``late`` when its deadline, in event time, passes; then its text is that of the chunks that are done.

Cases: events of an unknown kind, without a session, or without a time are dropped; a chunk that is done twice keeps its
last text; a null text is empty; events after the decision begin a session of their own.  Events of one batch
count in the order of their times, of equal times in the order of kinds above.  State of a session is its chunk texts; it goes with the decision, or
``idle`` after its last event if no ``finish`` comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("start", "chunk", "done", "finish", "cancel")
OUT = "session string, outcome string, reasons string, chunks int, text string"


def decided(session: str, known: dict, outcome: str) -> dict:
    parts = {int(i): t for i, t in known["parts"].items()}
    return {"session": session, "outcome": outcome, "reasons": ",".join(sorted(known["reasons"])), "chunks": len(parts), "text": " ".join(parts[i] for i in sorted(parts) if parts[i])}


def fresh() -> dict:
    return {"pending": [], "parts": {}, "reasons": [], "deadline": None, "seen": 0}


def apply(known: dict | None, event, wait_ms: int) -> tuple[dict | None, str | None]:
    """What is known after an event, and the outcome if it decides the session."""
    if event.kind == "cancel":
        return None, None
    now = event.event_time.value // 1_000_000
    known = fresh() if event.kind == "start" or known is None else known
    known["seen"] = max(known["seen"], now)
    index = "0" if pd.isna(event.index_) else str(int(event.index_))
    if event.kind == "chunk" and index not in known["parts"] and index not in known["pending"]:
        known["pending"].append(index)
    elif event.kind == "done":
        known["pending"] = [i for i in known["pending"] if i != index]
        known["parts"][index] = "" if pd.isna(event.text) else event.text
        if not pd.isna(event.reason) and event.reason not in known["reasons"]:
            known["reasons"].append(event.reason)
    elif event.kind == "finish":
        known["deadline"] = now + wait_ms
    if known["deadline"] is None:
        return known, None
    return known, "clean" if not known["reasons"] else None if known["pending"] else "complete"


def finish_sessions(events: DataFrame, late: str = "10 seconds", wait_ms: int = 5_000, idle_ms: int = 3_600_000) -> DataFrame:
    """(session, outcome, reasons, chunks, text), a row for each decided session.  events: a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, out = (json.loads(state.get[0]) if state.exists else None), []
        if state.hasTimedOut:
            if known["deadline"] is not None:
                out.append(decided(key[0], known, "late"))
            state.remove()
        else:
            rows = pd.concat(list(batches))
            rows = rows.assign(place=rows["kind"].map(KINDS.index)).sort_values(["event_time", "place", "index_"], kind="stable")
            for event in rows.itertuples(index=False):
                known, outcome = apply(known, event, wait_ms)
                if outcome:
                    out.append(decided(key[0], known, outcome))
                    known = None
            if known is not None:
                state.update((json.dumps(known),))
                due = known["deadline"] if known["deadline"] is not None else known["seen"] + idle_ms
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["session", "outcome", "reasons", "chunks", "text"])

    rows = events.filter(F.col("kind").isin(*KINDS) & F.col("session").isNotNull() & F.col("event_time").isNotNull())
    rows = rows.withWatermark("event_time", late).select("session", "kind", F.col("index").alias("index_"), "text", "reason", "event_time")
    return rows.groupBy("session").applyInPandasWithState(step, OUT, "known string", "append", GroupStateTimeout.EventTimeTimeout)
