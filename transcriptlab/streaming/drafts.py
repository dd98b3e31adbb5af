"""Drafts of a session as a stateful stream: what each draft keeps of the one before it.

Drafts (session, seq, text, event_time) give (session, seq, shared, stable, longest): the leading words that a draft shares
with the one before it, whether they are ``least`` or more, and the longest stable beginning so far.

Cases: drafts without a session, a number or a time are dropped; a null text is empty; a draft with a number that isn't above the
last one counted is dropped, so replays change nothing.  Drafts of one batch count in the order of their numbers.  State of a session
is its last draft and its longest stable beginning; it goes ``idle_ms`` after the last draft.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, seq long, shared int, stable boolean, longest string"
STATE = "seq long, text string, longest string"


def shared_words(before: list[str], now: list[str]) -> int:
    n = 0
    for a, b in zip(before, now):
        if a.lower() != b.lower():
            break
        n += 1
    return n


def stabilise(drafts: DataFrame, least: int = 3, late: str = "10 seconds", idle_ms: int = 600_000) -> DataFrame:
    """drafts: a stream; see above."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            seq, text, longest = state.get if state.exists else (-1, "", "")
            rows, last = pd.concat(list(batches)), 0
            for row in rows.sort_values("seq", kind="stable").itertuples(index=False):
                last = max(last, row.event_time.value // 1_000_000)
                if row.seq <= seq:
                    continue
                words = (row.text or "").split()
                n = shared_words(text.split(), words)
                if n >= least and n > len(longest.split()):
                    longest = " ".join(words[:n])
                out.append((key[0], row.seq, n, n >= least, longest))
                seq, text = int(row.seq), " ".join(words)
            state.update((seq, text, longest))
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "seq", "shared", "stable", "longest"])

    rows = drafts.filter("session IS NOT NULL AND seq IS NOT NULL AND event_time IS NOT NULL").withWatermark("event_time", late)
    rows = rows.selectExpr("session", "CAST(seq AS LONG) AS seq", "text", "event_time")
    return rows.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
