"""Streams that hold rows back: the newest chunk of a run until it is still, and repeats of a start within a cool-down."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RELEASED = "run_id string, index long, why string, pending boolean"


def fresh() -> dict:
    return {"newest": None, "held": False, "upto": 0, "beyond": []}


def is_out(known: dict, index: int) -> bool:
    return index < known["upto"] or index in known["beyond"]


def put_out(known: dict, index: int) -> None:
    """Remember that a chunk has gone: all before ``upto`` have, and those listed beyond it."""
    known["beyond"] = sorted({*known["beyond"], index})
    while known["beyond"] and known["beyond"][0] == known["upto"]:
        known["upto"] = known["beyond"].pop(0) + 1


def arrived(known: dict, indices: list[int]) -> list[tuple[int, str]]:
    """Chunks that may go now that these have been written: each once, all but the newest of the run."""
    held = [known["newest"]] if known["held"] else []
    waiting = sorted({i for i in (*indices, *held) if i >= 0 and not is_out(known, i)})
    newest = max((*waiting, *([known["newest"]] if known["newest"] is not None else [])), default=None)
    out = [(i, "followed") for i in waiting if i < newest]
    for i, _ in out:
        put_out(known, i)
    known["newest"], known["held"] = newest, newest in waiting
    return out


def hold_newest(chunks: DataFrame, hold_ms: int = 250, idle_ms: int = 3_600_000) -> DataFrame:
    """(run_id, index, why, pending) of a stream of chunks (run_id, index), each written chunk once, as soon as it may be read.

    A chunk that a later one of its run follows goes at once ("followed"), the newest when nothing of its run has been written for
    ``hold_ms`` of processing time ("still"); pending tells whether the run holds one back after that.  A chunk written
    again restarts the wait if it is held and is left out if it has gone.  A run without a row for ``idle_ms`` is forgotten.

    Cases: rows without a run or index, or with a negative one, are left out; chunks may come in any order, also late and repeated.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else fresh()
        if state.hasTimedOut and not known["held"]:
            state.remove()
            return
        if state.hasTimedOut:
            out = [(known["newest"], "still")]
            put_out(known, known["newest"])
            known["held"] = False
        else:
            out = arrived(known, [int(i) for rows in batches for i in rows["index_"]])
        state.update((json.dumps(known),))
        state.setTimeoutDuration(hold_ms if known["held"] else idle_ms)
        yield pd.DataFrame([(key[0], i, why, known["held"]) for i, why in out], columns=["run_id", "index", "why", "pending"])

    rows = chunks.filter(F.col("run_id").isNotNull() & (F.col("index") >= 0)).select("run_id", F.col("index").cast("long").alias("index_"))
    return rows.groupBy("run_id").applyInPandasWithState(step, RELEASED, "known string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def cool_down(starts: DataFrame, seconds: float = 12.0, late: str = "10 minutes") -> DataFrame:
    """(key, at) of a stream of starts (key, at): those that no start of their key which was let through precedes by less than ``seconds``.

    Starts of a batch count in the order of their times.  A start older than one that was let through before is a repeat of it.  What is known
    of a key goes once the watermark is past its cool-down; starts behind the watermark are left out, as are those without a key or time.
    """
    wait = round(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get[0] if state.exists else None), []
        for at in sorted(t.value // 1_000 for rows in batches for t in rows["at"]):
            if last is None or at - last >= wait:
                last = at
                out.append(at)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + wait) // 1_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "at": pd.to_datetime(out, unit="us")})

    rows = starts.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late).select("key", "at")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
