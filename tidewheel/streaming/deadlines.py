"""Deadlines of claims and executions as event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key bigint, outcome string, deadline timestamp"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        deadline = pd.Timestamp(state.get[0], unit="ms")
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "outcome": ["EXPIRED"], "deadline": [deadline]})
        return
    rows = pd.concat(list(frames)).sort_values("at")
    last = rows.iloc[-1]
    if last["op"] == "done":
        if state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]], "outcome": ["DONE"], "deadline": [last["deadline"]]})
        return
    due = int(last["deadline"].timestamp() * 1000)
    state.update((due,))
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def expire(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Events (key, at, op, deadline): a key that is not ``done`` when the watermark passes its last deadline expires.

    A later event of a key, such as a heartbeat, moves its deadline; state is one number for each open key.
    """
    return events.withWatermark("at", late).groupBy("key").applyInPandasWithState(_step, OUT, "due bigint", "append", GroupStateTimeout.EventTimeTimeout)
