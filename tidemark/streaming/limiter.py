"""The sliding-window limiter as a stateful stream.

A key's state is the list of its accepted times within the window (at most ``limit``); a key that
is idle for a window is forgotten. Hits of one trigger are taken in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.limiter import LIMIT, WINDOW_MS, Limiter

OUTPUT = "key string, ts_ms bigint, id bigint, accepted boolean, retry_after int"
STATE = "kept array<bigint>"


def limit_stream(hits: DataFrame, limit: int = LIMIT, window: int = WINDOW_MS) -> DataFrame:
    """A stream of key, ts_ms, id to the same with accepted and retry_after."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Limiter(limit, window, [int(t) for t in state.get[0]] if state.exists else [])
        frame = pd.concat(list(frames)).sort_values(["ts_ms", "id"])
        out = [own.hit(int(t)) for t in frame["ts_ms"]]
        state.update((list(own.kept),))
        state.setTimeoutDuration(window + 1000)
        waits = pd.Series([w for _, w in out], index=frame.index, dtype="int32")
        yield pd.DataFrame({"key": key[0], "ts_ms": frame["ts_ms"], "id": frame["id"], "accepted": [a for a, _ in out], "retry_after": waits})

    return hits.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
