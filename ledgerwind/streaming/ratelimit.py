"""The request limit as a stateful stream, one log per client."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerwind import fixed_values as fv
from ledgerwind.operators.ratelimit import admit

RESULT = "event_id bigint, user_id bigint, at bigint, admitted boolean"
STATE = "log array<bigint>"


def limit_stream(requests: DataFrame, limit: int = fv.RATE_LIMIT_REQUESTS, seconds: int = fv.RATE_LIMIT_SECONDS) -> DataFrame:
    """Verdicts for a stream of ``(event_id, user_id, ts)``.

    The state of a client is its admitted times, at most ``limit`` of them, and
    is dropped once the client has been quiet for longer than the window.
    """
    span = seconds * 1_000_000

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(batches).sort_values(["at", "event_id"])
        rows["admitted"] = [admit(log, at, limit, span) for at in rows["at"]]
        state.update((list(log),))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield rows[["event_id", "user_id", "at", "admitted"]]

    timed = requests.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(
        judge, RESULT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
