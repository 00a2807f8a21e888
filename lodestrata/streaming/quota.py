"""Token buckets over a stream, with a state for each user."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def allowed(stream: DataFrame, most: int, refill_us: int, start_us: int) -> DataFrame:
    """stream: user_id, ts_us, event_id -> the same with allowed.

    The state is the window that a user's bucket is in and the tokens left; within a batch events go by time. An event of a window
    that is over takes from the bucket as it is now, as a clock that never goes back would have it.
    """

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, left = state.get if state.exists else (-1, most)
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        said: list[Any] = []
        for ts in rows["ts_us"].tolist():
            now = (ts - start_us) // refill_us
            if now > window:
                window, left = now, most
            said.append(left > 0)
            left -= left > 0
        state.update((window, left))
        yield rows.assign(allowed=said)[["user_id", "ts_us", "event_id", "allowed"]]

    return stream.select("user_id", "ts_us", "event_id").groupBy("user_id").applyInPandasWithState(each, "user_id long, ts_us long, event_id long, allowed boolean", "bucket long, left_over long", "append", GroupStateTimeout.NoTimeout)
