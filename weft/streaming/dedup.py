"""Sliding time-to-live deduplication of streams.

State is one timestamp a key and goes once the watermark has passed its time to
live, so it is as large as the keys active within that time. Newness and expiry
are both judged by event time, so a replay at any speed gives what a batch gives.
A row later than ``late`` is still judged if its key is held, and new otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_dedup(rows: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """``keys, tie, ts, is_new`` for each row of a stream; repeats renew their key's time."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*keys, tie, ts]
    out = ", ".join([*(f"{n} {types[n]}" for n in names), "is_new boolean"])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(parts)).sort_values([ts, tie])
        at = (batch[ts] - pd.Timestamp(0)).dt.total_seconds().tolist()
        fresh = []
        for now in at:
            fresh.append(last is None or now - last > ttl_seconds)
            last = now if last is None else max(last, now)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield batch[names].assign(is_new=fresh)

    timed = rows.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(*keys).applyInPandasWithState(step, out, "last double", "append", GroupStateTimeout.EventTimeTimeout)
