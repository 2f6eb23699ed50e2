"""Structured Streaming forms of what the service does continuously.

Late data is this library's own decision: a watermark of one hour unless told otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.memory import event_effect

LATE = "1 hour"


def rollup_stream(usage: DataFrame, unit: str = "1 hour", late: str = LATE) -> DataFrame:
    """A5: tokens and requests of each tenant and time bucket."""
    return usage.withWatermark("ts", late).groupBy(F.window("ts", unit).alias("w"), "tenant_id").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select("tenant_id", F.col("w.start").alias("bucket"), "requests", "tokens")


def first_writes(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Idempotent writes: the first of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def expiring(entries: DataFrame, late: str = LATE) -> DataFrame:
    """K2: (key, value, ts, ttl_s) -> (key, state): 'set' at each write, 'expired' once the watermark has passed its end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "state": ["expired"]})
            return
        last = pd.concat(batches).sort_values("ts").iloc[-1]
        at = int(last["ts"].timestamp() * 1_000_000)
        if state.exists and state.get[1] > at:
            return  # a late, older write changes nothing
        state.update((str(last["value"]), at))
        if pd.notna(last["ttl_s"]):
            end = int(last["ts"].timestamp() * 1000 + last["ttl_s"] * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "state": ["set"]})

    keyed = entries.withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(step, "key string, state string", "value string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def value_stream(events: DataFrame, start: float = 0.5) -> DataFrame:
    """M5: the running value of each memory item; a batch's events are taken in order of time."""
    import math

    from tessera.operators.memory import DAY_MS, DECAY, MOST

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (start, -1)
        for r in pd.concat(batches).sort_values(["ms", "event_id"]).itertuples():
            if last >= 0:
                value *= math.exp(-DECAY * max(0, r.ms - last) / DAY_MS)
            value, last = min(MOST, max(0.0, value + event_effect(r.kind))), max(last, r.ms)
        state.update((float(value), int(last)))
        yield pd.DataFrame({"memory_id": [key[0]], "value": [value]})

    return events.groupBy("memory_id").applyInPandasWithState(step, "memory_id long, value double", "value double, ms long", "update", GroupStateTimeout.NoTimeout)


def latest_table(batch: DataFrame, table: DataFrame | None) -> DataFrame:
    """K4: replay in foreachBatch: the last write of each key over what was there."""
    rows = batch if table is None else table.unionByName(batch)
    return rows.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w")).select("key", "w.*")
