"""W6, A9 as a stream: the last requests of each route, tenant, both and all, with counts and nearest-rank percentiles.

State is a list of at most `n` latencies and two counters a group. A group that has a large share of all requests is
reduced first, in each task, to its newest n requests and its counts, so that a hot route, or the level of all requests,
sends n rows per batch of a task to its state and not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.telemetry import POINTS

KEYS = ["level", "tenant_id", "route"]
#: The provider that lists and several state variables need; set it on the session that runs the stream.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def newest(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n newest by time, then id."""
    return rows.sort_values(["ms", "event_id"], kind="stable").iloc[-n:]


class LatencyRing(StatefulProcessor):
    """Keeps the newest n requests of a group and counts all of them; tells the group's figures after each batch."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "ms long, event_id long, latency double")
        self.total = handle.getValueState("total", "n long, errors long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        came = pd.concat(rows)
        held = pd.DataFrame(list(self.ring.get()), columns=["ms", "event_id", "latency"])
        fresh = came.loc[came["ms"].notna(), ["ms", "event_id", "latency"]]
        kept = newest(pd.concat([held, fresh]) if len(held) else fresh, self.n)
        count, errors = self.total.get() or (0, 0)
        count, errors = int(count + came["n"].sum()), int(errors + came["errors"].sum())
        self.ring.put([(int(r.ms), int(r.event_id), float(r.latency)) for r in kept.itertuples()])
        self.total.update((count, errors))
        values = sorted(kept["latency"])
        at = {f"p{round(p * 100)}": [values[max(0, ceil(round(p * 100) * len(values) / 100) - 1)] if values else None] for p in POINTS}
        mean = sum(values) / len(values) if values else None
        told = dict(zip(KEYS, ([x] for x in key), strict=True))
        yield pd.DataFrame({**told, "n": [count], "errors": [errors], "mean": [mean], **at, "error_rate": [errors / count if count else 0.0]})

    def close(self) -> None:
        """Nothing is held outside of the state."""


def latency_stream(requests: DataFrame, n: int = 500) -> DataFrame:
    """(tenant_id, route, ms, event_id, latency, status) -> figures of each group that a batch changed; use output mode update.

    level has bit 1 without the tenant and bit 0 without the route, as in telemetry.latency_levels. The ring is of the newest
    requests by (ms, event_id), whenever they arrive. Requests without a time or latency are counted and not ranked."""
    levels = [(0, "tenant_id", "route"), (1, "tenant_id", None), (2, None, "route"), (3, None, None)]
    named = [F.struct(F.lit(i).cast("long").alias("level"), *[(F.col(c) if c else F.lit(None).cast("string")).alias(k) for k, c in (("tenant_id", t), ("route", r))]) for i, t, r in levels]
    rows = requests.withColumn("k", F.explode(F.array(*named))).select("k.level", "k.tenant_id", "k.route", "ms", "event_id", "latency", F.lit(1).cast("long").alias("n"), (F.col("status") >= 500).cast("long").alias("errors"))
    schema = "level long, tenant_id string, route string, ms long, event_id long, latency double, n long, errors long"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, own in b.groupby(KEYS, dropna=False):
                ranked = newest(own[own["ms"].notna() & own["latency"].notna()], n)
                counted = own.iloc[:1].assign(ms=None, event_id=None, latency=None, n=len(own), errors=own["errors"].sum())
                yield pd.concat([ranked.assign(n=0, errors=0), counted])[list(b.columns)].astype({"ms": "Int64", "event_id": "Int64"})

    points = ", ".join(f"p{round(p * 100)} double" for p in POINTS)
    out = f"level long, tenant_id string, route string, n long, errors long, mean double, {points}, error_rate double"
    grouped = rows.mapInPandas(reduce, schema).groupBy(*KEYS)
    return grouped.transformWithStateInPandas(LatencyRing(n), out, "Update", "None")
