"""The latency ring as a stream equals the batch summary, also across a restart from its checkpoint."""

from __future__ import annotations

import random

import pytest

from tessera.operators import telemetry
from tessera.streaming.latency import STATE_STORE, latency_stream

SCHEMA = "tenant_id string, route string, ms long, event_id long, latency double, status int"


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["t1", "t2", None]), rng.choice(["a", "a", "a", "b"]), rng.randrange(10_000), i, float(rng.randrange(100)), rng.choice([200, 200, 500])) for i in range(900)]
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    latest: dict[tuple, tuple] = {}

    def keep(batch, _):
        latest.update({(r.level, r.tenant_id, r.route): tuple(r)[3:] for r in batch.collect()})

    for part in range(3):  # one file a run; each run starts from the checkpoint of the one before
        spark.createDataFrame(rows[part * 300 : part * 300 + 300], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = latency_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), n=50)
        query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(240)
    for k in STATE_STORE:
        spark.conf.unset(k)
    batch = telemetry.latency_levels(spark.createDataFrame(rows, SCHEMA), n=50)
    want = {(r.level, r.tenant_id, r.route): (r.n, r.errors, r.mean, r.p50, r.p90, r.p95, r.p99, r.error_rate) for r in batch.collect()}
    assert set(latest) == set(want)
    for k, own in want.items():
        assert latest[k] == pytest.approx(own), k
