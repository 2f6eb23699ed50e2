"""Value, tiers, folds, expiry, billing and telemetry on small cases."""

from __future__ import annotations

import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import memory, metering, telemetry

DAY = memory.DAY_MS


def test_event_effects_and_fold(spark):
    kinds = ["retrieved", "used_in_answer", "user_negative", "other", "used_in_answer", "used_in_answer", "used_in_answer", "user_negative"] * 4
    rows = [(m, i, i * DAY * (m + 1) // 3, k) for m in range(3) for i, k in enumerate(kinds)]
    table = spark.createDataFrame(rows, "memory_id long, event_id long, ms long, kind string")
    got = {r.memory_id: r.value for r in memory.fold_values(table).collect()}
    frame = pd.DataFrame(rows, columns=["memory_id", "event_id", "ms", "kind"])
    for m, part in frame.groupby("memory_id"):
        assert got[m] == pytest.approx(memory.fold_in_order(part), abs=1e-12)
    one = spark.createDataFrame([(1, 1, 0, "retrieved"), (2, 1, 0, "used_in_answer")], table.schema)
    assert {r.memory_id: round(r.value, 6) for r in memory.fold_values(one, start=0.4).collect()} == {1: 0.48, 2: 0.68}


def test_tiers_are_sticky(spark):
    rows = [("WARM", 0.71, False, "HOT"), ("HOT", 0.65, False, "HOT"), ("HOT", 0.61, False, "WARM"), ("WARM", 0.2, False, "COLD"), ("COLD", 0.45, False, "WARM"), ("HOT", 0.1, True, "HOT"), ("WARM", 0.1, True, "WARM"), ("COLD", 0.3, False, "COLD")]
    table = spark.createDataFrame(rows, "tier string, v double, pinned boolean, want string")
    assert table.filter(memory.next_tier(F.col("tier"), F.col("v"), F.col("pinned")) != F.col("want")).count() == 0


def test_decay_age_budget(spark):
    one = spark.range(1)
    assert one.select(memory.decayed(F.lit(0.8), F.lit(0), 2 * DAY).alias("v")).first().v == pytest.approx(0.8 * math.exp(-2 * math.log(2) / 30))
    young = lambda at, h: one.select(memory.too_young(F.lit(at).cast("long"), 48 * 3_600_000, h).alias("y")).first().y
    assert young(36 * 3_600_000, 24) and not young(0, 24) and not young(36 * 3_600_000, 0) and not young(None, 24)
    rows = spark.range(5)
    assert memory.within_budget(rows, 2, F.asc("id")).count() == 2 and memory.within_budget(rows, 0, F.asc("id")).count() == 5


def test_expiry_and_log(spark):
    log = spark.createDataFrame([(1, "a", "SET", "1", 100), (2, "a", "SET", "2", None), (3, "b", "SET", "x", 100), (4, "c", "SET", "y", 5), (5, "c", "DEL", None, None)], "seq long, key string, op string, value string, expires_ms long")
    live = {r.key: (r.value, r.ttl) for r in memory.unexpired(memory.last_writes(log), 100).select("key", "value", memory.remaining_ttl(100).alias("ttl")).collect()}
    assert live == {"a": ("2", None), "b": ("x", 1)}
    assert [r.key for r in memory.unexpired(memory.last_writes(log), 101).collect()] == ["a"]


def test_month_split_and_charges(spark):
    table = spark.createDataFrame([(datetime(2026, 3, 31, 23, 30), datetime(2026, 4, 1, 1, 0), 2), (datetime(2026, 1, 1), datetime(2026, 2, 1), 1), (datetime(2026, 1, 1), datetime(2026, 1, 1), 1)], "start timestamp_ntz, end timestamp_ntz, bytes long")
    got = [(r.month.month, r.seconds, r.byte_seconds) for r in metering.month_segments(table).orderBy("month").collect()]
    assert got == [(1, 2678400.0, 2678400.0), (3, 1800.0, 3600.0), (4, 3600.0, 7200.0)]
    one = spark.range(1)
    charge = metering.period_charge(F.lit(2.0 * metering.GIB * 100), F.lit(100), 1.5, 0.1)
    assert one.select(charge.alias("c")).first().c == 0.05
    cost = metering.usage_cost(F.lit(2 * metering.GIB), F.lit(1500), 0.1, 0.002)
    assert one.select(cost.alias("c")).first().c == 0.203


def test_percentiles_and_ring(spark):
    rows = [(1, i, i, float(i % 7 + 1), 500 if i % 10 == 0 else 200) for i in range(700)]
    table = spark.createDataFrame(rows, "k int, event_id int, ms int, latency double, status int")
    got = telemetry.latency_summary(table, ["k"]).first()
    kept = sorted(r[3] for r in rows[-500:])
    assert (got.n, got.errors, got.p95) == (700, 70, kept[math.ceil(0.95 * 500) - 1])
    bins = {r.bin: r.n for r in telemetry.histogram(table, "latency", 3).collect()}
    assert sum(bins.values()) == 700 and set(bins) == {0, 1, 2}
    same = spark.createDataFrame([(1.0,), (1.0,)], "latency double")
    assert [(r.bin, r.n) for r in telemetry.histogram(same, "latency").collect()] == [(0, 2)]


def test_used_ratio_is_sum_over_sum(spark):
    rows = [("r", "a", "retrieved", 1), ("r", "a", "retrieved", 2), ("r", "a", "used", 2), ("r", "a", "used", 9), ("r", "b", "retrieved", 3), ("r", "c", "used", 4)]
    table = spark.createDataFrame(rows, "run_id string, request_id string, kind string, memory_id int")
    got = telemetry.used_ratio(table).first()
    assert (got.requests, got.retrieved, got.used, got.ratio) == (2, 3, 1, 1 / 3)
