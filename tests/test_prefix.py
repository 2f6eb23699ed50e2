"""Slices, borders and selection against plain loops; one group with a third of all rows is many tasks."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import memory, prefix, telemetry


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(50), i, rng.choice([None, rng.randrange(9), rng.randrange(9)])) for i in range(1500)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "run string, ms long, event_id long, tokens long").repartition(3)


@pytest.mark.parametrize("slice_rows", [60, 10_000])
def test_running_sum_and_numbers(table, rows, slice_rows):
    got = {r.event_id: (r.running, r.i, r.n) for r in prefix.numbered(prefix.running_sum(table, ["run"], ["ms", "event_id"], "tokens", slice_rows=slice_rows), ["run"], ["ms", "event_id"], "i", "n", slice_rows).collect()}
    assert len(got) == len(rows)
    for run in {r[0] for r in rows}:
        own, total, seen = sorted((r for r in rows if r[0] == run), key=lambda r: r[1:3]), 0, False
        for i, r in enumerate(own):
            total, seen = total + (r[3] or 0), seen or r[3] is not None
            assert got[r[2]] == (total if seen else None, i + 1, len(own))


def test_a_hot_group_is_many_slices(table):
    slices = prefix.sliced(table, ["run"], ["ms", "event_id"], 50)
    per = slices.filter("run = 'hot'").groupBy("_slice").count().collect()
    assert len(per) > 8 and max(r["count"] for r in per) < 150
    edges = slices.filter("run = 'hot'").groupBy("_slice").agg(F.min(F.struct("ms", "event_id")).alias("lo"), F.max(F.struct("ms", "event_id")).alias("hi")).orderBy("_slice").collect()
    assert all(a.hi < b.lo for a, b in zip(edges, edges[1:], strict=False))


@pytest.mark.parametrize("slice_rows", [20])
def test_fold_in_slices_equals_the_loop(spark, slice_rows):
    rng = random.Random(2)
    kinds = ["retrieved", "used_in_answer", "user_positive", "user_negative", "viewed"]
    events = [(rng.choice([1, 1, 2, 3]), i, rng.randrange(40) * memory.DAY_MS // 4, rng.choice(kinds)) for i in range(400)] + [(4, 1000, 5, "retrieved"), (4, 1001, 10**13, "user_negative")]
    got = {r.memory_id: (r.events, r.value) for r in memory.fold_values(spark.createDataFrame(events, "memory_id long, event_id long, ms long, kind string"), slice_rows=slice_rows).collect()}
    for m, part in pd.DataFrame(events, columns=["memory_id", "event_id", "ms", "kind"]).groupby("memory_id"):
        assert got[m][0] == len(part) and got[m][1] == pytest.approx(memory.fold_in_order(part), abs=1e-12)


def test_percentiles_of_large_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=900), "huge": 10.0 ** rng.uniform(-300, 300, 400), "same": np.full(300, 2.5), "ties": rng.integers(0, 5, 500).astype(float), "signs": np.array([-1e300, 1e300] * 50), None: rng.exponential(size=200), "small": rng.normal(size=9)}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("none", None), ("normal", None)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(4)
    points = {"p50": 0.5, "p55": 0.55, "p90": 0.9, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    for linear in (False, True):
        got = {r.k: r for r in prefix.exact_percentiles(table, ["k"], "v", points, linear, large=50).collect()}
        assert set(got) == {*groups, "none"} and got["none"].p50 is None
        for k, own in groups.items():
            own = sorted(own)
            for name, p in points.items():
                if linear:
                    at = p * (len(own) - 1)
                    low, high = own[math.floor(at)], own[math.ceil(at)]
                    want = own[round(at)] if abs(at - round(at)) < 1e-9 else low + (at - math.floor(at)) * (high - low)
                else:
                    want = own[max(0, -(-round(p * 100) * len(own) // 100) - 1)]
                if math.isfinite(want):
                    assert got[k][name] == pytest.approx(want, rel=1e-9), (k, name, linear)
    whole = prefix.exact_percentiles(table, [], "v", {"p50": 0.5}, large=10).collect()
    assert [r.p50 for r in whole] == [sorted(v for _, v in rows if v is not None)[-(-(len(rows) - 2) // 2) - 1]]


def test_tail_curve_of_one_run(spark):
    table = spark.createDataFrame([("r", i, float(i * 7 % 50)) for i in range(300)], "run string, event_id long, latency double")
    got = telemetry.tail_curve(table, "run", "latency", slice_rows=50).orderBy("latency", "event_id").collect()
    assert [r.ecdf for r in got] == pytest.approx([(i + 1) / 300 for i in range(300)])
    assert all(r.ccdf == pytest.approx(1 - r.ecdf) for r in got)
