"""Stored tables: what an upsert leaves alone, what a page reads, and batches that count once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.stored import KeyedTable, RollupStore, SortedTable


def scans(plan):
    leaves = plan.collectLeaves()
    return [leaf for leaf in (leaves.apply(i) for i in range(leaves.size())) if leaf.metrics().contains("numFiles")]


def files_of(spark, path):
    return {r[0]: r[1] for r in spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], 16)
    table.create(spark.range(400).select("id", F.lit("old").alias("title"), F.col("id").alias("made")))
    before = files_of(spark, table.path)
    batch = spark.createDataFrame([(7, "first", 1, 1), (7, "second", 2, 2), (9999, "added", 3, 3)], "id long, title string, made long, seq long")
    table.upsert(batch, keep=["made"], order="seq")
    got = {r.id: (r.title, r.made) for r in table.read().collect()}
    assert len(got) == 401 and got[7] == ("second", 7) and got[9999] == ("added", 3) and got[8] == ("old", 8)
    after = files_of(spark, table.path)
    kept = {name for name, at in before.items() if after.get(name) == at}
    assert 14 <= len(kept) < len(before)
    table.upsert(batch, keep=["made"], order="seq")  # again: the same table
    assert {r.id: (r.title, r.made) for r in table.read().collect()} == got
    table.update(spark.createDataFrame([(7, None, 70), (12345, "x", 1)], "id long, title string, made long"))
    got = {r.id: (r.title, r.made) for r in table.read().collect()}
    assert got[7] == ("second", 70) and 12345 not in got and len(got) == 401
    table.upsert(batch.limit(0).drop("seq"))
    assert table.read().count() == 401


@pytest.mark.parametrize("after", [None, -1, 0, 99, 101, 397, 5000])
def test_pages(spark, tmp_path, after):
    ids = [i * 3 for i in range(200)]
    random.Random(0).shuffle(ids)
    table = SortedTable(spark, f"{tmp_path}/s")
    table.create(spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string"), 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = table.page(after, 25)._jdf.queryExecution()
    assert [r.getLong(0) for r in plan.executedPlan().executeCollectPublic()] == sorted(i for i in ids if after is None or i > after)[:25]
    spark.conf.unset("spark.sql.adaptive.enabled")
    files = [leaf.metrics().apply("numFiles").value() for leaf in scans(plan.executedPlan())]
    assert sum(files) <= 4  # of ten


@pytest.mark.parametrize("folder_rows", [100_000, 70])
def test_folders_of_a_sorted_table_do_not_grow_with_its_parts(spark, tmp_path, monkeypatch, folder_rows):
    monkeypatch.setattr("tessera.sources.stored.FOLDER_ROWS", folder_rows)
    ids = [i * 3 for i in range(400)]
    random.Random(1).shuffle(ids)
    table = SortedTable(spark, f"{tmp_path}/s")
    table.create(spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string"), 4)
    folders = [p for p in (tmp_path / "s/rows").iterdir() if p.is_dir()]
    assert len(folders) <= -(-400 // folder_rows)
    fences = spark.read.parquet(f"{table.path}/fences").orderBy("low").collect()
    assert len(fences) >= 100 and max(f.n for f in fences) == 4 and sum(f.n for f in fences) == 400
    assert all(a.high < b.low for a, b in zip(fences, fences[1:], strict=False))
    for after, limit in [(None, 9), (None, 1000), (0, 1), (200, 150), (1190, 20), (1197, 5)]:
        got = [(r.id, r.t) for r in table.page(after, limit).collect()]
        assert got == [(i, f"t{i}") for i in sorted(ids) if after is None or i > after][:limit]


def test_batches_count_once_in_any_split(spark, tmp_path):
    rows = [("t%d" % (i % 3), f"2024-01-0{1 + i % 2} {i % 24:02}:10:00", i) for i in range(120)]
    events = spark.createDataFrame(rows, "tenant_id string, ts string, tokens long").withColumn("ts", F.to_timestamp("ts"))
    want = {}
    for kind in ("hour", "day"):
        want[kind] = {tuple(r) for r in events.groupBy("tenant_id", F.date_trunc(kind, "ts").alias("bucket")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    store = RollupStore(spark, f"{tmp_path}/r", ["tenant_id"], {"n": F.count("*"), "tokens": F.sum("tokens")})
    with pytest.raises(ValueError, match="no batch"):
        store.totals("hour")
    for step, batch in enumerate((0, 1, 0, 2, 1, 2, 0)):  # replayed before and after compactions
        store.merge(events.filter(F.col("tokens") % 3 == batch), batch)
        if step in (2, 5):
            store.compact()
            store.compact()
    for kind in ("hour", "day"):
        assert {tuple(r) for r in store.totals(kind).collect()} == want[kind]
    assert {(r.tenant_id, r.n, r.tokens) for r in store.totals("all").collect()} == {(f"t{k}", 40, sum(range(k, 120, 3))) for k in range(3)}
