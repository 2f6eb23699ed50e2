"""The bit filter stops no key it holds, and nearly all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.bits import bit_filter, flagged


def test_filter(spark):
    rows = spark.range(50_000).select("id", F.xxhash64("id").alias("k"))
    held = rows.filter("id % 50 = 0").unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS BIGINT) AS k"))
    out = flagged(rows.withColumn("bits", F.lit("clash")), "k", bit_filter(held, "k"), "may")
    assert out.columns == ["id", "k", "bits", "may"]
    counts = {(r.inside, r.may): r["count"] for r in out.groupBy((F.col("id") % 50 == 0).alias("inside"), "may").count().collect()}
    assert counts[True, True] == 1000 and (True, False) not in counts and counts.get((False, True), 0) < 50


def test_edges(spark):
    edge = spark.createDataFrame([(x,) for x in (0, 1, -1, 7, 8, 32767, 32768, 2**63 - 1, -(2**63))], "k long")
    assert flagged(edge, "k", bit_filter(edge, "k"), "may").filter("may").count() == 9
    assert flagged(edge, "k", bit_filter(edge.limit(0), "k"), "may").filter("may").count() == 0
    assert flagged(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"), "k", bit_filter(edge, "k"), "may").filter("NOT may").count() == 1
