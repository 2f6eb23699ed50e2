"""The stored index: same candidates as whole buckets, a bounded number of rows met; scores ranked whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as V

PLANES = V.planes(8, 3, 2)
CAP = 15


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(f"v{i:04}", rng.normal(size=8).round(3).tolist()) for i in range(400)] + [(f"w{i:04}", [1.0] * 8) for i in range(300)]
    return spark.createDataFrame(rows, "id string, vec array<double>").repartition(4)


def by_whole_buckets(rows: dict, planes: list, vec: list[float], cap: int) -> list[str]:
    code = lambda v: [tuple(np.dot(p, v) >= 0 for p in t) for t in planes]
    codes, own, seen = {i: code(v) for i, v in rows.items()}, code(vec), {}
    for t in range(len(planes)):
        for i in sorted(rows):
            if codes[i][t] == own[t]:
                seen.setdefault(i, t)
    return sorted(seen, key=lambda i: (seen[i], i))[:cap]


@pytest.mark.parametrize("listed", [False, True])
def test_probe_equals_whole_buckets(spark, table, tmp_path, listed):
    index = V.write_lsh_index(table, PLANES, f"{tmp_path}/index")
    asked = table.filter("id LIKE '%00' OR id = 'w0001'").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    allowed = table.filter("id LIKE '%3' OR id LIKE '%7'").select("id") if listed else None
    got: dict[str, set] = {}
    for r in V.probe(index, asked, PLANES, CAP, allowed).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    rows = {r.id: r.vec for r in table.collect() if not listed or r.id[-1] in "37"}
    for r in asked.collect():
        assert got[r.query_id] == set(by_whole_buckets(rows, PLANES, r.query, CAP))


def test_a_bucket_meets_its_first_places_only(spark, table, tmp_path):
    index = V.write_lsh_index(table, PLANES, f"{tmp_path}/index")
    assert index.groupBy("table", "signature").agg(F.max("place").alias("m"), F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.max("bucket_rows").alias("b")).filter("m != n OR d != n OR b != n").count() == 0
    assert index.filter(f"place <= {CAP}").groupBy("table", "signature").count().agg(F.max("count")).first()[0] <= CAP
    assert "LessThanOrEqual(place" in index.filter(f"place <= {CAP}")._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [V.BROADCAST_BYTES, 8 * 8 * 40])
def test_whole_scores_rank(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BROADCAST_BYTES", block)
    monkeypatch.setattr(V, "PART_VECTORS", 16)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 20)
    rows = [(i, [1.0, i * 1e-8 * (-1) ** i, *[0.0] * 5, 0.5]) for i in range(100)] + [(200 + i, [1.0, *[0.0] * 6, 0.5]) for i in range(3)]
    table = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, [1.0, 1.0 + i, *[0.0] * 6]) for i in range(60)], "query_id long, query array<double>")
    got = V.exact_topk(table, queries, 4).orderBy("query_id", "rank").collect()
    for q in range(60):
        assert [r.id for r in got if r.query_id == q] == [98, 96, 94, 92]
    same = V.exact_topk(table, queries, 4, digits=5).filter("query_id = 0").orderBy("rank").collect()
    assert [r.id for r in same] == [0, 1, 2, 3]
