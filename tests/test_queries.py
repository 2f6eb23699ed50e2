"""Every registered query with an SQL counterpart agrees with DuckDB; the others give rows of a stable schema."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if not n.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(value(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 25  # 5 of 500 vectors ask


def test_registry_stands_without_the_training_subpackage(monkeypatch):
    import importlib

    real = importlib.import_module

    def gone(name, *args):
        if name.startswith(("tessera.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert "vec_topk_exact" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
