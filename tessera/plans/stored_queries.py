"""Stored tables: written, changed and read back; each agrees with the query that works all of it out anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import filter_queries, metering_queries  # noqa: F401  their SQL is the counterpart here
from tessera.plans.base import SQL, query
from tessera.sources.stored import KeyedTable, RollupStore, SortedTable
from tessera.sources.tables import items, usage
from tessera.storage import fresh_path


@query(SQL["upsert_items"])
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New titles for every item with twice an item's id, into a bucketed table of all items."""
    base = items(spark, sf_dir)
    table = KeyedTable(spark, fresh_path(spark, "items"), ["id"], 16)
    table.create(base.select("id", F.expr("'old' || id").alias("title"), "value_score", "tier", "created_ms"))
    table.upsert(base.select((F.col("id") * 2).alias("id"), F.expr("'new' || id").alias("title"), F.lit(0.0).alias("value_score"), F.lit("COLD").alias("tier"), (F.col("created_ms") + 1).alias("created_ms")), keep=["value_score", "tier", "created_ms"])
    return table.read()


@query(SQL["partial_update"])
def stored_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = items(spark, sf_dir).select("id", "tier")
    table = KeyedTable(spark, fresh_path(spark, "tiers"), ["id"], 16)
    table.create(base)
    table.update(base.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "COLD").alias("tier")))
    return table.read()


@query(SQL["keyset_page"])
def stored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of all items in key order, of which only the parts that hold it are read."""
    table = SortedTable(spark, fresh_path(spark, "pages"))
    table.create(items(spark, sf_dir).select("id", "title" if "title" in items(spark, sf_dir).columns else "tier"), 40)
    return table.page(100, 50).select("id")


def _store(spark: SparkSession, sf_dir: str) -> RollupStore:
    """All usage events in four batches, one of them twice, with a compaction between."""
    rows = usage(spark, sf_dir)
    store = RollupStore(spark, fresh_path(spark, "rollups"), ["tenant_id"], {"requests": F.count("*"), "tokens": F.sum("tokens")})
    for batch in (0, 1, 2, 1, 3):
        store.merge(rows.filter(F.pmod(F.col("event_id"), F.lit(4)) == batch), batch)
        if batch == 2:
            store.compact()
    return store


@query(SQL["usage_hourly"])
def stored_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).totals("hour").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


@query(SQL["usage_lifetime"])
def stored_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).totals("all").drop("bucket")
