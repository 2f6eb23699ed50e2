"""Usage, storage and billing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metering as B
from tessera.plans.base import query
from tessera.sources.tables import ITEMS_SQL, USAGE_SQL, items, load, usage

NOW = "2024-01-20 12:30:00"
_ROLL = "SELECT tenant_id, date_trunc('{0}', ts) AS bucket, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY ALL"


@query(f"WITH {USAGE_SQL} SELECT tenant_id, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY tenant_id")
def usage_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lifetime(usage(spark, sf_dir))


def _rolled(unit: str) -> str:
    return f"WITH {USAGE_SQL}, r AS ({_ROLL.format(unit)}) SELECT tenant_id, strftime(bucket, '%Y-%m-%d %H') AS bucket, requests, tokens FROM r"


@query(_rolled("hour"))
def usage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rollup(usage(spark, sf_dir), "hour").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


@query(_rolled("day"))
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rollup(usage(spark, sf_dir), "day").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


def _window(unit: str, span: str) -> str:
    return f"WITH {USAGE_SQL}, r AS ({_ROLL.format(unit)}) SELECT tenant_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM r WHERE bucket >= TIMESTAMP '{NOW}' - INTERVAL {span} GROUP BY tenant_id"


@query(_window("hour", "24 HOURS"))
def usage_window_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.window_totals(usage(spark, sf_dir), "24h", NOW)


@query(_window("day", "7 DAYS"))
def usage_window_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.window_totals(usage(spark, sf_dir), "7d", NOW)


@query(f"WITH {USAGE_SQL} SELECT tenant_id, CAST(sum(tokens) AS BIGINT) AS billable_tokens FROM usage WHERE billable AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS GROUP BY tenant_id")
def usage_billable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.billable_total(usage(spark, sf_dir), NOW, 7)


@query(f"WITH {USAGE_SQL} SELECT event_id, kind, tokens FROM usage WHERE tenant_id = 'tenant3' ORDER BY ts DESC, event_id DESC LIMIT 50")
def usage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.history(usage(spark, sf_dir), "tenant3").select("event_id", "kind", "tokens")


@query(f"WITH {ITEMS_SQL}, c AS (SELECT tenant_id, count(*) AS chunks, count(DISTINCT id) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, count(*) * 64 * 4 AS vector_bytes FROM items GROUP BY tenant_id) SELECT c.*, items, artifacts, metadata_bytes FROM c FULL JOIN (SELECT tenant_id, count(*) AS items, count(*) FILTER (WHERE item_type = 'artifact') AS artifacts, CAST(sum(strlen(metadata)) AS BIGINT) AS metadata_bytes FROM items GROUP BY tenant_id) i ON i.tenant_id = c.tenant_id")
def storage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir)
    return B.storage_snapshot(own.withColumn("doc_id", F.col("id")), own, 64)


_BINS = ", ".join(f"count(*) FILTER (WHERE value_score >= {a}::DOUBLE AND value_score < {b}::DOUBLE) AS value_{i}" for i, (a, b) in enumerate([(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0)]))


@query(f"WITH {ITEMS_SQL} SELECT tenant_id, count(*) AS items, sum(coalesce(try_cast(json_extract_string(metadata, '$._tokens_est') AS DOUBLE), 0)) AS tokens, count(*) FILTER (WHERE value_score IS NULL) AS value_none, {_BINS}, count(*) FILTER (WHERE value_score >= 1) AS value_top, count(*) FILTER (WHERE tier = 'HOT') AS hot, count(*) FILTER (WHERE tier = 'WARM') AS warm, count(*) FILTER (WHERE tier = 'COLD') AS cold FROM items GROUP BY tenant_id")
def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.state_snapshot(items(spark, sf_dir))


@query(f"WITH {ITEMS_SQL} SELECT item_type, count(*) AS n FROM items GROUP BY item_type")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counts_by(items(spark, sf_dir), "item_type")


_SEGMENTS = """i AS (SELECT o_orderkey AS id, o_orderdate AS s, o_orderdate + (o_orderkey % 100) * INTERVAL 1 DAY + INTERVAL 90 MINUTE AS e, CAST(round(o_totalprice) AS BIGINT) AS bytes FROM orders),
p AS (SELECT *, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS month FROM i),
g AS (SELECT id, strftime(month, '%Y-%m') AS month, epoch(least(e, month + INTERVAL 1 MONTH)) - epoch(greatest(s, month)) AS seconds, bytes FROM p WHERE least(e, month + INTERVAL 1 MONTH) > greatest(s, month))"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("o_orderdate + make_interval(0, 0, 0, int(o_orderkey % 100), 1, 30)").cast("timestamp_ntz")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), end.alias("end"), F.round("o_totalprice").cast("long").alias("bytes"))


@query(f"WITH {_SEGMENTS} SELECT month, count(*) AS parts, CAST(sum(seconds) AS DOUBLE) AS seconds, CAST(sum(seconds * bytes) AS DOUBLE) AS byte_seconds FROM g GROUP BY month")
def month_byte_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.month_segments(_intervals(spark, sf_dir))
    return parts.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("parts"), F.sum("seconds").alias("seconds"), F.sum("byte_seconds").alias("byte_seconds"))


@query(f"WITH {_SEGMENTS} SELECT month, round(greatest(0, CAST(sum(seconds * bytes) AS DOUBLE) / 2592000 / {B.GIB} - 0.5::DOUBLE) * 0.1::DOUBLE, 6) AS charge FROM g GROUP BY month")
def period_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.month_segments(_intervals(spark, sf_dir)).groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.sum("byte_seconds").alias("b"))
    return parts.select("month", B.period_charge(F.col("b"), F.lit(2592000), 0.5, 0.1).alias("charge"))


@query(f"WITH {USAGE_SQL} SELECT tenant_id, round(sum(tokens) * 1000.0::DOUBLE / {B.GIB} * 0.1::DOUBLE + sum(CASE WHEN billable THEN tokens ELSE 0 END) / 1000.0::DOUBLE * 0.002::DOUBLE, 6) AS cost FROM usage GROUP BY tenant_id")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = usage(spark, sf_dir).groupBy("tenant_id").agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("billable"), F.col("tokens")).otherwise(0)).alias("paid"))
    return t.select("tenant_id", B.usage_cost(F.col("all") * 1000, F.col("paid"), 0.1, 0.002).alias("cost"))
