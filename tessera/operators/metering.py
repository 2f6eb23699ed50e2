"""Usage, storage and billing aggregates. Money is a double rounded to 6 decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 1 << 30


def lifetime(usage: DataFrame) -> DataFrame:
    """A4."""
    return usage.groupBy("tenant_id").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def rollup(usage: DataFrame, unit: str) -> DataFrame:
    """A5: totals of each tenant and hour or day."""
    return usage.groupBy("tenant_id", F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def window_totals(usage: DataFrame, window: str, now: str) -> DataFrame:
    """Totals over buckets that start within the window (aligned to buckets, not exact); unknown windows mean lifetime."""
    unit, span = {"24h": ("hour", "24 hours"), "7d": ("day", "7 days")}.get(window, (None, None))
    if unit is None:
        return lifetime(usage)
    recent = rollup(usage, unit).filter(F.col("bucket") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {span}"))
    return recent.groupBy("tenant_id").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))


def billable_total(usage: DataFrame, now: str, days: int) -> DataFrame:
    """Billable tokens within exact times."""
    since = F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {days} days")
    return usage.filter(F.col("billable") & (F.col("ts") >= since)).groupBy("tenant_id").agg(F.sum("tokens").alias("billable_tokens"))


def history(usage: DataFrame, tenant: str, limit: int = 50) -> DataFrame:
    """Newest first, at most 200."""
    return usage.filter(F.col("tenant_id") == tenant).orderBy(F.desc("ts"), F.desc("event_id")).limit(min(limit, 200))


def storage_snapshot(chunks: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """Bytes of text, vectors and items of each tenant."""
    c = chunks.groupBy("tenant_id").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.sum(F.octet_length("text")).cast("long").alias("text_bytes"))
    i = items.groupBy("tenant_id").agg(F.count("*").alias("items"), F.count_if(F.col("item_type") == "artifact").alias("artifacts"), F.sum(F.octet_length("metadata")).cast("long").alias("metadata_bytes"))
    return c.withColumn("vector_bytes", F.col("chunks") * dim * 4).join(i, "tenant_id", "full")


def state_snapshot(items: DataFrame) -> DataFrame:
    """Items, estimated tokens, and a histogram of values, by tenant."""
    estimate = F.coalesce(F.get_json_object("metadata", "$._tokens_est"), F.get_json_object("metadata", "$.tokens_est"))
    tokens = F.sum(F.when(estimate.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.expr("try_cast(coalesce(get_json_object(metadata, '$._tokens_est'), get_json_object(metadata, '$.tokens_est')) AS DOUBLE)")).otherwise(0.0))
    edges = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    v = F.col("value_score")
    bins = [F.count_if((v >= a) & (v < b)).alias(f"value_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    tiers = [F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("HOT", "WARM", "COLD")]
    return items.groupBy("tenant_id").agg(F.count("*").alias("items"), tokens.alias("tokens"), F.count_if(v.isNull()).alias("value_none"), *bins, F.count_if(v >= 1.0).alias("value_top"), *tiers)


def counts_by(items: DataFrame, column: str) -> DataFrame:
    return items.groupBy(column).agg(F.count("*").alias("n"))


def month_segments(intervals: DataFrame) -> DataFrame:
    """(start, end, bytes) intervals split at UTC months -> month, seconds, byte_seconds of each part."""
    months = F.sequence(F.date_trunc("month", "start").cast("timestamp_ntz"), F.col("end"), F.expr("INTERVAL 1 month"))
    parts = intervals.filter(F.col("end") > F.col("start")).withColumn("month", F.explode(months))
    low, high = F.greatest("start", "month"), F.least("end", F.expr("month + INTERVAL 1 month"))
    seconds = F.expr("timestampdiff(MICROSECOND, lo, hi)") / 1e6
    return parts.withColumn("lo", low).withColumn("hi", high).withColumn("seconds", seconds).filter("seconds > 0").withColumn("byte_seconds", F.col("seconds") * F.col("bytes")).drop("lo", "hi")


def period_charge(byte_seconds: Column, period_seconds: Column, included_gib: float, price: float) -> Column:
    """Average storage over the period, beyond what is included, at a price per GiB."""
    return F.round(F.greatest(F.lit(0.0), byte_seconds / period_seconds / GIB - included_gib) * price, 6)


def usage_cost(storage_bytes: Column, billable_tokens: Column, gib_price: float, token_price: float) -> Column:
    """Storage and billable tokens at their prices."""
    return F.round(storage_bytes / GIB * gib_price + billable_tokens / 1000 * token_price, 6)
