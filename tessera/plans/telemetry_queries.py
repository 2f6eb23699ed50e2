"""Telemetry queries; requests are the events, with latency, status and route derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import telemetry as T
from tessera.plans.base import query
from tessera.sources.tables import load

COLUMNS = {
    "event_id": "event_id",
    "run_id": "'run' || (user_id % 5)",
    "tenant_id": "'tenant' || (user_id % 7)",
    "route": "event_type",
    "event_type": "event_type",
    "latency": "round(value, 3)",
    "status": "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END",
    "seed": "user_id % 3",
    "request_id": "event_id // 8",
    "memory_id": "user_id",
    "kind": "CASE WHEN event_type IN ('view', 'click') THEN 'retrieved' ELSE 'used' END",
}
R = f"r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMNS.items())}, (epoch_us(ts) // 1000) AS ms FROM events)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = COLUMNS | {"ms": "unix_millis(CAST(ts AS TIMESTAMP))", "request_id": "event_id div 8"}
    return load(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


_POINTS = ", ".join(f"round(quantile_disc(latency, {p}) FILTER (WHERE n <= 500), 6) AS p{round(p * 100)}" for p in T.POINTS)


@query(f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, route ORDER BY ms DESC, event_id DESC) AS n FROM r) SELECT tenant_id, route, count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors, round(avg(latency) FILTER (WHERE n <= 500), 6) AS mean, {_POINTS}, round(count(*) FILTER (WHERE status >= 500) / count(*), 6) AS error_rate FROM k GROUP BY tenant_id, route")
def latency_last500(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.latency_summary(_requests(spark, sf_dir), ["tenant_id", "route"])
    return out.select("tenant_id", "route", "n", "errors", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p95", "p99", "error_rate")])


def _level(level: int, keys: str, columns: str) -> str:
    ranked = f"SELECT *, row_number() OVER ({keys and 'PARTITION BY ' + keys} ORDER BY ms DESC, event_id DESC) AS n FROM r"
    return f"SELECT {columns}, {level}::BIGINT AS level, count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors, round(avg(latency) FILTER (WHERE n <= 500), 6) AS mean, {_POINTS}, round(count(*) FILTER (WHERE status >= 500) / count(*), 6) AS error_rate FROM ({ranked}) {keys and 'GROUP BY ' + keys}"


_LEVELS = [(0, "tenant_id, route", "tenant_id, route"), (1, "tenant_id", "tenant_id, NULL AS route"), (2, "route", "NULL AS tenant_id, route"), (3, "", "NULL AS tenant_id, NULL AS route")]


@query(f"WITH {R} " + " UNION ALL ".join(_level(*x) for x in _LEVELS))
def latency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.latency_levels(_requests(spark, sf_dir))
    return out.select("tenant_id", "route", "level", "n", "errors", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p95", "p99", "error_rate")])


@query(f"WITH {R} SELECT route, round(quantile_disc(latency, 0.5), 6) AS p50, round(quantile_disc(latency, 0.95), 6) AS p95 FROM r GROUP BY route")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.percentiles(_requests(spark, sf_dir), ["route"], "latency", (0.5, 0.95)).select("route", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(f"WITH {R} SELECT route, round(quantile_cont(latency, 0.5), 5) AS p50, round(quantile_cont(latency, 0.95), 5) AS p95 FROM r GROUP BY route")
def latency_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.percentiles(_requests(spark, sf_dir), ["route"], "latency", (0.5, 0.95), by_rank=False).select("route", F.round("p50", 5).alias("p50"), F.round("p95", 5).alias("p95"))


@query(f"WITH {R} SELECT round(quantile_disc(latency, 0.5), 6) AS p50, round(quantile_disc(latency, 0.9), 6) AS p90, round(quantile_disc(latency, 0.95), 6) AS p95, round(quantile_disc(latency, 0.99), 6) AS p99 FROM r")
def latency_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests as one group, whose ranks are selected in rounds and not sorted for."""
    return T.percentiles(_requests(spark, sf_dir), [], "latency", large=0).select(*[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")])


@query(f"WITH {R}, e AS (SELECT min(latency) AS lo, max(latency) AS hi FROM r) SELECT CAST(CASE WHEN hi > lo THEN least(15, floor((latency - lo) / ((hi - lo) / 16))) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM r, e GROUP BY 1")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.histogram(_requests(spark, sf_dir), "latency")


@query(f"WITH {R} SELECT run_id, event_id, latency, round(row_number() OVER w / count(*) OVER (PARTITION BY run_id), 6) AS ecdf, round(1 - row_number() OVER w / count(*) OVER (PARTITION BY run_id), 6) AS ccdf FROM r WINDOW w AS (PARTITION BY run_id ORDER BY latency, event_id)")
def latency_ccdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tail_curve(_requests(spark, sf_dir), "run_id", "latency").withColumn("ecdf", F.round("ecdf", 6)).withColumn("ccdf", F.round("ccdf", 6))


@query(f"WITH {R}, b AS (SELECT run_id, ms // 60000 AS bin, count(*) AS n FROM r GROUP BY ALL) SELECT bin, round(avg(n), 6) AS mean, count(*) AS runs FROM b GROUP BY bin")
def throughput_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.throughput(_requests(spark, sf_dir), "run_id").withColumn("mean", F.round("mean", 6))


@query(f"WITH {R}, b AS (SELECT run_id, ms // 60000 AS minute, avg(latency) AS m FROM r GROUP BY ALL) SELECT minute, round(avg(m), 5) AS mean FROM b GROUP BY minute")
def minute_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.binned_means(_requests(spark, sf_dir), "run_id", "latency").withColumn("mean", F.round("mean", 5))


@query(f"WITH {R} SELECT run_id, count(*) AS requests, round(avg(CASE WHEN status < 500 THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(avg(CASE WHEN latency > 100 THEN 1.0::DOUBLE ELSE 0 END), 6) AS slow, round(count(*) / ((max(ms) - min(ms)) / 1000), 6) AS per_second, round(quantile_disc(latency, 0.95) FILTER (WHERE latency > 0), 6) AS p95, round(quantile_cont(latency, 0.5) FILTER (WHERE latency > 0), 5) AS median FROM r GROUP BY run_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.run_summary(_requests(spark, sf_dir), "run_id")
    return out.select("run_id", "requests", *[F.round(c, 6).alias(c) for c in ("success_rate", "slow", "per_second", "p95")], F.round("median", 5).alias("median"))


@query(f"WITH {R} SELECT run_id, route, count(DISTINCT seed) AS seeds, round(avg(latency), 3) AS latency_mean, round(stddev_samp(latency), 3) AS latency_std, min(latency) AS latency_min, max(latency) AS latency_max FROM r GROUP BY run_id, route")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.group_stats(_requests(spark, sf_dir), ["run_id", "route"], ["latency"], "seed").withColumn("latency_mean", F.round("latency_mean", 3)).withColumn("latency_std", F.round("latency_std", 3))


@query(f"WITH {R} SELECT run_id, event_id, CAST(sum(CAST(round(latency) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM r")
def token_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_tokens(_requests(spark, sf_dir).withColumn("tokens", F.round("latency").cast("long")), "run_id", "tokens")


@query(f"WITH {R}, s AS (SELECT run_id, request_id, coalesce(list(DISTINCT memory_id) FILTER (WHERE kind = 'retrieved'), []) AS got, coalesce(list(DISTINCT memory_id) FILTER (WHERE kind = 'used'), []) AS used FROM r GROUP BY ALL) SELECT run_id, count(*) AS requests, CAST(sum(len(got)) AS BIGINT) AS retrieved, CAST(sum(len(list_intersect(got, used))) AS BIGINT) AS used, round(sum(len(list_intersect(got, used))) / sum(len(got)), 6) AS ratio FROM s WHERE len(got) > 0 GROUP BY run_id")
def retrieval_used_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.used_ratio(_requests(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT 'writes' AS "check", count(*) FILTER (WHERE event_type = 'purchase') AS n, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') >= 100 THEN 'PASS' ELSE 'FAIL' END AS result FROM events
UNION ALL SELECT 'asks', count(*) FILTER (WHERE event_type = 'view'), CASE WHEN count(*) FILTER (WHERE event_type = 'view') >= 1000000000 THEN 'PASS' ELSE 'FAIL' END FROM events""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.acceptance(_requests(spark, sf_dir), {"writes": ("purchase", 100), "asks": ("view", 1_000_000_000)})


@query("SELECT page_id, CASE WHEN split_part(url, '?', 1) LIKE '%/ask' THEN 'ask' WHEN split_part(url, '?', 1) LIKE '%/search' THEN 'search' WHEN split_part(url, '?', 1) LIKE '%/docs%' THEN 'docs' WHEN split_part(url, '?', 1) LIKE '%/memory%' THEN 'memory' ELSE 'other' END AS endpoint FROM pages")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.endpoint(F.col("url")).alias("endpoint"))


RECORDS = {
    "config_id": "'c' || (user_id % 3)", "run_id": "'r' || (user_id % 5)", "event_id": "event_id",
    "kind": "CASE event_id % 6 WHEN 0 THEN 'latency' WHEN 1 THEN 'tokens' WHEN 2 THEN 'prompt' WHEN 3 THEN 'lifecycle' WHEN 4 THEN 'proxy' ELSE 'snapshot' END",
    "latency_ms": "round(value, 3)", "token_kind": "CASE WHEN user_id % 2 = 0 THEN 'embedding' ELSE 'generation' END", "amount": "CAST(round(value) AS BIGINT)",
    "action": "CASE event_type WHEN 'view' THEN 'retain' WHEN 'click' THEN 'promote' WHEN 'error' THEN 'delete' ELSE 'compact' END",
    "retrieved": "event_id % 20", "used": "event_id % 20 // 2", "items": "event_id % 1000",
}
_RECORDS = f"t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RECORDS.items())}, (epoch_us(ts) // 1000) AS ms FROM events)"
_LATENCY = "coalesce(round(avg(latency_ms) FILTER (WHERE kind = 'latency' AND latency_ms > 0), 6), 0) AS latency_avg_ms, " + ", ".join(f"coalesce(round(quantile_cont(latency_ms, {p}) FILTER (WHERE kind = 'latency' AND latency_ms > 0), 5), 0) AS latency_p{round(p * 100)}_ms" for p in T.POINTS)
_SUM = "CAST(coalesce(sum({0}) FILTER (WHERE {1}), 0) AS BIGINT)"
_RUNS = f"""SELECT config_id, run_id, config_id || '::' || run_id AS run_key, count(*) FILTER (WHERE kind = 'latency') AS request_count, {_LATENCY},
{_SUM.format("amount", "kind = 'tokens'")} AS tokens_total, {_SUM.format("amount", "kind = 'tokens' AND token_kind = 'embedding'")} AS tokens_embedding, {_SUM.format("amount", "kind = 'tokens' AND token_kind = 'generation'")} AS tokens_generation,
count(*) FILTER (WHERE kind = 'prompt') AS prompts_count, coalesce(round(avg(amount) FILTER (WHERE kind = 'prompt'), 6), 0) AS prompt_tokens_est_avg, {", ".join(f"count(*) FILTER (WHERE kind = 'lifecycle' AND action = '{a}') AS lifecycle_{a}" for a in ("delete", "compact", "promote", "retain"))},
count(*) FILTER (WHERE kind = 'proxy') AS retrieval_requests, {_SUM.format("retrieved", "kind = 'proxy'")} AS retrieved_total, {_SUM.format("used", "kind = 'proxy'")} AS used_total,
coalesce(last(items ORDER BY ms, event_id) FILTER (WHERE kind = 'snapshot'), 0) AS final_memory_items, coalesce(last(amount ORDER BY ms, event_id) FILTER (WHERE kind = 'snapshot'), 0) AS final_memory_tokens_est FROM t GROUP BY config_id, run_id"""
_RATIO = "CASE WHEN retrieved_total > 0 THEN round(used_total / retrieved_total, 6) ELSE 0 END AS retrieval_used_ratio"
_SUMMED = ["request_count", "tokens_total", "tokens_embedding", "tokens_generation", "lifecycle_delete", "lifecycle_compact", "lifecycle_promote", "lifecycle_retain", "retrieved_total", "used_total"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = RECORDS | {"ms": "unix_millis(CAST(ts AS TIMESTAMP))", "used": "event_id % 20 div 2"}
    return load(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _rounded(df: DataFrame) -> DataFrame:
    places = lambda c: 5 if "_p" in c and c.startswith("latency") else 6
    return df.select(*[F.round(c, places(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_RECORDS}, r AS ({_RUNS}) SELECT *, {_RATIO} FROM r")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.run_report(_records(spark, sf_dir)))


@query(f"WITH {_RECORDS}, r AS ({_RUNS}), l AS (SELECT config_id, {_LATENCY} FROM t GROUP BY config_id), c AS (SELECT config_id, count(*) AS run_count, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMMED)}, round(avg(final_memory_items), 6) AS final_memory_items_avg, round(avg(final_memory_tokens_est), 6) AS final_memory_tokens_est_avg FROM r GROUP BY config_id) SELECT *, {_RATIO} FROM c JOIN l USING (config_id)")
def config_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(T.config_report(_records(spark, sf_dir)))
