"""Telemetry summaries over request events.

Percentiles come in two definitions: nearest rank (percentile_disc) and linear interpolation (percentile).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import SLICE_ROWS, exact_percentiles, numbered, running_sum

POINTS = (0.5, 0.9, 0.95, 0.99)


def nearest_rank(column: str, p: float) -> Column:
    """A10: the value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def linear(column: str, p: float) -> Column:
    return F.percentile(column, p)


def percentiles(requests: DataFrame, keys: list[str], column: str, points: tuple[float, ...] = POINTS, by_rank: bool = True, **limits: int) -> DataFrame:
    """A10: keys and p50, p90, ... over all requests, by nearest rank or interpolated; no group is too large for it."""
    return exact_percentiles(requests, keys, column, {f"p{round(p * 100)}": p for p in points}, linear=not by_rank, **limits)


def last_values(requests: DataFrame, keys: list[str], n: int = 500) -> DataFrame:
    """The newest n rows of each group. The filter on the rank lets every task drop the rest before anything moves."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("ms"), F.desc("event_id"))
    return requests.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def latency_summary(requests: DataFrame, keys: list[str], n: int = 500) -> DataFrame:
    """Counts over all requests, average and percentiles over the last n. No keys: one row, also of no requests."""
    points = [nearest_rank("latency", p).alias(f"p{round(p * 100)}") for p in POINTS]
    names = [F.col(k).alias(f"_{k}") for k in keys]
    counts = requests.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("errors"))
    kept = last_values(requests, keys, n).groupBy(*names).agg(F.avg("latency").alias("mean"), *points)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = (counts.join(kept, same) if keys else counts.join(kept)).drop(*[f"_{k}" for k in keys])
    return out.withColumn("error_rate", F.when(F.col("n") > 0, F.col("errors") / F.col("n")))


def latency_levels(requests: DataFrame, n: int = 500) -> DataFrame:
    """The summary at its four levels; level has bit 1 without the tenant and bit 0 without the route."""
    out = None
    for level, keys in enumerate((["tenant_id", "route"], ["tenant_id"], ["route"], [])):
        own = latency_summary(requests, keys, n)
        missing = {k: F.lit(None).cast(requests.schema[k].dataType) for k in ("tenant_id", "route") if k not in keys}
        own = own.withColumns({**missing, "level": F.lit(level).cast("long")}) if missing else own.withColumn("level", F.lit(level).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out


def histogram(requests: DataFrame, column: str, bins: int = 16) -> DataFrame:
    """Bins of equal width between the least and the largest value; the last is closed."""
    ends = requests.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_lo")) / width))).otherwise(0)
    return requests.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row is broadcast


def tail_curve(requests: DataFrame, key: str, column: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """By row number, not by ties: ECDF i / n and CCDF 1 - i / n. A run's numbers are told slice by slice."""
    told = numbered(requests.select(key, "event_id", column), [key], [column, "event_id"], "_i", "_n", slice_rows)
    return told.select(key, "event_id", column, (F.col("_i") / F.col("_n")).alias("ecdf"), (1 - F.col("_i") / F.col("_n")).alias("ccdf"))


def throughput(requests: DataFrame, run: str, seconds: int = 60) -> DataFrame:
    """Requests of each run and time bin, and their mean over the runs that have the bin."""
    bins = requests.groupBy(run, F.floor(F.col("ms") / (seconds * 1000)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("bin").agg(F.avg("n").alias("mean"), F.count("*").alias("runs"))


def binned_means(requests: DataFrame, run: str, column: str) -> DataFrame:
    """Means of each run and minute, then over runs."""
    one = requests.groupBy(run, F.floor(F.col("ms") / 60000).alias("minute")).agg(F.avg(column).alias("m"))
    return one.groupBy("minute").agg(F.avg("m").alias("mean"))


def run_summary(requests: DataFrame, run: str) -> DataFrame:
    """Rate, success, slow shares and latency of each run. Latencies of 0 or less are counted, not ranked."""
    ranked = requests.withColumn("_l", F.when(F.col("latency") > 0, F.col("latency")))
    span = (F.max("ms") - F.min("ms")) / 1000
    return ranked.groupBy(run).agg(
        F.count("*").alias("requests"), F.avg(F.when(F.col("status") < 500, 1.0).otherwise(0.0)).alias("success_rate"),
        F.avg(F.when(F.col("latency") > 100, 1.0).otherwise(0.0)).alias("slow"), F.when(span > 0, F.count("*") / span).alias("per_second"),
        nearest_rank("_l", 0.95).alias("p95"), linear("_l", 0.5).alias("median"), F.max_by("event_id", "ms").alias("last_event"),
    )


def _latency_points(values: Column) -> list[Column]:
    points = [F.coalesce(linear(values, p), F.lit(0.0)).alias(f"latency_p{round(p * 100)}_ms") for p in POINTS]
    return [F.coalesce(F.avg(values), F.lit(0.0)).alias("latency_avg_ms"), *points]


def run_report(records: DataFrame) -> DataFrame:
    """All metrics of each run, from one table of records in one shuffle.

    A record has config_id, run_id, ms, event_id and a kind that says which other columns it fills: latency (latency_ms),
    tokens (token_kind, amount), prompt (amount: estimated tokens), lifecycle (action), proxy (retrieved, used), snapshot
    (items, amount: estimated tokens). Means, percentiles and ratios of nothing are 0; the last snapshot counts."""
    of = lambda kind, value=None: F.when(F.col("kind") == kind, F.lit(1) if value is None else F.col(value))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    tokens = lambda kind: total(F.when(F.col("token_kind") == kind, of("tokens", "amount")))
    acted = lambda action: F.count(F.when(F.col("action") == action, of("lifecycle")))
    last = lambda c: F.coalesce(F.max_by(c, of("snapshot", "_when")), F.lit(0))
    latency = F.when(F.col("latency_ms") > 0, of("latency", "latency_ms"))
    out = records.withColumn("_when", F.struct("ms", "event_id")).groupBy("config_id", "run_id").agg(
        F.count(of("latency")).alias("request_count"), *_latency_points(latency),
        total(of("tokens", "amount")).alias("tokens_total"), tokens("embedding").alias("tokens_embedding"), tokens("generation").alias("tokens_generation"),
        F.count(of("prompt")).alias("prompts_count"), F.coalesce(F.avg(of("prompt", "amount")), F.lit(0.0)).alias("prompt_tokens_est_avg"),
        *[acted(a).alias(f"lifecycle_{a}") for a in ("delete", "compact", "promote", "retain")],
        F.count(of("proxy")).alias("retrieval_requests"), total(of("proxy", "retrieved")).alias("retrieved_total"), total(of("proxy", "used")).alias("used_total"),
        last("items").alias("final_memory_items"), last("amount").alias("final_memory_tokens_est"),
    )
    ratio = F.when(F.col("retrieved_total") > 0, F.col("used_total") / F.col("retrieved_total")).otherwise(0.0)
    return out.withColumns({"run_key": F.concat_ws("::", "config_id", "run_id"), "retrieval_used_ratio": ratio})


def config_report(records: DataFrame) -> DataFrame:
    """The runs of each configuration together; percentiles are over all its requests, final sizes means over runs."""
    latency = F.when((F.col("kind") == "latency") & (F.col("latency_ms") > 0), F.col("latency_ms"))
    points = records.groupBy("config_id").agg(*_latency_points(latency)).withColumnRenamed("config_id", "_config")
    summed = ["request_count", "tokens_total", "tokens_embedding", "tokens_generation", "lifecycle_delete", "lifecycle_compact", "lifecycle_promote", "lifecycle_retain", "retrieved_total", "used_total"]
    means = [F.avg(c).alias(f"{c}_avg") for c in ("final_memory_items", "final_memory_tokens_est")]
    runs = run_report(records).groupBy("config_id").agg(F.count("*").alias("run_count"), *[F.sum(c).alias(c) for c in summed], *means)
    ratio = F.when(F.col("retrieved_total") > 0, F.col("used_total") / F.col("retrieved_total")).otherwise(0.0)
    return runs.join(points, F.col("config_id").eqNullSafe(F.col("_config"))).drop("_config").withColumn("retrieval_used_ratio", ratio)


def group_stats(rows: DataFrame, keys: list[str], metrics: list[str], seed: str) -> DataFrame:
    """Mean, sample deviation, least and largest of each metric, and different seeds; null groups stay."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*keys).agg(F.count_distinct(seed).alias("seeds"), *aggs)


def running_tokens(events: DataFrame, run: str, tokens: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Running sum of tokens of each run, by ms and event_id; slices of a run add the sum of those before them."""
    told = running_sum(events.select(run, "ms", "event_id", F.col(tokens).alias("_tokens")), [run], ["ms", "event_id"], "_tokens", "running", slice_rows)
    return told.select(run, "event_id", "running")


def used_ratio(events: DataFrame) -> DataFrame:
    """Per run, ids used over ids retrieved, of requests that retrieved any: sum over sum, not a mean of ratios."""
    sets = events.groupBy("run_id", "request_id").agg(F.collect_set(F.when(F.col("kind") == "retrieved", F.col("memory_id"))).alias("got"), F.collect_set(F.when(F.col("kind") == "used", F.col("memory_id"))).alias("used"))
    both = sets.filter(F.size("got") > 0).withColumn("hits", F.size(F.array_intersect("got", "used")))
    return both.groupBy("run_id").agg(F.count("*").alias("requests"), F.sum(F.size("got")).alias("retrieved"), F.sum("hits").alias("used")).withColumn("ratio", F.col("used") / F.col("retrieved"))


def acceptance(events: DataFrame, checks: dict[str, tuple[str, int]]) -> DataFrame:
    """PASS or FAIL of least counts by event type."""
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for name, (kind, _) in checks.items()]
    one = events.agg(*counts)
    rows = [F.struct(F.lit(n).alias("check"), F.col(n).alias("n"), F.when(F.col(n) >= least, "PASS").otherwise("FAIL").alias("result")) for n, (_, least) in checks.items()]
    return one.select(F.inline(F.array(*rows)))


def endpoint(path: Column) -> Column:
    """A request path's endpoint, its query cut off."""
    clean = F.substring_index(path, "?", 1)
    return F.when(clean.endswith("/ask"), "ask").when(clean.endswith("/search"), "search").when(clean.contains("/docs"), "docs").when(clean.contains("/memory"), "memory").otherwise("other")
