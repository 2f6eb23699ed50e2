"""Memory value, tier, lifecycle and expiry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import memory as M
from tessera.plans.base import query
from tessera.sources.tables import ITEMS_SQL, NOW_MS, items, load

DAY = M.DAY_MS
VALUE_SQL = f"""1 / (1 + exp(-(1.2::DOUBLE * ln(1 + reuse_count) + 2 * utility_ema + (1 - redundancy) + coalesce(trust, 0.5::DOUBLE)
  + 0.5::DOUBLE * exp(-greatest(0, {NOW_MS} - coalesce(last_used_ms, created_ms)) / {DAY}::DOUBLE / 30) + importance - least(2, CASE WHEN length(trim(text)) = 0 THEN 0 ELSE ceil(length(trim(text)) / 4.0::DOUBLE) END / 2000.0::DOUBLE))))"""


@query(f"WITH {ITEMS_SQL} SELECT id, round({VALUE_SQL}, 6) AS value FROM items")
def value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.round(M.value_score(NOW_MS, M.token_estimate("text")), 6).alias("value"))


@query(f"WITH {ITEMS_SQL} SELECT id, CAST(ceil(length(trim(text)) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM items")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", M.token_estimate("text").alias("tokens"))


@query(f"WITH {ITEMS_SQL} SELECT id, round(value_score * exp(-{M.DECAY}::DOUBLE * ({NOW_MS} - created_ms) / {DAY}::DOUBLE), 6) AS value FROM items")
def value_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.round(M.decayed(F.col("value_score"), F.col("created_ms"), NOW_MS), 6).alias("value"))


@query(f"WITH {ITEMS_SQL} SELECT id, tier, CASE WHEN tier = 'WARM' AND value_score > 0.70::DOUBLE THEN 'HOT' WHEN tier = 'COLD' AND value_score >= 0.45::DOUBLE THEN 'WARM' WHEN tier = 'HOT' AND value_score < 0.62::DOUBLE AND NOT pinned THEN 'WARM' WHEN tier = 'WARM' AND value_score < 0.25::DOUBLE AND NOT pinned THEN 'COLD' ELSE tier END AS next FROM items")
def tier_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", "tier", M.next_tier(F.col("tier"), F.col("value_score"), F.col("pinned")).alias("next"))


_FOLD = f"""WITH RECURSIVE e AS (
  SELECT user_id AS memory_id, event_id, (epoch_us(ts) // 1000) AS ms, CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'purchase' THEN 'used_in_answer' WHEN 'error' THEN 'user_negative' ELSE event_type END AS kind FROM events),
n AS (SELECT *, row_number() OVER w AS n, coalesce((ms - lag(ms) OVER w) / {DAY}::DOUBLE, 0) AS gap FROM e WINDOW w AS (PARTITION BY memory_id ORDER BY ms, event_id)),
f AS (SELECT memory_id, 0::BIGINT AS n, 0.5::DOUBLE AS v FROM (SELECT DISTINCT memory_id FROM n)
  UNION ALL SELECT f.memory_id, n.n, least(1::DOUBLE, greatest(0::DOUBLE, v * exp(-{M.DECAY}::DOUBLE * gap) + CASE kind WHEN 'retrieved' THEN 0.08::DOUBLE WHEN 'used_in_answer' THEN 0.28::DOUBLE WHEN 'user_negative' THEN -0.08::DOUBLE ELSE 0 END))
  FROM f JOIN n ON n.memory_id = f.memory_id AND n.n = f.n + 1)
SELECT memory_id, max(n) AS events, round(max_by(v, n), 6) AS value FROM f GROUP BY memory_id"""


@query(_FOLD)
def event_fold_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'purchase' THEN 'used_in_answer' WHEN 'error' THEN 'user_negative' ELSE event_type END")
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), kind.alias("kind"))
    return M.fold_values(events).withColumn("value", F.round("value", 6))


_ACTION = f"CASE WHEN {NOW_MS} - created_ms < 24 * 3600000 OR pinned THEN 'keep' WHEN value_score < 0.25::DOUBLE THEN 'delete' WHEN value_score < 0.45::DOUBLE THEN 'summarize' WHEN value_score >= 0.70::DOUBLE THEN 'promote' ELSE 'keep' END"


@query(f"WITH {ITEMS_SQL}, a AS (SELECT id, tenant_id, collection, {_ACTION} AS action FROM items) SELECT *, CASE WHEN action = 'summarize' THEN CAST(ceil(row_number() OVER (PARTITION BY tenant_id, collection, action ORDER BY id) / 5.0::DOUBLE) AS BIGINT) END AS compact_group FROM a")
def lifecycle_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lifecycle(items(spark, sf_dir), NOW_MS)


@query(f"WITH {ITEMS_SQL} SELECT id FROM items WHERE value_score < 0.25::DOUBLE ORDER BY value_score, id LIMIT 12")
def delete_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.within_budget(items(spark, sf_dir).filter("value_score < 0.25"), 12, F.asc("value_score"), F.asc("id")).select("id")


@query("WITH p AS (SELECT a.vec_id AS id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT vec_id AS id, round(least(1, greatest(0, coalesce(best, 0))), 6) AS redundancy FROM embeddings LEFT JOIN p ON p.id = vec_id")
def vec_label_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("block"))
    return M.redundancy(rows)


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'user_positive' WHEN 'error' THEN 'user_negative' WHEN 'purchase' THEN 'task_success' ELSE event_type END AS event FROM events")
def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("CASE event_type WHEN 'view' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'success' ELSE event_type END")
    return load(spark, sf_dir, "events").select("event_id", M.feedback_event(given).alias("event"))


_GATE = f"""WITH {ITEMS_SQL}, pool AS (SELECT * FROM items WHERE tier = 'WARM' ORDER BY value_score DESC, id LIMIT 80), w AS (SELECT id, tier FROM pool ORDER BY %s, id LIMIT 20),
g AS (SELECT id, tier FROM items WHERE tier = 'HOT' UNION ALL SELECT * FROM w UNION ALL SELECT id, tier FROM items WHERE tier = 'COLD' AND CAST('0x' || substr(sha256('7:' || id), 1, 6) AS INTEGER) < {int(0.05 * 16**6)})"""


@query(_GATE.replace("%s", "sha256('7:' || id)") + " SELECT id, tier FROM g")
def tier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tier_gate(items(spark, sf_dir), 20, 4, 0.05, 7).select("id", "tier")


@query(_GATE.replace("%s", "last_used_ms ASC NULLS FIRST") + " SELECT count(*) FILTER (WHERE tier = 'HOT') AS hot_count, count(*) FILTER (WHERE tier = 'WARM') AS warm_sampled, count(*) FILTER (WHERE tier = 'COLD') AS cold_candidates, count(*) AS retrieval_set_size, count(*) FILTER (WHERE tier <> 'WARM') + 20 AS retrieval_bound, count(*) <= count(*) FILTER (WHERE tier <> 'WARM') + 20 AS bounded FROM g")
def tier_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate_counts(M.tier_gate(items(spark, sf_dir), 20, 4, 0.05, 7, "lru"), 20)


@query(_GATE.replace("%s", "last_used_ms ASC NULLS FIRST") + " SELECT id, tier FROM g WHERE tier = 'WARM'")
def tier_gate_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tier_gate(items(spark, sf_dir), 20, 4, 0.05, 7, "lru").filter("tier = 'WARM'").select("id", "tier")


@query(f"SELECT event_id, trim(CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type || ' ' END) AS event_type, value AS event_value, coalesce(CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) // 1000 END, {NOW_MS}) AS created_ms FROM events WHERE event_id % 9 <> 0 AND value IS NOT NULL AND isfinite(value)")
def recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type || ' ' END AS event_type", "value AS event_value", "CASE WHEN event_id % 4 > 0 THEN unix_millis(CAST(ts AS TIMESTAMP)) END AS created_ms")
    return M.recorded_events(given, NOW_MS)


_LINKS = "SELECT 't' || (user_id % 3) AS tenant_id, user_id AS from_item_id, event_id % 50 AS to_item_id, event_type AS relation, props AS metadata FROM {0}"


@query(f"WITH l AS ({_LINKS.format('events')}), s AS (SELECT * FROM l WHERE relation = 'error') SELECT tenant_id, from_item_id, to_item_id, relation, min(metadata) AS metadata FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.tenant_id = l.tenant_id AND s.from_item_id = l.from_item_id AND s.to_item_id = l.to_item_id AND s.relation = l.relation) AND from_item_id IS NOT NULL AND relation IS NOT NULL GROUP BY ALL")
def memory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "events").selectExpr("'t' || (user_id % 3) AS tenant_id", "user_id AS from_item_id", "event_id % 50 AS to_item_id", "event_type AS relation", "props AS metadata")
    return M.new_links(links, links.filter("relation = 'error'"))


_LOG = "g AS (SELECT event_id AS seq, 'k' || (user_id % 97) AS key, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'SET' END AS op, props AS value, CASE WHEN event_type = 'view' THEN {ms} + 86400000 * (event_id % 40) END AS expires_ms FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _LOG[len("g AS (SELECT ") : -len(" FROM events)")].format(ms="unix_millis(CAST(ts AS TIMESTAMP))")
    return load(spark, sf_dir, "events").selectExpr(*[x.strip() for x in sql.replace("END, ", "END,").split(", ")])


_LAST = f"WITH {_LOG.format(ms='(epoch_us(ts) // 1000)')}, l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@query(f"{_LAST} SELECT key, value, expires_ms FROM l WHERE op = 'SET'")
def kv_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.last_writes(_log(spark, sf_dir))


@query(f"{_LAST} SELECT key, CASE WHEN expires_ms IS NOT NULL THEN CAST(greatest(1, floor((expires_ms - {NOW_MS}) / 1000.0::DOUBLE)) AS BIGINT) END AS ttl_s FROM l WHERE op = 'SET' AND (expires_ms IS NULL OR expires_ms >= {NOW_MS})")
def ttl_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unexpired(M.last_writes(_log(spark, sf_dir)), NOW_MS).select("key", M.remaining_ttl(NOW_MS).alias("ttl_s"))


@query(f"WITH {_LOG.format(ms='(epoch_us(ts) // 1000)')} SELECT seq, CASE WHEN expires_ms IS NOT NULL THEN {NOW_MS} + seq % 50 * 1000 END AS expires_ms FROM g")
def wal_replay_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("ttl_s", F.when(F.col("expires_ms").isNotNull(), F.col("seq") % 50))
    return M.replayed_expiry(log, NOW_MS).select("seq", "expires_ms")


@query(f"WITH {ITEMS_SQL} SELECT id, expires_ms FROM items WHERE expires_ms <= {NOW_MS} ORDER BY expires_ms, id LIMIT 200")
def expired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.expired_items(items(spark, sf_dir), NOW_MS).select("id", "expires_ms")


@query(f"WITH {ITEMS_SQL} SELECT id FROM items WHERE item_type <> 'artifact' AND collection = 'en' AND (expires_ms IS NULL OR expires_ms > {NOW_MS}) ORDER BY created_ms DESC, id LIMIT 100")
def compaction_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.filters import item_filter

    given = item_filter(types=["semantic", "procedural", "episodic", "conversation", "summary"], collection="en", now_ms=NOW_MS)
    return items(spark, sf_dir).filter(given).orderBy(F.desc("created_ms"), "id").limit(100).select("id")
