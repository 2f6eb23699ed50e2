"""Filters, orderings and relational joins over items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import filters as P
from tessera.operators import relations as R
from tessera.plans.base import query
from tessera.sources.tables import ITEMS_SQL, NOW_MS, items, load

_KEYS = ", ".join(f"json_extract_string(metadata, '$.{k}')" for k in P.FRESHNESS_KEYS)
FRESH_SQL = "coalesce(" + ", ".join(f"epoch_ms(try_cast(json_extract_string(metadata, '$.{k}') AS TIMESTAMP))" for k in P.FRESHNESS_KEYS) + ", created_ms, 0)"
DOCTYPE_SQL = "lower(coalesce(" + ", ".join(f"json_extract_string(metadata, '$.{k}')" for k in P.DOCUMENT_TYPE_KEYS) + "))"


@query(f"WITH {ITEMS_SQL} SELECT id, tenant_id, item_type FROM items WHERE collection = 'en' AND tier = 'HOT' AND item_type IN ('artifact', 'episodic') AND lower(coalesce(source_type, '')) IN ('url', '') AND len(list_intersect(string_split(tags, ','), ['t0'])) > 0 AND created_ms >= 1704500000000 AND created_ms <= 1706400000000 AND (expires_ms IS NULL OR expires_ms > {NOW_MS})")
def filter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = P.item_filter(collection="en", tier="hot", types=["artifact", "episodic"], source_types=["URL", ""], tags=[" T0"], since_ms=1704500000000, until_ms=1706400000000, now_ms=NOW_MS)
    return items(spark, sf_dir).filter(given).select("id", "tenant_id", "item_type")


@query(f"WITH {ITEMS_SQL} SELECT id, {DOCTYPE_SQL} AS document_type, {FRESH_SQL} AS freshness_ms FROM items WHERE {DOCTYPE_SQL} IN ('note', 'guide') AND {FRESH_SQL} >= 1705000000000")
def filter_fresh_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = P.item_filter(document_types=["note", "guide"], since_ms=1705000000000, time="updatedAt")
    return items(spark, sf_dir).filter(given).select("id", P.document_type().alias("document_type"), P.freshness_ms().alias("freshness_ms"))


@query(f"WITH {ITEMS_SQL} SELECT id, visibility FROM items WHERE visibility IS NULL OR visibility = 'tenant' OR (visibility = 'private' AND agent_id = 'agent1') OR (visibility = 'acl' AND (agent_id IN ('team2', 'agent1') OR len(list_intersect(string_split(acl, ','), ['team2', 'agent1'])) > 0))")
def acl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(P.visible("agent1", ("team2",))).select("id", "visibility")


@query("SELECT count(*) AS n FROM documents")
def acl_unrestricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(P.visible()).agg(F.count("*").alias("n"))


def _top(order: str) -> str:
    return f"WITH {ITEMS_SQL} SELECT id, tenant_id FROM items ORDER BY {order} DESC NULLS LAST, id LIMIT 40"


@query(_top("value_score"))
def value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_items(items(spark, sf_dir), "value", 40).select("id", "tenant_id")


@query(_top("coalesce(last_used_ms, created_ms)"))
def lru_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_items(items(spark, sf_dir), "lru", 40).select("id", "tenant_id")


@query(_top(FRESH_SQL))
def freshness_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_items(items(spark, sf_dir), "freshness", 40).select("id", "tenant_id")


@query(f"WITH {ITEMS_SQL} SELECT tier, count(*) AS n FROM items GROUP BY tier")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS_SQL} SELECT id, external_id FROM items WHERE external_id LIKE 'doc_1%'")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(P.like_prefix("external_id", "doc_1")).select("id", "external_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001') OR contains(lower(c_mktsegment), 'auto')")
def tenant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").filter(P.contains_any("AUTO", "c_mktsegment") | P.contains_any("#00000001", "c_name")).select("c_custkey", "c_name")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").filter(P.json_equals("props", "k", "7")).select("event_id")


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND (o_orderkey % 5 = 0 OR o_orderkey * 1000 <= 9000000) ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 1000 END NULLS FIRST, id LIMIT 30")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") * 1000).alias("next_run_ms"))
    return P.due_jobs(jobs, 9_000_000, 30).select("id")


@query(f"WITH {ITEMS_SQL} SELECT id FROM items WHERE id > 100 ORDER BY id LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_after(items(spark, sf_dir), 100, 50).select("id")


@query(f"WITH {ITEMS_SQL}, c AS (SELECT source || '::' || lang || '::doc-' || doc_id AS doc_id, unnest(range(1 + length(text) // 900)) AS idx FROM documents) SELECT c.doc_id, count(*) AS chunks FROM c JOIN items ON items.namespace_id = c.doc_id AND item_type = 'artifact' WHERE (expires_ms IS NULL OR expires_ms > {NOW_MS}) AND (visibility IS NULL OR visibility = 'tenant' OR (visibility = 'private' AND agent_id = 'agent1') OR (visibility = 'acl' AND (agent_id = 'agent1' OR len(list_intersect(string_split(acl, ','), ['agent1'])) > 0))) GROUP BY c.doc_id")
def docs_join_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = items(spark, sf_dir)
    chunks = own.select(F.col("namespace_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 900).cast("int"))).alias("idx"))
    return R.chunk_counts(chunks, own, P.visible("agent1") & P.not_expired(NOW_MS))


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def users_left_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return R.lookup(load(spark, sf_dir, "customer"), nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS closed FROM customer")
def tenant_counts_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_per_tenant(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) WHERE k > 3 ORDER BY k LIMIT 10")
def union_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_page(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k", 3, 10)


_LINKS = "l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS a, l_suppkey % 50 AS b, l_returnflag AS relation FROM lineitem)"


@query(f"WITH {_LINKS} SELECT min(id) AS id, a, b, relation FROM l GROUP BY a, b, relation")
def dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), F.col("l_returnflag").alias("relation"))
    return R.first_edges(links, ["a", "b", "relation"])


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 50, s_name FROM supplier WHERE s_suppkey + 50 NOT IN (SELECT c_custkey FROM customer)")
def anti_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 50).alias("k"), F.col("s_name").alias("name"))
    return R.insert_missing(old, new, ["k"])


@query(f"WITH {ITEMS_SQL}, n AS (SELECT id * 2 AS id, 'new' || id AS title, 0.0::DOUBLE AS value_score, 'COLD' AS tier, created_ms + 1 AS created_ms FROM items), o AS (SELECT id, 'old' || id AS title, value_score, tier, created_ms FROM items) SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(o.value_score, n.value_score) AS value_score, coalesce(o.tier, n.tier) AS tier, coalesce(o.created_ms, n.created_ms) AS created_ms FROM o FULL JOIN n ON o.id = n.id")
def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = items(spark, sf_dir)
    old = base.select("id", F.expr("'old' || id").alias("title"), "value_score", "tier", "created_ms")
    new = base.select((F.col("id") * 2).alias("id"), F.expr("'new' || id").alias("title"), F.lit(0.0).alias("value_score"), F.lit("COLD").alias("tier"), (F.col("created_ms") + 1).alias("created_ms"))
    return R.upsert(old, new, ["id"], keep=["value_score", "tier", "created_ms"])


@query(f"WITH {ITEMS_SQL}, u AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'COLD' END AS tier FROM items WHERE id % 2 = 0) SELECT items.id, coalesce(u.tier, items.tier) AS tier FROM items LEFT JOIN u ON u.id = items.id")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = items(spark, sf_dir).select("id", "tier")
    return R.partial_update(base, base.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "COLD").alias("tier")), ["id"])


@query("SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 0 GROUP BY o_orderstatus")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    gone = orders.filter("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    left = R.cascade(lines, gone, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return left.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS_SQL} SELECT tenant_id, collection, count(*) AS docs FROM items GROUP BY tenant_id, collection")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("tenant_id", "collection").agg(F.count("*").alias("docs"))
