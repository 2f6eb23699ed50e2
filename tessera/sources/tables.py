"""Tables of the retrieval and memory model, derived from the driver's Parquet tables.

The same column expressions serve Spark and the SQL counterparts, so both sides start from equal rows.
Times are epoch milliseconds in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2024-02-01T00:00:00Z: queries never read the clock.
NOW_MS = 1706745600000

ITEM_COLUMNS = {
    "id": "doc_id",
    "tenant_id": "source",
    "collection": "lang",
    "external_id": "'doc-' || doc_id",
    "namespace_id": "source || '::' || lang || '::doc-' || doc_id",
    "item_type": "CASE doc_id % 6 WHEN 0 THEN 'artifact' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' WHEN 3 THEN 'episodic' WHEN 4 THEN 'conversation' ELSE 'summary' END",
    "visibility": "CASE doc_id % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'acl' WHEN 2 THEN NULL ELSE 'tenant' END",
    "agent_id": "'agent' || (doc_id % 5)",
    "acl": "'agent' || (doc_id % 2) || ',team' || (doc_id % 3)",
    "tags": "'t' || (doc_id % 3) || ',t' || (doc_id % 4)",
    "source_type": "CASE doc_id % 4 WHEN 0 THEN 'Url' WHEN 1 THEN 'file' WHEN 2 THEN NULL ELSE 'text' END",
    "metadata": """CASE WHEN doc_id % 5 = 0 THEN '{}' WHEN doc_id % 5 = 1 THEN '{"documentType":"Guide","updatedAt":"2024-99-99T00:00:00Z"}'
        ELSE '{"document_type":"Note","modified_at":"2024-01-' || (10 + doc_id % 19) || 'T0' || (doc_id % 10) || ':00:00Z","_tokens_est":"' || (doc_id % 400) || '"}' END""",
    "created_ms": "CAST(1704067200000 AS BIGINT) + doc_id * 7919 % 2592000 * 1000",
    "last_used_ms": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1704067200000 AS BIGINT) + doc_id * 104729 % 2592000 * 1000 END",
    "expires_ms": "CASE WHEN doc_id % 4 = 0 THEN CAST(1704067200000 AS BIGINT) + doc_id * 15485863 % 5184000 * 1000 END",
    "value_score": "CAST(doc_id * 31 % 101 AS DOUBLE) / 100",
    "tier": "CASE doc_id % 3 WHEN 0 THEN 'HOT' WHEN 1 THEN 'WARM' ELSE 'COLD' END",
    "pinned": "doc_id % 11 = 0",
    "reuse_count": "doc_id % 13",
    "utility_ema": "CAST(doc_id % 21 AS DOUBLE) / 10 - 1",
    "redundancy": "CAST(doc_id % 10 AS DOUBLE) / 9",
    "trust": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE CAST(doc_id % 8 AS DOUBLE) / 7 END",
    "importance": "CAST(doc_id % 5 AS DOUBLE) / 2 - 1",
    "text": "text",
}
USAGE_COLUMNS = {
    "tenant_id": "'tenant' || (user_id % 7)",
    "event_id": "event_id",
    "ts": "ts",
    "ms": "(epoch_us(ts) // 1000)",
    "kind": "event_type",
    "tokens": "CAST(round(value) AS BIGINT)",
    "billable": "event_type IN ('purchase', 'click')",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory items: one of each document."""
    return load(spark, sf_dir, "documents").selectExpr(*_select(ITEM_COLUMNS))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage ledger: one entry of each event."""
    columns = USAGE_COLUMNS | {"ms": "unix_millis(CAST(ts AS TIMESTAMP))"}
    return load(spark, sf_dir, "events").selectExpr(*_select(columns))


ITEMS_SQL = f"items AS (SELECT {', '.join(_select(ITEM_COLUMNS))} FROM documents)"
USAGE_SQL = f"usage AS (SELECT {', '.join(_select(USAGE_COLUMNS))} FROM events)"
