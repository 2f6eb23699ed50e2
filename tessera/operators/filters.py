"""Item predicates and selectors: filters, visibility, freshness, orderings. All are columns that reach the scan where they can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metadata keys that may hold an item's freshness, in order of precedence.
FRESHNESS_KEYS = [
    "updatedAt", "updated_at", "lastUpdatedAt", "last_updated_at", "modifiedAt", "modified_at", "publishedAt", "published_at", "effectiveAt", "effective_at",
    "sourceUpdatedAt", "source_updated_at", "syncedAt", "synced_at", "lastSyncedAt", "last_synced_at",
]
# Metadata keys that may hold a document's type, in order of precedence.
DOCUMENT_TYPE_KEYS = ["documentType", "document_type", "docType", "doc_type"]
TIME_FIELDS = {"created_at": "created_ms", "createdAt": "created_ms", "created": "created_ms", "freshness": "freshness_ms", "updated_at": "freshness_ms", "updatedAt": "freshness_ms"}


def time_field(name: str | None) -> str:
    """the column behind a time field's name or alias."""
    if name and name not in TIME_FIELDS:
        raise ValueError(f"unknown time field {name!r}")
    return TIME_FIELDS[name or "created_at"]


def freshness_ms() -> Column:
    """the first metadata date that is valid, else the creation time. Invalid dates count as absent."""
    dates = [F.expr(f"unix_millis(try_to_timestamp(get_json_object(metadata, '$.{k}')))") for k in FRESHNESS_KEYS]
    return F.coalesce(*dates, "created_ms", F.lit(0))


def document_type() -> Column:
    """F6."""
    return F.lower(F.coalesce(*[F.get_json_object("metadata", f"$.{k}") for k in DOCUMENT_TYPE_KEYS]))


def tag_list(column: str) -> Column:
    return F.split(F.col(column), ",")


def visible(principal: str | None = None, privileges: tuple[str, ...] = ()) -> Column:
    """no principal and no privileges mean no restriction at all."""
    if not principal and not privileges:
        return F.lit(True)
    names = [*privileges, *([principal] if principal else [])]
    private = (F.col("visibility") == "private") & (F.col("agent_id") == principal) if principal else F.lit(False)
    listed = (F.col("visibility") == "acl") & (F.col("agent_id").isin(names) | F.arrays_overlap(tag_list("acl"), F.array(*map(F.lit, names))))
    return F.coalesce(F.col("visibility").isNull() | (F.col("visibility") == "tenant") | private | listed, F.lit(False))


def not_expired(now_ms: int) -> Column:
    return F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms)


def item_filter(
    *, tenant: str | None = None, collection: str | None = None, namespaces: list[str] | None = None, externals: list[str] | None = None, tier: str | None = None,
    types: list[str] | None = None, source_types: list[str] | None = None, document_types: list[str] | None = None, agent: str | None = None, tags: list[str] | None = None,
    since_ms: int | None = None, until_ms: int | None = None, time: str | None = None, now_ms: int | None = None,
) -> Column:
    """a predicate of what was given and nothing else."""
    parts = []
    for value, column in ((tenant, "tenant_id"), (collection, "collection"), (agent, "agent_id")):
        if value:
            parts.append(F.col(column) == value)
    for values, column in ((namespaces, F.col("namespace_id")), (externals, F.col("external_id")), (types, F.col("item_type")), (document_types, document_type())):
        if values:
            parts.append(F.coalesce(column.isin(values), F.lit(False)))
    if source_types:
        parts.append(F.lower(F.coalesce("source_type", F.lit(""))).isin([s.lower() for s in source_types]))
    if tier:
        parts.append(F.col("tier") == tier.upper())
    if tags:
        parts.append(F.arrays_overlap(F.transform(tag_list("tags"), lambda t: F.lower(F.trim(t))), F.array(*[F.lit(t.strip().lower()) for t in tags])))
    at = freshness_ms() if time_field(time) == "freshness_ms" else F.col("created_ms")
    if since_ms is not None:
        parts.append(at >= since_ms)
    if until_ms is not None:
        parts.append(at <= until_ms)
    if now_ms is not None:
        parts.append(not_expired(now_ms))
    return reduce(Column.__and__, parts, F.lit(True))


ORDERS = {"value": lambda: F.col("value_score"), "lru": lambda: F.coalesce("last_used_ms", "created_ms"), "freshness": freshness_ms, "created_at": lambda: F.col("created_ms")}


def select_items(items: DataFrame, order: str = "value", limit: int = 50) -> DataFrame:
    """Best first, nulls last, ties by id."""
    return items.orderBy(ORDERS[order]().desc_nulls_last(), F.asc("id")).limit(limit)


def like_prefix(column: str, prefix: str) -> Column:
    """a prefix lookup in which _ and % keep their pattern meaning."""
    return F.col(column).like(prefix + "%")


def contains_any(text: str, *columns: str) -> Column:
    """case-blind containment in any of the columns."""
    return reduce(Column.__or__, [F.lower(c).contains(text.lower()) for c in columns])


def json_equals(column: str, key: str, value: str) -> Column:
    """F13."""
    return F.get_json_object(column, f"$.{key}") == value


def due_jobs(jobs: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """queued jobs whose time has come, unscheduled ones first."""
    ready = (F.col("status") == "queued") & (F.col("next_run_ms").isNull() | (F.col("next_run_ms") <= now_ms))
    return jobs.filter(ready).orderBy(F.asc_nulls_first("next_run_ms"), "id").limit(limit)


def page_after(rows: DataFrame, after: int, limit: int) -> DataFrame:
    """The next page of a keyset scan."""
    return rows.filter(F.col("id") > after).orderBy("id").limit(limit)
