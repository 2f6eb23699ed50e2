"""Joins, set operations and mutations as DataFrame plans; join strategies are left to the engine's sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_counts(chunks: DataFrame, items: DataFrame, allowed: Column) -> DataFrame:
    """Chunks of each visible artifact. Chunks are counted before the join, so it moves a row a document."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    artifacts = items.filter((F.col("item_type") == "artifact") & allowed).select(F.col("namespace_id").alias("doc_id"))
    return counted.join(artifacts, "doc_id")


def lookup(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Left outer lookup."""
    return left.join(right, on, "left")


def counts_per_tenant(tenants: DataFrame, orders: DataFrame) -> DataFrame:
    """Correlated counts, as one aggregate and a left join."""
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
    return tenants.select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["orders", "closed"])


def union_page(a: DataFrame, b: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """Distinct union and a keyset page of it."""
    return a.union(b).distinct().filter(F.col(key) > after).orderBy(key).limit(limit)


def first_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of edges with equal keys the one with the smallest id."""
    return edges.groupBy(*keys).agg(F.min("id").alias("id"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, and do nothing on conflict."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """U4: new rows replace descriptive columns; the kept ones stay as they were."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep or c in keys else F.coalesce(f"n.{c}", f"o.{c}")
    return o.join(n, on, "full").select(*[pick(c).alias(c) for c in old.columns])


def partial_update(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Supplied values replace, null ones don't."""
    o, n = old.alias("o"), changes.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "left").select(*[F.col(f"o.{c}") if c not in changes.columns or c in keys else F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns])


def cascade(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose parent stays."""
    return rows.join(gone, key, "left_anti")
