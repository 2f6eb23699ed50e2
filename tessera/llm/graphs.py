"""Connected components of an undirected link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize, release


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours on the smallest node seen: of each node its larger ones, or else its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if larger:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.filter("u != v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) links -> (node, root) for every linked node but the roots; root: the component's smallest node.

    Null ends and loops are ignored; an empty table gives an empty result. Each round is a written table,
    and the number of rounds is logarithmic in the longest chain.
    """
    state = materialize(links.select("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    told = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == told or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told, previous = now, state
        state = materialize(_star(_star(state, True), False), name)
        release(previous)
