"""Vector store operators: upsert, delete, exact and hashed top-k, modes.

Queries meet vectors in numbered blocks, by matrix products, and every batch keeps its best before anything moves.
LSH buckets are an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import SLICE_ROWS, numbered


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """V5: a stored zero vector scores 0."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def upsert(log: DataFrame, dim: int) -> DataFrame:
    """V1: the last vector of each id; vectors that are empty or of another dimension are refused."""
    good = log.filter(F.size("vec") == dim)
    return good.groupBy("id").agg(F.max_by("vec", "seq").alias("vec"), (F.count("*") > 1).alias("updated"))


def delete_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """V2."""
    return vectors.join(ids, "id", "left_anti")


def delete_prefix(vectors: DataFrame, prefix: str) -> DataFrame:
    """V3: an empty prefix deletes nothing."""
    return vectors.filter(~F.col("id").startswith(prefix)) if prefix else vectors


def clear(vectors: DataFrame) -> DataFrame:
    """V4."""
    return vectors.limit(0)


def best_per_query(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(0, k))


#: Queries and vectors of one matrix product; bytes of query vectors that may be sent to every task, and of a block beyond that.
BLOCK_QUERIES, PART_VECTORS, BROADCAST_BYTES = 512, 8192, 32 << 20
#: Products of matrices may differ from plain ones by this much; what is so close to the last place is scored again.
SLACK = 1e-9


def _best_of_block(ids: pd.Series, vecs: pd.Series, names: pd.Series, queries: pd.Series, k: int, digits: int | None) -> pd.DataFrame:
    """query_id, id, score of each query's k best among these vectors, ties to the smaller id."""
    order = np.argsort(ids.to_numpy(), kind="stable")
    ids, names = ids.to_numpy()[order], names.to_numpy()
    x, q = (v / np.where(n > 0, n, 1)[:, None] for v in (np.stack(vecs.to_numpy()[order]), np.stack(queries.to_numpy())) for n in [np.sqrt((v * v).sum(axis=1))])
    found = []
    for at in range(0, len(q), BLOCK_QUERIES):
        near: list[list[np.ndarray]] = [[] for _ in q[at : at + BLOCK_QUERIES]]
        for start in range(0, len(x), PART_VECTORS):
            for own, scores in zip(near, q[at : at + BLOCK_QUERIES] @ x[start : start + PART_VECTORS].T, strict=True):
                least = np.partition(scores, -k)[-k] if k < len(scores) else -np.inf
                own.append(start + np.flatnonzero(scores >= least - SLACK - 10.0**-digits if digits else scores >= least - SLACK))
        for i, own in enumerate(near, at):
            js = np.concatenate(own)
            scores = (x[js] * q[i]).sum(axis=1)  # equal vectors have equal scores, wherever they lie
            scores = scores if digits is None else np.round(scores, digits)
            best = np.argsort(-scores, kind="stable")[:k]  # ids are sorted, so ties go to the smaller one
            found.append(pd.DataFrame({"query_id": names[i], "id": ids[js[best]], "score": scores[best]}))
    return pd.concat(found)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """V5: exact cosine top-k. Queries without length or of another dimension give nothing; k below 0 is 0.

    digits: scores that are equal so far tie; by default whole scores are ranked. While a count and the longest vector bound
    their size, queries are broadcast and each batch of vectors meets them in blocks, by matrix products. Beyond that,
    numbered blocks of queries and parts of vectors, both of that size, meet in groups: a vector is copied once
    per block of queries. Either way only the k best of each query leave a task."""
    asked = queries.filter(norm("query") > 0).select("query_id", F.col("query").cast("array<double>").alias("query")).withColumn("d", F.size("query"))
    rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).withColumn("d", F.size("vec")).filter("d > 0")
    told = asked.agg(F.count("*").alias("n"), F.max("d").alias("d")).first()
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    if k <= 0 or not told["n"]:
        return best_per_query(vectors.sparkSession.createDataFrame([], kinds), 0)
    if told["n"] * told["d"] * 8 <= BROADCAST_BYTES:
        shared = vectors.sparkSession.sparkContext.broadcast(asked.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for d, part in b.groupby("d"):
                    fit = shared.value[shared.value["d"] == d]
                    if len(fit):
                        yield _best_of_block(part["id"], part["vec"], fit["query_id"], fit["query"], k, digits)

        return best_per_query(rows.mapInPandas(run, kinds), k)

    def meet(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(block):
            return pd.DataFrame({"query_id": block["query_id"].iloc[:0], "id": part["id"].iloc[:0], "score": np.empty(0)})
        return _best_of_block(part["id"], part["vec"], block["query_id"], block["query"], k, digits)

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block_rows = max(BLOCK_QUERIES, BROADCAST_BYTES // (told["d"] * 8))
    blocks, parts = -(-told["n"] // block_rows), max(1, -(-rows.count() // block_rows))
    left = rows.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(parts)).cast("int")).withColumn("block", numbers(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", numbers(parts))
    keys = ["block", "part", "d"]
    return best_per_query(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, kinds), k)


def exact_topk_subset(vectors: DataFrame, queries: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """V6: within listed ids; unknown ids are skipped, and ids listed twice come twice."""
    return exact_topk(vectors.join(ids, "id"), queries, k)


def planes(dim: int, tables: int, bits: int, seed: int = 1337) -> list[list[list[float]]]:
    """V7: normal hyperplanes of each table, rounded so that they can be written down."""
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(tables, bits, dim)), 4).tolist()


def signatures(vectors: DataFrame, hyperplanes: list[list[list[float]]]) -> DataFrame:
    """V7: (id, table, signature) buckets; a bit is 1 if the projection isn't negative. One matrix product a batch."""
    stacked = np.array(hyperplanes)
    tables, bits, dim = stacked.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                above = np.stack(b["vec"]).astype(np.float64) @ stacked.reshape(-1, dim).T >= 0
                codes = above.reshape(-1, tables, bits) @ (1 << np.arange(bits))
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), tables), "table": np.tile(np.arange(tables), len(b)), "signature": codes.ravel()})

    rows = vectors.select("id", "vec").filter(F.size("vec") == dim)
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, table int, signature int")


def lsh_index(vectors: DataFrame, hyperplanes: list, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """V7: (table, signature, place, id): each row's place in its bucket by id, from 1. Buckets of any size are numbered in slices."""
    return numbered(signatures(vectors, hyperplanes), ["table", "signature"], ["id"], "place", "bucket_rows", slice_rows)


def write_lsh_index(vectors: DataFrame, hyperplanes: list, path: str) -> DataFrame:
    """V7: the index as files in order of bucket and place, so that a probe's filters skip what it doesn't need."""
    order = ["table", "signature", "place"]
    lsh_index(vectors, hyperplanes).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def probe(index: DataFrame, queries: DataFrame, hyperplanes: list, cap: int, allowed: DataFrame | None = None) -> DataFrame:
    """V8, V9: (query_id, id) of at most `cap` candidates from equal buckets, first by table and id.

    Of each bucket only the first `cap` places are met: of these, at most as many repeat candidates of earlier tables as there
    are, so the rest fills the cap as the whole bucket would. Listed ids are numbered anew within the asked buckets."""
    asked = signatures(queries.select(F.col("query_id").alias("id"), F.col("query").alias("vec")), hyperplanes).withColumnRenamed("id", "query_id")
    if allowed is not None:
        buckets = asked.select("table", "signature").distinct()
        listed = index.join(buckets, ["table", "signature"], "left_semi").join(allowed.select("id").distinct(), "id", "left_semi")
        index = listed.withColumn("place", F.row_number().over(Window.partitionBy("table", "signature").orderBy("id")))
    near = asked.join(index.filter(F.col("place") <= cap), ["table", "signature"])
    found = near.groupBy("query_id", "id").agg(F.min("table").alias("table"))
    w = Window.partitionBy("query_id").orderBy("table", "id")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).select("query_id", "id")


def ann_topk(vectors: DataFrame, queries: DataFrame, hyperplanes: list, k: int, overfetch: int = 5, allowed: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """V8, V9: at most max(k, k * overfetch) candidates of the index, exact scores decide. Without a stored index one is made."""
    index = lsh_index(vectors, hyperplanes) if index is None else index
    near = probe(index, queries, hyperplanes, max(k, k * overfetch), allowed)
    scored = near.join(vectors, "id").join(queries, "query_id").select("query_id", "id", cosine("vec", "query").alias("score"))
    return best_per_query(scored, k)


def store_stats(vectors: DataFrame, hyperplanes: list) -> DataFrame:
    """Rows, dimensions and buckets."""
    buckets = signatures(vectors, hyperplanes).groupBy("table", "signature").agg(F.count("*").alias("n"))
    stats = vectors.agg(F.count("*").alias("vectors"), F.min(F.size("vec")).cast("long").alias("min_dim"), F.max(F.size("vec")).cast("long").alias("max_dim"))
    return stats.join(buckets.agg(F.count("*").alias("buckets"), F.max("n").alias("largest_bucket")))


def overlap(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """V12, shadow mode: the share of the exact result that the approximate one has."""
    hit = exact.select("query_id", "id").join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("overlap"))


def in_rollout(key: Column | str, percent: int) -> Column:
    """Whether a request is in the share that may take the approximate way; the same key always is or isn't."""
    return F.conv(F.substring(F.sha2(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), 256), 1, 6), 16, 10).cast("int") % 100 < percent


def search_mode(mode: str, n: int, recent_overlaps: list[float], *, least: int = 5000, floor: float = 0.8, strikes: int = 3, seconds_since: float = 0, open_seconds: float = 300) -> str:
    """V12: 'ann' or 'exact'. auto takes ann from `least` candidates on, unless the last overlaps broke the circuit
    less than `open_seconds` ago."""
    broken = seconds_since < open_seconds and len(recent_overlaps) >= strikes and all(x < floor for x in recent_overlaps[-strikes:])
    return "ann" if mode == "auto" and n >= least and not broken else "exact"


def search_window(k: int, doc_filter: bool = False, multiplier: int = 5, cap: int | None = None) -> int:
    """Candidates to fetch for k results."""
    if doc_filter and cap is not None:
        return cap
    return k * multiplier if cap is None else min(k * multiplier, cap)


def reindex_reason(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Whether stored vectors fit the stored chunks, and if not, why."""
    stats = chunks.agg(F.count("*").alias("chunks")).join(vectors.agg(F.count("*").alias("vectors"), F.max(F.size("vec")).alias("dim")))
    reason = F.when((F.col("vectors") > 0) & (F.col("dim") != dim), "dimension_mismatch").when(F.col("chunks") != F.col("vectors"), "count_mismatch").otherwise("up_to_date")
    return stats.select("chunks", "vectors", reason.alias("reason"), (reason != "up_to_date").alias("clear_first"))
