"""Vector store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.plans.base import query
from tessera.sources.tables import load
from tessera.storage import fresh_path

PLANES = V.planes(64, 4, 6)
VECTORS = "v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS vec, label FROM embeddings), q AS (SELECT id AS query_id, vec AS query FROM v WHERE CAST(id AS BIGINT) % 100 = 0)"
SIGNATURES = "s AS (SELECT id, t.i - 1 AS tbl, (" + " + ".join(f"CASE WHEN list_inner_product(vec, t.planes[{b + 1}]) >= 0 THEN {1 << b} ELSE 0 END" for b in range(6)) + ") AS sig FROM v, (SELECT unnest(range(1, 5)) AS i, unnest(" + str(PLANES) + "::DOUBLE[][][]) AS planes) t)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "label")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), rows.filter(F.col("id").cast("long") % 100 == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))


def _rounded(found: DataFrame) -> DataFrame:
    """Ranked by whole scores, shown with six places."""
    return found.withColumn("score", F.round("score", 6))


def _index(rows: DataFrame) -> DataFrame:
    """A stored index of all vectors; the files go when the driver ends."""
    return V.write_lsh_index(rows, PLANES, fresh_path(rows.sparkSession, "lsh_index"))


@query(f"WITH {VECTORS} SELECT query_id, id, round(list_cosine_similarity(vec, query), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(vec, query) DESC, id) AS rank FROM v, q QUALIFY rank <= 5")
def vec_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.exact_topk(*_vectors(spark, sf_dir), 5))


@query(f"WITH {VECTORS}, l AS (SELECT id FROM v WHERE label = 1 UNION ALL SELECT '3' UNION ALL SELECT '7' UNION ALL SELECT '7' UNION ALL SELECT 'none') SELECT query_id, v.id, round(list_cosine_similarity(vec, query), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(vec, query) DESC, v.id) AS rank FROM v JOIN l ON v.id = l.id, q QUALIFY rank <= 5")
def vec_topk_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _vectors(spark, sf_dir)
    listed = rows.filter("label = 1").select("id").union(spark.createDataFrame([("3",), ("7",), ("7",), ("none",)], "id string"))
    return _rounded(V.exact_topk_subset(rows, asked, listed, 5))


@query("SELECT label, count(*) AS n FROM embeddings WHERE NOT starts_with(CAST(vec_id AS VARCHAR), '1') GROUP BY label")
def vec_prefix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.delete_prefix(_vectors(spark, sf_dir)[0], "1").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label")
def vec_delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _vectors(spark, sf_dir)
    return V.delete_ids(rows, rows.filter(F.col("id").cast("long") % 3 == 0).select("id")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM embeddings WHERE false")
def vec_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clear(_vectors(spark, sf_dir)[0]).agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT vec_id % 100 AS id, vec_id, embedding::DOUBLE[] AS vec FROM embeddings) SELECT CAST(id AS VARCHAR) AS id, round(list_inner_product(max_by(vec, vec_id), max_by(vec, vec_id)), 6) AS square, count(*) > 1 AS updated FROM u GROUP BY id")
def vec_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).cast("string").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"))
    return V.upsert(log, 64).select("id", F.round(V.dot("vec", "vec"), 6).alias("square"), "updated")


@query(f"WITH {VECTORS}, {SIGNATURES} SELECT tbl, sig, count(*) AS n FROM s GROUP BY tbl, sig")
def vec_lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.signatures(_vectors(spark, sf_dir)[0], PLANES).groupBy(F.col("table").cast("long").alias("tbl"), F.col("signature").alias("sig")).agg(F.count("*").alias("n"))


_ANN = f"""{VECTORS}, {SIGNATURES},
f AS (SELECT a.id AS query_id, b.id, min(b.tbl) AS tbl FROM s a JOIN q ON q.query_id = a.id JOIN s b ON a.tbl = b.tbl AND a.sig = b.sig {{0}} GROUP BY a.id, b.id),
c AS (SELECT query_id, id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tbl, id) <= 25),
r AS (SELECT c.query_id, c.id, list_cosine_similarity(v.vec, q.query) AS score FROM c JOIN v ON v.id = c.id JOIN q ON q.query_id = c.query_id),
ann AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 5)"""


@query(f"WITH {_ANN.format('')} SELECT query_id, id, round(score, 6) AS score, rank FROM ann")
def vec_lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _vectors(spark, sf_dir)
    return _rounded(V.ann_topk(rows.select("id", "vec"), asked, PLANES, 5, index=_index(rows)))


@query(f"WITH {_ANN.format('JOIN v x ON x.id = b.id AND x.label < 5')} SELECT query_id, id, round(score, 6) AS score, rank FROM ann")
def vec_lsh_topk_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _vectors(spark, sf_dir)
    return _rounded(V.ann_topk(rows.select("id", "vec"), asked, PLANES, 5, allowed=rows.filter("label < 5"), index=_index(rows)))


@query(f"WITH {_ANN.format('')}, e AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(vec, query) DESC, id) AS rank FROM v, q QUALIFY rank <= 5) SELECT e.query_id, count(ann.id) / 5.0::DOUBLE AS overlap FROM e LEFT JOIN ann ON ann.query_id = e.query_id AND ann.id = e.id GROUP BY e.query_id")
def vec_ann_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _vectors(spark, sf_dir)
    return V.overlap(V.exact_topk(rows, asked, 5), V.ann_topk(rows.select("id", "vec"), asked, PLANES, 5), 5)


@query(f"WITH {VECTORS}, {SIGNATURES}, b AS (SELECT tbl, sig, count(*) AS n FROM s GROUP BY tbl, sig) SELECT (SELECT count(*) FROM v) AS vectors, CAST(64 AS BIGINT) AS min_dim, CAST(64 AS BIGINT) AS max_dim, count(*) AS buckets, max(n) AS largest_bucket FROM b")
def vec_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.store_stats(_vectors(spark, sf_dir)[0], PLANES)


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, CASE WHEN (SELECT count(*) FROM documents) <> (SELECT count(*) FROM embeddings) THEN 'count_mismatch' ELSE 'up_to_date' END AS reason, (SELECT count(*) FROM documents) <> (SELECT count(*) FROM embeddings) AS clear_first")
def vec_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reindex_reason(load(spark, sf_dir, "documents").select("doc_id"), _vectors(spark, sf_dir)[0], 64)


@query("SELECT vec_id, CAST('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 6) AS INTEGER) % 100 < 25 AS approximate FROM embeddings")
def search_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", V.in_rollout("vec_id", 25).alias("approximate"))
