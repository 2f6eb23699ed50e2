"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import conversations as C
from tessera.plans.base import query
from tessera.sources.tables import load


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).filter("conv_id % 3 = 0").groupBy("conv_id").agg(F.lit(2).cast("long").alias("checkpoint"))


_RANK = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"


@query(f"SELECT conv_id, turn, role FROM conversations QUALIFY {_RANK} <= 3")
def conv_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.newest(_turns(spark, sf_dir), 3)


@query(f"SELECT conv_id, turn, role FROM conversations QUALIFY {_RANK} > 4")
def conv_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pruned(_turns(spark, sf_dir), 4)


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 OR turn > 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4")
def conv_after_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.after_checkpoint(_turns(spark, sf_dir), _checkpoints(spark, sf_dir), 4)


@query("WITH n AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS exchange FROM conversations) SELECT conv_id, exchange, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS replies, min(turn) AS first_turn FROM n GROUP BY conv_id, exchange")
def conv_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exchanges(_turns(spark, sf_dir))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 OR turn > 2 UNION ALL (SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 = 0 AND turn <= 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)")
def conv_prompt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prompt_turns(_turns(spark, sf_dir), _checkpoints(spark, sf_dir), 1)
