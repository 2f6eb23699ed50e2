"""Conversation windows over turns (conv, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def pruned(turns: DataFrame, keep: int) -> DataFrame:
    """The turns to be pruned: all but the last `keep`."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > keep).drop("_n")


def after_checkpoint(turns: DataFrame, checkpoints: DataFrame, limit: int) -> DataFrame:
    """Turns behind each conversation's checkpoint, oldest first, at most `limit`."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    later = turns.join(checkpoints, "conv_id", "left").filter(F.col("checkpoint").isNull() | (F.col("turn") > F.col("checkpoint")))
    return later.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n", "checkpoint")


def exchanges(turns: DataFrame) -> DataFrame:
    """Each user turn opens an exchange; what follows up to the next one belongs to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.withColumn("exchange", F.sum((F.col("role") == "user").cast("long")).over(w))
    return numbered.groupBy("conv_id", "exchange").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"), F.min("turn").alias("first_turn"))


def prompt_turns(turns: DataFrame, checkpoints: DataFrame, overlap: int) -> DataFrame:
    """New turns and the last `overlap` before the checkpoint, each once, in order."""
    joined = turns.join(checkpoints, "conv_id", "left")
    new = joined.filter(F.col("checkpoint").isNull() | (F.col("turn") > F.col("checkpoint"))).drop("checkpoint")
    old = newest(joined.filter(F.col("turn") <= F.col("checkpoint")).drop("checkpoint"), overlap)
    return new.unionByName(old).dropDuplicates(["conv_id", "turn"])
