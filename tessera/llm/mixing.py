"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source is laid out as a stream of words, split by a hash of the document into shards of
bounded size. Blocks of `block` words are apportioned in two rounds by highest quotients
votes / (2 k + 1): first over the sources (votes: the source's target), then over the shards of each
source (votes: the shard's words), which gives every shard an integer quota. A shard takes its blocks
quota // n times each, and the remaining quota % n as one circular run of blocks from a seeded start.
As documents lie in the stream in seeded hash order, that run is a random choice that leaves all
documents but the two at its ends whole.

No block is ever a row: a document's share follows from its place in the stream in closed form. The
tables of sources and shards are metadata; documents are only windowed within a shard, so a source
with a third of all rows is spread over many tasks.

Defined cases: null or blank text has size 0 and takes nothing; a null source is a source of its own,
after all others; a null document key is hashed like a value; repeated rows are separate documents;
an empty table gives an empty result; other columns pass through untouched, unless they bear one of
the names that are added here, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
SMALL_TABLE_ROWS = 20_000
SPANS = "array<struct<start:bigint,stop:bigint>>"


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _join_metadata(rows: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Broadcast the metadata if a count shows that it is small, else leave the join to the engine."""
    small = meta.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS
    return rows.join(F.broadcast(meta) if small else meta, keys)


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float) -> DataFrame:
    """Add weight and target to (source_key, source_size).

    Sources in key order get the weights in turn. The targets are min(cap, level * weight) with the cap
    max_repeats * size; the level is where they add up to share * all words, which is what repeated
    resharing of the excess by weight arrives at.
    """
    every = Window.partitionBy(F.lit(0))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_n", F.row_number().over(every.orderBy("source_key"))).withColumn("weight", F.element_at(pick, ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_repeats).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = every.orderBy("_ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("_level", level)
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))))
        .select("source_key", "source_size", "weight", "target")
    )


def sainte_lague(cells: DataFrame, group: list[str], key: list[str], votes: str, seats: str, cap: str) -> DataFrame:
    """Add quota: the seats each cell of a group wins by highest quotients votes / (2 k + 1), at most cap.

    With n cells and M seats the winning divisor lies within a factor 1 +- n / (2 M) of the even one, so
    only the few quotients next to it are listed and ranked: about two rows a cell, whatever M is.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    even = F.when(F.col("_votes") > 0, F.col(votes) * F.col(seats) / F.col("_votes")).otherwise(0.0)
    slack = F.when(F.col(seats) > 0, F.count("*").over(w) / (2.0 * F.col(seats))).otherwise(0.0)
    bounded = (
        cells.withColumn("_votes", F.sum(votes).over(w))
        .withColumn("_even", even)
        .withColumn("_slack", slack)
        .withColumn("_low", F.least(F.col(cap), F.greatest(F.lit(0), F.floor(F.col("_even") * (1 - F.col("_slack")) - 0.5))).cast("long"))
        .withColumn("_high", F.least(F.col(cap), F.when(F.col("_even") > 0, F.ceil(F.col("_even") * (1 + F.col("_slack")) + 2.5)).otherwise(0)).cast("long"))
        .withColumn("_rest", F.col(seats) - F.sum("_low").over(w))
    )
    seat = F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k")
    ranked = (
        bounded.filter("_high > _low").select(*group, *key, votes, "_rest", seat)
        .withColumn("_quotient", F.col(votes) / (2.0 * F.col("_k") + 1))
        .withColumn("_place", F.row_number().over(w.orderBy(F.desc("_quotient"), *key)))
    )
    won = ranked.filter("_place <= _rest").groupBy(*group, *key).agg(F.count("*").alias("_won"))
    return bounded.join(won, [*group, *key], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).select(*cells.columns, "quota")


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_repeats: int = 2,
    block: int = 64,
    shard_words: int = 1 << 20,
    shard_rows: int = 1 << 16,
    seed: int = 20,
) -> DataFrame:
    """docs with a column of sizes -> the same rows and
    source_size, target: of the row's source; shard, quota: its shard and that shard's blocks;
    copies: times the whole document is taken; extra: word spans (start, stop) taken once more;
    taken: words taken in all, repeats counted.
    """
    added = ["source_key", "source_size", "weight", "target", "shards", "shard", "cell_size", "quota", "copies", "extra", "taken", "_order", "_a", "_b"]
    rows = docs.drop(*[c for c in added if c in docs.columns])
    rows = rows.withColumn("source_key", F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))).withColumn("_order", F.xxhash64(F.lit(seed), F.col(key), F.col(size)))
    sources = materialize(rows.groupBy("source_key").agg(F.sum(size).alias("source_size"), F.count("*").alias("_docs")), "sources")
    targets = source_targets(sources, weights, share, max_repeats)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_docs") / shard_rows)).cast("int")
    targets = targets.join(sources.select("source_key", "_docs"), "source_key").withColumn("shards", shards).drop("_docs")
    rows = _join_metadata(rows, targets, ["source_key"]).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(size)), F.col("shards")).cast("int"))

    cells = rows.groupBy("source_key", "shard").agg(F.sum(size).alias("cell_size")).withColumn("_blocks", F.ceil(F.col("cell_size") / block)).withColumn("_most", F.col("_blocks") * max_repeats)
    cells = materialize(cells, "cells")
    seats = targets.join(cells.groupBy("source_key").agg(F.sum("_most").alias("_most")), "source_key").withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    seats = sainte_lague(seats, [], ["source_key"], "target", "_seats", "_most").select("source_key", F.col("quota").alias("_seats"))
    quotas = sainte_lague(cells.join(seats, "source_key"), ["source_key"], ["shard"], "cell_size", "_seats", "_most").select("source_key", "shard", "cell_size", "quota", "_blocks")
    quotas = materialize(quotas, "quotas")

    stream = Window.partitionBy("source_key", "shard").orderBy("_order", F.col(key), F.col(size))
    placed = rows.withColumn("_b", F.sum(size).over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.col("_b") - F.col(size))
    placed = _join_metadata(placed, quotas, ["source_key", "shard"])
    first = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source_key"), F.col("shard")), F.col("_blocks"))
    end = first + F.pmod(F.col("quota"), F.col("_blocks"))  # of the run of blocks that are taken once more; past the last block it goes on at the first
    runs = [(first * block, F.least(end * block, F.col("cell_size"))), (F.lit(0), (end - F.col("_blocks")) * block)]
    spans = F.array(*[F.struct((F.greatest(F.col("_a"), lo) - F.col("_a")).cast("long").alias("start"), (F.least(F.col("_b"), hi) - F.col("_a")).cast("long").alias("stop")) for lo, hi in runs])
    return (
        placed.withColumn("copies", F.when(F.col("_blocks") > 0, F.floor(F.col("quota") / F.col("_blocks"))).otherwise(0).cast("long"))
        .withColumn("extra", F.when(F.col("_blocks") > 0, F.array_sort(F.filter(spans, lambda s: s.stop > s.start))).otherwise(F.array().cast(SPANS)))
        .withColumn("taken", F.col("copies") * F.col(size) + F.aggregate("extra", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start))
        .drop("_order", "_a", "_b", "_blocks", "shards", "cell_size", "weight")
    )


def taken_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: every row once for each whole copy, and once with the words of its extra spans.

    A partial row's words are joined by single spaces; whole copies keep their text unchanged.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("extra", lambda s: F.slice(words, (s.start + 1).cast("int"), (s.stop - s.start).cast("int")))), " ")
    whole_extra = F.exists("extra", lambda s: (s.start == 0) & (s.stop == F.col("size")))
    last = F.when(F.size("extra") == 0, F.array().cast("array<string>")).when(whole_extra, F.array(text)).otherwise(F.array(part))
    rows = F.explode(F.concat(F.array_repeat(F.col(text), F.col("copies").cast("int")), last))
    return mixed.select(*[c for c in mixed.columns if c != text], rows.alias(text))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 over sources, 150% of all words, 2 times each at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count("text").alias("size"))
    return mix(materialize(docs, "sizes")).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "extra", "shard", "quota")
