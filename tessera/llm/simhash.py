"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Texts become fingerprints once; equal fingerprints become one row before anything is compared. A
fingerprint's class is the pair of bit counts of its upper and lower half. Two fingerprints within the
radius have classes whose counts differ by the radius at most in sum, so only tiles of such classes
meet; all others are skipped unseen. A class is split by hash into tiles of bounded size, and a pair of
tiles is one group of at most two rows of packed fingerprints. There are at most 33 x 33 classes, so
their table is broadcast.

A pair of tiles reports a spanning forest of its links, never all pairs: a large group of near copies
costs a row per member and pair of classes, and loses no link between components. Comparing all pairs of
tiles is quadratic by its nature; the classes cut the pairs to about a third.

Defined cases: null or blank text has fingerprint zero and links like any other; null keys are kept,
and the smallest key of a component is its smallest non-null one, null if it has none; repeated rows
fall in one component; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.graphs import components
from tessera.storage import materialize

SEED = 42


def fingerprint(text: str | None, ngram: int = 4) -> int:
    """Majority bits of the XXH64 values of the word n-grams, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(ngram, len(words)) - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    set_bits = bits.sum(axis=0, dtype=np.uint32) * 2 > len(bits)
    return int(np.packbits(set_bits).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = 4) -> DataFrame:
    """key, text_key (a hash of the text) and fp of every row."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "text_key": b["text_key"], "fp": np.array([fingerprint(t, ngram) for t in b["text"]], np.int64)})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, text_key long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices into a and b) that connect what all links within the radius connect."""
    label = np.arange(len(a) + len(b))
    left, right = [], []
    step = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            j = np.flatnonzero(near[i])
            own = label[at + i]
            others, first = np.unique(label[len(a) + j], return_index=True)
            for old, k in zip(others, first, strict=True):
                if old != own:
                    left.append(at + i)
                    right.append(j[k])
                    label[label == old] = own
    return np.array(left, np.int64), np.array(right, np.int64)


def links(fps: DataFrame, radius: int = 4, tile_rows: int = 1 << 15) -> DataFrame:
    """Distinct fp -> (u, v) links between different fingerprints, enough to connect every component."""
    upper, lower = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    classed = fps.select("fp", (upper * 64 + lower).alias("cls"))
    classes = classed.groupBy("cls").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("subs"))  # at most 33 * 33 rows
    offsets = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    tiled = classed.join(F.broadcast(classes), "cls").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    tiles = tiled.groupBy("cls", "sub").agg(F.array_sort(F.collect_list("fp")).alias("fps")).withColumn("tile", F.col("cls").cast("long") * (1 << 31) + F.col("sub"))
    other = F.array(*[F.when((F.floor(F.col("cls") / 64) + x).between(0, 32) & (F.col("cls") % 64 + y).between(0, 32), F.col("cls") + 64 * x + y) for x, y in offsets])
    near = tiles.withColumn("other", F.explode(F.array_compact(other)))
    near = near.join(F.broadcast(classes.select(F.col("cls").alias("other"), F.col("subs").alias("other_subs"))), "other")
    near = near.withColumn("other_sub", F.explode(F.sequence(F.lit(0), F.col("other_subs") - 1))).withColumn("other", F.col("other").cast("long") * (1 << 31) + F.col("other_sub"))
    pairs = near.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fps")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = [np.asarray(x, np.int64).view(np.uint64) for x in group.sort_values("tile")["fps"]]
        i, j = forest(sides[0], sides[-1], radius)
        return pd.DataFrame({"u": sides[0][i].view(np.int64), "v": sides[-1][j].view(np.int64)})

    return pairs.groupBy("a", "b").applyInPandas(compare, "u long, v long").filter("u != v")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = 4, radius: int = 4) -> DataFrame:
    """key, text_key, fp and of its component: component_key (smallest key) and first_text (that row's text_key)."""
    rows = materialize(fingerprints(docs, key, text, ngram), "fingerprints")
    order = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_key")).alias("least")
    distinct = materialize(rows.groupBy("fp").agg(order), "distinct")
    roots = components(links(distinct.select("fp"), radius), "simhash")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", F.col("first.key").alias("component_key"), F.col("first.text_key").alias("first_text"))
    return rows.join(named, "fp").select("key", "text_key", "fp", "component_key", "first_text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_key").alias("component_id"))
