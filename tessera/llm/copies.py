"""Near copies of a Jaccard similarity of word shingles: SimHash tiles propose, whole sets decide.

1. Texts become sets of shingle hashes once, and sets become fingerprints of 256 bits; equal sets become one row before
   anything is compared.
2. Fingerprints are compared tile by tile with exclusive-or and bit counts, as in simhash; tiles whose bit counts differ by
   more than the radius are skipped. The radius follows from the similarity: of two sets at `least`, a bit differs with
   probability p = arccos(2 least / (1 + least)) / pi, and DEVIATIONS standard deviations are added. At 0.8 that is 65 of 256
   bits, where unrelated sets have 128 +- 8. The first 64 bits alone must be within a wider margin (25), which spares most
   pairs the other three words. A pair of tiles reports a spanning forest, never all pairs; its components only say
   which sets to compare.
3. That p holds for large sets. Sets of up to SMALL hashes are also proposed by a hash they share among the first of each,
   which pairs of the similarity must do: no pair whose smaller set has up to `least` * SMALL hashes is missed.
4. All sets of such a component are compared whole. First each meets the component's representative, its smallest set
   by hash: one copy of that a block. Those that are not linked to it then meet all sets of the component, a block of
   them and a block of all in a task; blocks have a bounded number of bytes. A spanning forest of the exact links is
   reported. A failed link thus hides no other, and no link stands unchecked.

Comparing all pairs of tiles is quadratic by its nature; a pair of fingerprints takes about a nanosecond.

Defined cases: as in simhash; null or blank text has the empty set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from math import acos, ceil, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bits import bit_filter, flagged
from tessera.llm.graphs import components
from tessera.llm.simhash import SEED
from tessera.storage import materialize

WORDS = ("w0", "w1", "w2", "w3")
#: Bit counts are classed by so many; standard deviations of the radius, and of the first word's.
CLASS_BITS, DEVIATIONS, FIRST_DEVIATIONS = 8, 4.4, 5.0
#: Sets of so many hashes are also proposed by shared hashes; bytes of sets in a block, about, and what a set counts besides its hashes.
SMALL, BLOCK_BYTES, SET_BYTES = 40, 4 << 20, 4096
#: Odd multipliers that make a hash four: fixed values, any others would do.
SPREAD = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(text: str | None, ngram: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[min(ngram, len(words)) - 1 :], strict=False)])
    return np.unique(np.frombuffer(hashes, np.int64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Four words of majority bits; an empty set has zeros."""
    if not len(hashes):
        return np.zeros(4, np.int64)
    h = hashes.view(np.uint64)[:, None] * SPREAD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    set_bits = np.zeros(256, np.int64)
    for at in range(0, len(h), 1 << 14):
        set_bits += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * set_bits > len(h)).view(np.int64)


def radius(least: float, bits: int, deviations: float) -> int:
    """Differing bits that sets of that similarity keep within."""
    p = acos(2 * least / (1 + least)) / pi
    return ceil(bits * p + deviations * sqrt(bits * p * (1 - p)))


def spanning(n_a: int, n_b: int, same: bool, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that connect what all links between two sides connect; near(i, js) says which of the right ones link to i."""
    label = np.arange(n_a + (0 if same else n_b))
    shift, left, right = 0 if same else n_a, [], []
    for i in range(n_a):
        js = np.flatnonzero(label[shift:] != label[i])
        if same:
            js = js[js > i]
        if not len(js):
            continue
        js = js[near(i, js)]
        others, first = np.unique(label[shift + js], return_index=True)
        if len(others):
            left += [i] * len(others)
            right += js[first].tolist()
            label[np.isin(label, others)] = label[i]
    return left, right


def alike(a: list[np.ndarray], b: list[np.ndarray], same: bool, least: float) -> tuple[list[int], list[int]]:
    """Forest of pairs of sets of that Jaccard similarity."""
    sizes = np.array([len(x) for x in b], np.int64)
    held, owner = np.concatenate(b), np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]

    def near(i: int, js: np.ndarray) -> np.ndarray:
        lo, n = np.searchsorted(held, a[i]), np.searchsorted(held, a[i], "right")
        n -= lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(b))[js]
        return both >= least * (len(a[i]) + sizes[js] - both) - 1e-9

    return spanning(len(a), len(b), same, near)


def near_tiles(a: list[np.ndarray], b: list[np.ndarray], first: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices into a and b) that connect what all links of at most `most` bits, and `first` in the first word, connect."""
    label, left, right = np.arange(len(a[0]) + len(b[0])), [], []
    step = max(1, (1 << 18) // max(1, len(b[0])))
    for at in range(0, len(a[0]), step):
        i, j = np.nonzero(np.bitwise_count(a[0][at : at + step, None] ^ b[0]) <= first)
        i += at
        bits = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(a, b, strict=True))
        close = bits <= most
        i, j = i[close], j[close]
        while len(i):  # of links that join two components at present one stays, and the two become one
            x, y = label[i], label[len(a[0]) + j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if len(i):
                left.append(i[0])
                right.append(j[0])
                label[label == y[0]] = x[0]
    return np.array(left, np.int64), np.array(right, np.int64)


def candidates(distinct: DataFrame, least: float, tile_rows: int = 1 << 15) -> DataFrame:
    """Distinct (node, bits, w0 .. w3) -> (u, v) links between sets that may have the similarity."""
    most, first = radius(least, 256, DEVIATIONS), radius(least, 64, FIRST_DEVIATIONS)
    classed = distinct.select("node", *WORDS, F.floor(F.col("bits") / CLASS_BITS).cast("int").alias("cls"))
    classes = classed.groupBy("cls").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("subs"))  # 256 / CLASS_BITS + 1 rows at most
    tiled = classed.join(F.broadcast(classes), "cls").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    tiles = tiled.groupBy("cls", "sub").agg(*[F.collect_list(c).alias(c) for c in ("node", *WORDS)])
    near = tiles.join(F.broadcast(classes.select(F.col("cls").alias("other"), F.col("subs").alias("other_subs"))), (F.abs(F.col("cls") - F.col("other")) - 1) * CLASS_BITS + 1 <= most)
    near = near.withColumn("other_sub", F.explode(F.sequence(F.lit(0), F.col("other_subs") - 1)))
    tile = lambda cls, sub: F.col(cls).cast("long") * (1 << 31) + F.col(sub)
    near = near.withColumn("tile", tile("cls", "sub")).withColumn("partner", tile("other", "other_sub"))
    pairs = near.select(F.least("tile", "partner").alias("a"), F.greatest("tile", "partner").alias("b"), "tile", "node", *WORDS)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tile")
        x, y = group.iloc[0], group.iloc[-1]
        side = lambda r: [np.asarray(r[c], np.int64).view(np.uint64) for c in WORDS]
        i, j = near_tiles(side(x), side(y), first, most)
        return pd.DataFrame({"u": np.asarray(x["node"], np.int64)[i], "v": np.asarray(y["node"], np.int64)[j]}, dtype=np.int64)

    return pairs.groupBy("a", "b").applyInPandas(compare, "u long, v long").filter("u != v")


def prefix_length(n: int, least: float) -> int:
    """Of sets in one order of their hashes, those of the similarity share one of so many first ones; 0 for an empty or a large set."""
    return n - ceil(least * n - 1e-9) + 1 if 0 < n <= SMALL else 0


def by_shared_hashes(distinct: DataFrame) -> DataFrame:
    """(node, prefix) -> (u, v): of the sets with a hash in their prefix each is linked to the smallest one; a row per set and hash."""
    held = distinct.select("node", F.explode("prefix").alias("hash"))
    least = held.groupBy("hash").agg(F.min("node").alias("u"))
    return held.join(least, "hash").filter("node != u").select("u", F.col("node").alias("v"))


def _sets(docs: DataFrame, key: str, text: str, ngram: int, least: float = 0.8) -> DataFrame:
    """key, text_key, node (a hash of the set), its size, prefix, fingerprint words and their bit count of every row."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes, words, sizes, prefixes = np.empty(len(b), np.int64), np.empty((len(b), 4), np.int64), np.empty(len(b), np.int64), []
            for i, t in enumerate(b["text"]):
                s = shingles(t, ngram)
                sizes[i] = len(s)
                prefixes.append(s[: prefix_length(len(s), least)])
                nodes[i] = np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)
                words[i] = wide_fingerprint(s)
            out = pd.DataFrame({"key": b["key"], "text_key": b["text_key"], "node": nodes, "size": sizes, "prefix": prefixes, "bits": np.bitwise_count(words.view(np.uint64)).sum(axis=1, dtype=np.int64)})
            yield out.assign(**{c: words[:, k] for k, c in enumerate(WORDS)})

    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, text_key long, node long, size long, prefix array<long>, bits long, " + ", ".join(f"{c} long" for c in WORDS))


def _numbered_blocks(sets: DataFrame, name: str, block_bytes: int) -> DataFrame:
    """sets (root, node, size) with their block of about that many bytes within the root, and the number of blocks."""
    blocks = sets.groupBy("root").agg(F.ceil(F.sum(F.col("size") * 8 + SET_BYTES) / block_bytes).cast("int").alias(f"{name}s"))
    return sets.join(blocks, "root").withColumn(name, F.pmod(F.xxhash64("node"), F.col(f"{name}s")).cast("int"))


def links(docs: DataFrame, distinct: DataFrame, ngram: int, least: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, text_key, text) rows and distinct sets -> (u, v) links of the similarity, enough to connect every component."""
    proposed = candidates(distinct, least).unionByName(by_shared_hashes(distinct))
    roots = components(proposed, "candidates")
    roots = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    members = roots.join(distinct.select("node", "size", F.col("least.key").alias("_key"), F.col("least.text_key").alias("_text")), "node")
    members = materialize(members, "candidate_texts")
    docs = flagged(docs, "text_key", bit_filter(members, "_text"), "_may").filter("_may").drop("_may")  # the other texts stay where they are
    texts = docs.join(members, docs.key.eqNullSafe(F.col("_key")) & (docs.text_key == F.col("_text"))).groupBy("root", "node", "size").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["root", "node", "size"]].assign(hashes=[shingles(t, ngram).tobytes() for t in b["text"]])

    held = materialize(_numbered_blocks(texts.select("root", "node", "size", "text").mapInPandas(sets, "root long, node long, size long, hashes binary"), "block", block_bytes), "sets")
    unpacked = lambda g: (g["node"].to_numpy(), [np.frombuffer(h, np.int64) for h in g["hashes"]])

    # each block of a component with a copy of its representative
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = held.filter("node = root").select("root", every.alias("block"), "node", "hashes")
    met = held.filter("node != root").select("root", "block", "node", "hashes").unionByName(first)

    def with_first(group: pd.DataFrame) -> pd.DataFrame:
        is_first = group["node"] == group["root"]
        if is_first.all():
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        nodes, own = unpacked(group[~is_first])
        (one,) = unpacked(group[is_first])[1]
        both = np.array([len(np.intersect1d(one, x, assume_unique=True)) for x in own])
        close = both >= least * (len(one) + np.array([len(x) for x in own]) - both) - 1e-9
        return pd.DataFrame({"u": group["root"].iloc[0], "v": nodes[close]}, dtype=np.int64)

    linked = materialize(met.groupBy("root", "block").applyInPandas(with_first, "u long, v long"), "linked")
    # the others with all sets of their component
    rest = held.filter("node != root").join(linked.select(F.col("v").alias("node")), "node", "left_anti")
    rest = _numbered_blocks(rest.select("root", "node", "size"), "part", block_bytes)
    shapes = rest.select("root", "parts").distinct()
    left = rest.join(held.select("node", "hashes", "blocks"), "node").select("root", "part", every.alias("block"), F.lit(True).alias("left"), "node", "hashes")
    right = held.join(shapes, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.lit(False).alias("left"), "node", "hashes")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (unpacked(group[group["left"] == side].sort_values("node")) for side in (True, False))
        if not len(a[0]) or not len(b[0]):
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        i, j = alike(a[1], b[1], False, least)
        return pd.DataFrame({"u": a[0][i], "v": b[0][j]}, dtype=np.int64)

    others = left.unionByName(right).groupBy("root", "part", "block").applyInPandas(compare, "u long, v long")
    return linked.unionByName(others.filter("u != v"))


def copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = 5, least: float = 0.8) -> DataFrame:
    """key, text_key and of its component: component_key (smallest key) and first_text (that row's text_key)."""
    rows = materialize(_sets(docs, key, text, ngram, least), "shingles")
    order = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_key")).alias("least")
    distinct = materialize(rows.groupBy("node").agg(order, *[F.first(c).alias(c) for c in ("size", "prefix", "bits", *WORDS)]), "distinct")
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    roots = components(links(texts, distinct, ngram, least), "copies").withColumnRenamed("node", "_node")
    rooted = distinct.join(roots, distinct.node == roots["_node"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", F.col("first.key").alias("component_key"), F.col("first.text_key").alias("first_text"))
    return rows.select("key", "text_key", "node").join(named, "node").select("key", "text_key", "component_key", "first_text")


def without_copies(docs: DataFrame, ngram: int = 5, least: float = 0.8) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id; of rows that repeat key and text, one.

    Only rows that may go are shuffled: those whose text is that of a row to remove, or of a repeated one."""
    groups = materialize(copy_groups(docs, ngram=ngram, least=least), "groups")
    doomed = groups.filter(~(F.col("key").eqNullSafe(F.col("component_key")) & (F.col("text_key") == F.col("first_text"))))
    doomed = doomed.select(F.col("key").alias("_copy_key"), F.col("text_key").alias("_copy_text")).distinct()
    repeated = groups.groupBy("key", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
    bits = bit_filter(materialize(doomed.select("_copy_text").unionByName(repeated.select(F.col("text_key").alias("_copy_text"))), "copy_texts"), "_copy_text")
    marked = flagged(docs.withColumn("_text_key", F.xxhash64("text")), "_text_key", bits, "_may_go")
    asked = marked.filter("_may_go")
    kept = asked.join(doomed, asked.doc_id.eqNullSafe(doomed["_copy_key"]) & (asked["_text_key"] == doomed["_copy_text"]), "left_anti").dropDuplicates(["doc_id", "_text_key"])
    return marked.filter(~F.col("_may_go")).select(*docs.columns).unionByName(kept.select(*docs.columns))
