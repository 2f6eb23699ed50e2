"""Approximate nearest neighbours by NN-descent, searched greedily along the graph.

Equal vectors are one node, named by their smallest id, so a large group of copies is a single node and no
list of neighbours fills with copies. The measure is the largest inner product: nodes get one more component that
makes all norms equal, which turns it into nearness between nodes and leaves it as it is for queries.
A node travels as its direction in half precision, its norm and that component in double precision, and scores between
nodes are half the negative squared distance: however long one vector is, it takes no precision from the others.

1. First lists: signs of random projections put nodes into a few small blocks; in each block all compare with all.
   These lists are poor: they only spare the first rounds of a start from random lists.
2. NN-descent: a node's neighbours and a bounded sample of those it is a neighbour of meet at that node, by
   joins; each pair with a fresh side is compared, and what beats a node's farthest neighbour goes back to it.
   Rounds end when few lists change. Every round is a written table.
3. Search: each query keeps a beam of the best nodes seen, expands the best unexpanded ones by a join with
   the graph, and scores the unseen neighbours. It starts from its own neighbours and from the longest vectors, of which
   there is a fixed number. Scores of the final beams are worked out anew in double
   precision on the original vectors, and nodes give way to their ids.

The sample in 2 and the beam in 3 make the result approximate; tests measure the recall against brute force.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those of another length than most; a null id takes no part; rows that repeat an id and vector count once, an
id with several vectors is a candidate with each and is ranked by its best; ties go to the smaller id; fewer candidates than
wanted are all returned; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import materialize, release

#: Searches also start from so many of the longest vectors, which are near many by inner product.
LONG_STARTS = 32
LISTS = "node long, ids array<long>, scores array<float>, fresh array<boolean>"


def _usable(vec: str) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def usable_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """id, vec (double) of the rows that take part."""
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & F.coalesce(_usable("vec"), F.lit(False)))
    most = good.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.filter(F.size("vec") == (most["d"] if most else 0))


def make_nodes(vectors: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, vec, v: packed as in pack_nodes), and (node, id) of each node's `copies` smallest ids."""
    ranked = vectors.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("_n") <= copies)
    ranked = ranked.withColumn("node", F.first("id").over(Window.partitionBy("vec").orderBy("id")))
    ranked = materialize(ranked, "members")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    nodes = ranked.filter("_n = 1").select("node", "vec")
    longest = nodes.agg(F.max(square)).first()[0] or 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                yield part.assign(v=pack_nodes(np.stack(part["vec"]), longest))

    # an id with several vectors would give two nodes one name; a node's name is its id only if that is its own
    twice = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        names = nodes.select("vec", F.xxhash64("node", "vec").alias("_name"))
        nodes = nodes.join(names, "vec").select(F.col("_name").alias("node"), "vec")
        ranked = ranked.join(names, "vec").select(F.col("_name").alias("node"), "id")
    return materialize(nodes.mapInPandas(run, "node long, vec array<double>, v binary"), "nodes"), ranked.select("node", "id")


def pack_nodes(x: np.ndarray, longest: float) -> list[bytes]:
    """Rows as bytes: norm and extra component as doubles, then the direction in half precision; longest: the largest squared norm."""
    square = (x * x).sum(axis=1)
    norm = np.sqrt(square)
    pair = np.column_stack((norm, np.sqrt(np.maximum(0, longest - square)))).astype("<f8")
    return [a.tobytes() + b.tobytes() for a, b in zip(pair, (x / norm[:, None]).astype("<f2"), strict=True)]


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (single precision), norms and extra components."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    pair = np.ascontiguousarray(raw[:, :16]).view("<f8")
    return np.ascontiguousarray(raw[:, 16:]).view("<f2").astype(np.float32), pair[:, 0], pair[:, 1]


def _between(a: tuple, b: tuple) -> np.ndarray:
    """Half the negative squared distance of nodes, extra component included."""
    (x, n, e), (y, m, f) = a, b
    # |x|^2 + |y|^2 - 2 x y and the square of the difference of the extra components, each without cancellation against the longest
    gap = e[:, None] - f[None, :]
    return (-0.5 * (n[:, None] ** 2 + m[None, :] ** 2 + gap * gap) + (x @ y.T).astype(np.float64) * n[:, None] * m[None, :]).astype(np.float32)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k largest of each row."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """Several lists of a node -> its k best different neighbours. A neighbour in an older list isn't fresh."""
    grouped = lists.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"), F.flatten(F.collect_list("fresh")).alias("fresh"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, ids, scores, fresh in zip(b["node"], b["ids"], b["scores"], b["fresh"], strict=True):
                order = np.lexsort((np.asarray(fresh, bool), ids))
                ids, scores, fresh = ids[order], scores[order], np.asarray(fresh, bool)[order]
                own = np.concatenate(([True], ids[1:] != ids[:-1])) & (ids != node)
                ids, scores, fresh = ids[own], scores[own], fresh[own]
                top = np.lexsort((ids, -scores))[:k]
                out.append((node, ids[top], scores[top], fresh[top]))
            yield pd.DataFrame(out, columns=["node", "ids", "scores", "fresh"])

    return grouped.mapInPandas(run, LISTS)


def first_lists(nodes: DataFrame, k: int, trees: int, block: int, seed: int) -> DataFrame:
    """Neighbours found by full comparison within random blocks."""
    n = nodes.count()
    bits = max(0, ceil(log2(max(1, n) / block)))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                x = _unpack(list(part["v"]))[0]
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees, bits + 1)).astype(np.float32)
                p = np.einsum("nd,dtb->tnb", x, planes)
                for t in range(trees if bits else 1):
                    yield pd.DataFrame({"tree": t, "code": (p[t, :, :bits] > 0) @ (1 << np.arange(bits)) if bits else 0, "place": p[t, :, bits], "node": part["node"], "v": part["v"]})

    coded = nodes.select("node", "v").mapInPandas(code, "tree int, code long, place float, node long, v binary")
    blocks = coded.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("tree", "code").orderBy("place", "node")) - 1) / block).cast("int"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unpack(list(group["v"])), group["node"].to_numpy()
        out_ids, out_scores = [], []
        for at in range(0, len(ids), 512):
            s = _between(tuple(c[at : at + 512] for c in x), x)
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            top = _best(s, k)
            got = np.take_along_axis(s, top, 1)
            out_ids += [ids[t[g > -np.inf]] for t, g in zip(top, got, strict=True)]
            out_scores += [g[g > -np.inf] for g in got]
        return pd.DataFrame({"node": ids, "ids": out_ids, "scores": out_scores, "fresh": [np.ones(len(i), bool) for i in out_ids]})

    return _merge(blocks.groupBy("tree", "code", "block").applyInPandas(compare, LISTS), k)


def _reversed(edges: DataFrame, most: int, *first: Column) -> DataFrame:
    """(v, u) edges turned round, at most `most` for each new v: those that sort first, then by hash."""
    turned = edges.select(*[F.col({"v": "u", "u": "v"}.get(c, c)).alias(c) for c in edges.columns])
    order = [*first, F.xxhash64("v", "u"), F.col("u")]
    return turned.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def descend(graph: DataFrame, nodes: DataFrame, k: int, reverse: int, reply: int) -> DataFrame:
    """One round of NN-descent."""
    edges = graph.select(F.col("node").alias("v"), F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("v", F.col("e.ids").alias("u"), F.col("e.fresh").alias("fresh"))
    met = edges.unionByName(_reversed(edges, reverse, F.desc("fresh")))
    farthest = F.when(F.size("scores") < k, F.lit(float("-inf"))).otherwise(F.array_min("scores")).cast("float")
    known = nodes.select(F.col("node").alias("u"), "v").withColumnRenamed("v", "bytes").join(graph.select(F.col("node").alias("u"), farthest.alias("farthest")), "u")
    groups = met.join(known, "u").groupBy("v").agg(F.collect_list("u").alias("ids"), F.collect_list("fresh").alias("fresh"), F.collect_list("farthest").alias("farthest"), F.collect_list("bytes").alias("bytes"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes_, ids_, scores_ = [], [], []
            for ids, fresh, farthest, blobs in zip(b["ids"], b["fresh"], b["farthest"], b["bytes"], strict=True):
                ids, first = np.unique(ids, return_index=True)
                fresh, farthest = np.asarray(fresh, bool)[first], np.asarray(farthest, np.float32)[first]
                x = _unpack([blobs[i] for i in first])
                s = _between(x, x)
                s[~((fresh[:, None] | fresh[None, :]) & (s > farthest[:, None]))] = -np.inf
                np.fill_diagonal(s, -np.inf)
                top = _best(s, reply)
                got = np.take_along_axis(s, top, 1)
                for i in np.flatnonzero(got.max(axis=1) > -np.inf):
                    good = got[i] > -np.inf
                    nodes_.append(ids[i])
                    ids_.append(ids[top[i][good]])
                    scores_.append(got[i][good])
            if not nodes_:
                continue
            yield pd.DataFrame({"node": nodes_, "ids": ids_, "scores": scores_, "fresh": [np.ones(len(i), bool) for i in ids_]})

    replies = groups.mapInPandas(compare, LISTS)
    old = graph.withColumn("fresh", F.transform("ids", lambda _: F.lit(False)))
    return _merge(old.unionByName(replies), k)


def build_graph(nodes: DataFrame, k: int = 40, trees: int = 4, block: int = 64, reverse: int = 24, reply: int = 10, rounds: int = 12, changed: float = 0.01, seed: int = 5) -> DataFrame:
    """node, ids, scores of about k near neighbours of every node."""
    graph = materialize(first_lists(nodes, k, trees, block, seed), "graph")
    for _ in range(rounds):
        previous, graph = graph, materialize(descend(graph, nodes, k, reverse, reply), "graph")
        release(previous)
        if (graph.agg(F.avg(F.aggregate("fresh", F.lit(0.0), lambda n, f: n + F.when(f, 1.0).otherwise(0.0)) / k)).first()[0] or 0.0) < changed:
            break
    return graph


def _as_queries(nodes: DataFrame, longest: list) -> DataFrame:
    """q, query (direction in half precision) and the beam to begin with: scores of the longest vectors, (node, v) rows."""
    ids = np.array([r["node"] for r in longest], np.int64)
    x, norm, _ = _unpack([bytes(r["v"]) for r in longest]) if len(ids) else (None, None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                d = _unpack(list(part["v"]))[0]
                scores = (d @ x.T) * norm.astype(np.float32)
                yield pd.DataFrame({"q": part["node"], "query": [r.tobytes() for r in d.astype("<f2")], "long": [ids] * len(d), "scores": list(scores.astype(np.float32))})

    return nodes.select("node", "v").mapInPandas(run, "q long, query binary, long array<long>, scores array<float>")


def search(graph: DataFrame, nodes: DataFrame, start: DataFrame, beam: int = 128, expand: int = 16, rounds: int = 5, reverse: int = 24) -> DataFrame:
    """(q, query, long and scores as in _as_queries, ids to start from) -> q, and the ids of its final beam."""
    edges = graph.select(F.col("node").alias("v"), F.explode("ids").alias("u"))
    adjacent = materialize(edges.unionByName(_reversed(edges, reverse)).groupBy("v").agg(F.collect_set("u").alias("near")), "adjacent")
    state = start.select("q", "query", F.col("long").alias("seen"), F.col("long").alias("ids"), "scores", F.transform("long", lambda _: F.lit(False)).alias("done"), F.lit(True).alias("open"))
    state, asked = materialize(state, "beams"), start.select("q", F.explode(F.array_except("ids", "long")).alias("w"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ids, scores, done, seen = r.ids, np.asarray(r.scores, np.float32), np.asarray(r.done, bool), r.seen
                if r.new is not None and len(r.new):
                    x, norm, _ = _unpack(list(r.blobs))
                    s = (x @ np.frombuffer(r.query, "<f2").astype(np.float32)) * norm.astype(np.float32)
                    ids, scores, done = np.concatenate((ids, r.new)), np.concatenate((scores, s)), np.concatenate((done, np.zeros(len(s), bool)))
                    seen = np.concatenate((seen, r.new))
                top = np.lexsort((ids, -scores))[:beam]
                out.append((r.q, r.query, seen, ids[top], scores[top], done[top], not done[top].all()))
            yield pd.DataFrame(out, columns=["q", "query", "seen", "ids", "scores", "done", "open"])

    for step in range(rounds):
        found = asked.join(nodes.select(F.col("node").alias("w"), "v"), "w").groupBy("q").agg(F.collect_list("w").alias("new"), F.collect_list("v").alias("blobs"))
        previous, state = state, materialize(state.join(found, "q", "left").mapInPandas(score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)), "beams")
        release(previous)
        if step == rounds - 1 or state.filter("open").isEmpty():
            break
        # the best open nodes are expanded: they are marked here, and their unseen neighbours are asked for
        opened = F.slice(F.filter("ids", lambda x, i: ~F.get("done", i)), 1, expand)
        chosen = state.withColumn("chosen", opened)
        near = chosen.select("q", F.explode("chosen").alias("v")).join(adjacent, "v").select("q", F.explode("near").alias("w")).distinct()
        asked = near.join(chosen.select("q", F.explode("seen").alias("w")), ["q", "w"], "left_anti")
        state = chosen.withColumn("done", F.zip_with("done", "ids", lambda d, x: d | F.array_contains("chosen", x))).drop("chosen")
        asked = materialize(asked, "asked")
        state = materialize(state, "beams")
    return state.select("q", "ids")


def nearest(graph: DataFrame, nodes: DataFrame, members: DataFrame, queries: DataFrame, k: int = 20, **settings: int) -> DataFrame:
    """(query_id, node) queries that are rows themselves -> query_id, rank, vec_id, score of the k nearest others."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    longest = nodes.orderBy(square.desc(), "node").select("node", "v").limit(LONG_STARTS).collect()
    asked = queries.select("node").distinct()
    start = _as_queries(asked.join(nodes.select("node", "v"), "node"), longest).join(graph.select(F.col("node").alias("q"), F.col("ids").alias("near")), "q", "left")
    start = start.withColumn("ids", F.concat(F.array("q"), F.coalesce("near", F.array().cast("array<long>"))))
    found = search(graph, nodes, start, **settings).select("q", F.explode("ids").alias("node"))
    exact = found.join(nodes.select("node", "vec"), "node").join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("query")), "q")
    dot = F.aggregate(F.zip_with("vec", "query", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = exact.select("q", "node", dot.alias("score")).join(members, "node").groupBy("q", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    few = scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")
    of_query = few.join(queries.select("query_id", F.col("node").alias("q")), "q").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return of_query.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    vectors = usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    nodes, members = make_nodes(vectors, copies=21)
    graph = build_graph(nodes)
    node_of = vectors.filter("id % 20 = 0").distinct().join(nodes.select("node", "vec"), "vec").select(F.col("id").alias("query_id"), "node")
    return nearest(graph, nodes, members, materialize(node_of, "queries"))
