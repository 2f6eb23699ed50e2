"""Near copies against brute-force Jaccard, with copies planted on both sides of 0.8."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import copies


def jaccard(x, y):
    x, y = (set(copies.shingles(t).tolist()) for t in (x, y))
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def planted():
    """Texts of 30 to 400 words and copies with words replaced at the end, so that the similarity is known."""
    rng, rows, pairs = np.random.default_rng(5), [], []
    for k in range(60):
        n = int(rng.integers(30, 400))
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        base = " ".join(words)
        rows.append((len(rows), base))
        for want in (0.5, 0.7, 0.78, 0.80, 0.82, 0.86, 0.90, 0.95):
            cut = round((n - 4) * (1 - want) / (1 + want))
            text = " ".join(words[: n - cut] + [f"x{x}" for x in rng.integers(0, 10**9, cut)])
            pairs.append((len(rows), jaccard(base, text)))
            rows.append((len(rows), text))
    return rows, pairs


def roots(rows, least=0.8):
    """Smallest key of the component of every row, by all pairs."""
    sets = [set(copies.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= least * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {rows[i][0]: rows[x][0] for i, x in enumerate(label)}


def test_equal_to_brute_force(spark, planted):
    rows, pairs = planted
    assert sum(0.8 <= j < 0.95 for _, j in pairs) > 100 and sum(0.6 < j < 0.8 for _, j in pairs) > 60
    out = copies.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.key: r.component_key for r in out} == roots(rows)


def test_blocks_and_tiles_lose_no_link(spark, planted):
    """Small tiles of fingerprints, and components cut in blocks, give what whole ones give."""
    rows, _ = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = "min(struct(key IS NULL AS none, key, text_key)) AS least"
    distinct = copies._sets(docs, "doc_id", "text", 5).groupBy("node").agg(copies.F.expr(order), *[copies.F.first(c).alias(c) for c in ("size", "prefix", "bits", *copies.WORDS)]).cache()
    count = lambda d: copies.components(d).count()
    assert count(copies.candidates(distinct, 0.8)) == count(copies.candidates(distinct, 0.8, tile_rows=60))
    texts = docs.selectExpr("doc_id AS key", "xxhash64(text) AS text_key", "text")
    assert count(copies.links(texts, distinct, 5, 0.8)) == count(copies.links(texts, distinct, 5, 0.8, block_bytes=20_000))


def test_small_sets_of_exactly_the_similarity(spark):
    """Texts of 8 words against 9 and 12 against 14: sets of 4 of 5 and 8 of 10 hashes, all of which are proposed."""
    rng, rows = np.random.default_rng(11), []
    for k in range(400):
        words = [f"v{x}" for x in rng.integers(0, 10**9, 14)]
        short, long = ((8, 9), (12, 14))[k % 2]
        rows += [(2 * k, " ".join(words[:short])), (2 * k + 1, " ".join(words[:long]))]
    got = {r.key: r.component_key for r in copies.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_chains_beyond_the_representative(spark):
    """Each text is near the next one only: all but a few are unlike their component's representative."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(60)] + [(100 + i, " ".join(words[200:260]) + f" tail{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.key: r.component_key for r in copies.copy_groups(docs).collect()} == roots(rows)


@pytest.mark.parametrize("n", range(1, 41))
def test_prefixes_meet(n):
    """Sets at the similarity share one of their first hashes, whatever they don't share."""
    import math

    for m in range(n, math.floor(n / 0.8) + 1):
        both = math.ceil(0.8 * (n + m) / 1.8 - 1e-9)
        if both > n or m > copies.SMALL:
            continue
        # worst case: what isn't shared comes first in both
        assert copies.prefix_length(n, 0.8) > n - both and copies.prefix_length(m, 0.8) > m - both


def test_stage_keeps_what_brute_force_keeps(spark, planted):
    rows, _ = planted
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (7001, None), (7002, " "), rows[3]], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == sorted({*roots(rows).values(), 7001})


def test_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.key: r.component_key for r in copies.copy_groups(docs).collect()} == roots(rows)
