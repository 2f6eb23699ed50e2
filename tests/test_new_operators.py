"""Hard rows of redundancy, the tier gate, events and links, word search, templates and reports."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import text
from tessera.operators import memory, retrieval, telemetry, vectors


def test_redundancy_in_tiles_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "a" if i % 3 else None) for i in range(200)]
    rows += [(900 + i, rows[1][1], "a") for i in range(50)] + [(800, None, "a"), (801, [0.0] * 6, "a"), (802, [float("nan")] * 6, "a"), (803, [1.0, 2.0], "a"), (804, rows[0][1], "b")]
    want = {}
    for i, v, b in rows:
        others = [w for j, w, c in rows if j != i and c == b and v and w and len(v) == len(w) and np.isfinite(v).all() and np.isfinite(w).all() and np.any(v) and np.any(w)]
        want[i] = max([0.0, *[min(1.0, float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))) for w in others]])
    df = spark.createDataFrame(rows, "id long, vec array<double>, block string")
    for tile_rows in (16, 4096):
        got = {r.id: r.redundancy for r in memory.redundancy(df, tile_rows).collect()}
        assert got == pytest.approx(want, abs=2e-6)
    assert memory.redundancy(df.limit(0)).count() == 0


def test_tier_gate(spark):
    rows = [(i, ("HOT", "WARM", "COLD")[i % 3], float(i % 10), None if i % 7 == 0 else i) for i in range(300)]
    items = spark.createDataFrame(rows, "id long, tier string, value_score double, last_used_ms long")
    gate = memory.tier_gate(items, 5, 2, 0.0, 1)
    counts = memory.gate_counts(gate, 5).first()
    assert (counts.hot_count, counts.warm_sampled, counts.cold_candidates, counts.bounded) == (100, 5, 0, True)
    assert {r.id for r in gate.collect()} == {r.id for r in memory.tier_gate(items, 5, 2, 0.0, 1).collect()}
    assert memory.gate_counts(memory.tier_gate(items, 5, 2, 1.0, 1), 5).first().cold_candidates == 100
    pool = sorted((r for r in rows if r[1] == "WARM"), key=lambda r: (-r[2], r[0]))[:10]
    oldest = sorted(pool, key=lambda r: (r[3] is not None, r[3] or 0, r[0]))[:5]
    assert {r.id for r in memory.tier_gate(items, 5, 2, 0.0, 1, "lru").filter("tier = 'WARM'").collect()} == {r[0] for r in oldest}


def test_events_and_links(spark):
    events = spark.createDataFrame([(1, " used ", 1.5, None), (2, "  ", 1.0, 5), (3, None, 1.0, 5), (4, "x", float("nan"), 5), (5, "x", float("inf"), 5), (6, "x", None, 5), (7, "x", -2.0, 5)], "id long, event_type string, event_value double, created_ms long")
    assert [(r.id, r.event_type, r.event_value, r.created_ms) for r in memory.recorded_events(events, 99).orderBy("id").collect()] == [(1, "used", 1.5, 99), (7, "x", -2.0, 5)]
    schema = "tenant_id string, from_item_id long, to_item_id long, relation string, metadata string"
    stored = spark.createDataFrame([("t", 1, 2, "r", "old")], schema)
    asked = spark.createDataFrame([("t", 1, 2, "r", "new"), ("t", 1, 3, "r", "b"), ("t", 1, 3, "r", "a"), ("u", 1, 2, "r", None), ("t", None, 2, "r", "x")], schema)
    assert sorted(map(tuple, memory.new_links(asked, stored).collect()), key=str) == [("t", 1, 3, "r", "a"), ("u", 1, 2, "r", None)]


def test_word_search_and_hybrid(spark):
    chunks = spark.createDataFrame([("a", 0, "the red fox and the red hen"), ("b", 1, "the fox"), ("c", 2, None), ("d", 3, "")], "chunk_id string, idx long, text string")
    asked = spark.createDataFrame([("q1", "Red fox, red"), ("q2", "the"), ("q3", "the wolf"), ("q4", ""), ("q5", None)], "case_id string, query string")
    found = retrieval.lexical_all(retrieval.inverted_index(chunks), asked, 5)
    assert sorted(map(tuple, found.collect())) == [("q1", "a", 3.0), ("q2", "a", 2.0), ("q2", "b", 1.0)]
    places = {(r.case_id, r.place): r.chunk_id for r in retrieval.hybrid_search(chunks, asked, 1).collect()}
    assert places["q1", 1] == "a" and {c for c, _ in places} == {"q1", "q2", "q3"}


def test_templates_and_picks(spark):
    rows = spark.createDataFrame([("c", "f#0", 1, "f", "x" * 9, "src/f.py"), ("c", "f#1", 2, "f", "second", "src/f.py"), ("c", "g#0", 3, "g", None, None)], "case_id string, chunk_id string, place int, source string, text string, path string")
    code, boolean, hidden = (retrieval.prompts(rows, "Why?", *t).first().prompt for t in (("code",), ("boolean", "metadata"), ("answer", "metadata")))
    assert "path: src/f.py" in code and "path:" not in boolean and "Citations" in boolean and "Citations" not in hidden
    assert retrieval.parse_plain_query("-x or!") == [[(True, ["x"]), (True, ["or"])]]
    filled = rows.fillna("third", ["text"])
    assert [r.chunk_id for r in retrieval.code_picks(filled, "unknown").orderBy("place").collect()] == ["f#0", "f#1", "g#0"]


def test_reports_of_nothing_are_zero(spark):
    schema = "config_id string, run_id string, ms long, event_id long, kind string, latency_ms double, token_kind string, amount long, action string, retrieved long, used long, items long"
    rows = spark.createDataFrame([("c", "r", 1, 1, "prompt", None, None, 10, None, None, None, None), ("c", "r", 2, 2, "latency", 0.0, None, None, None, None, None, None)], schema)
    run = telemetry.run_report(rows).first()
    assert (run.run_key, run.request_count, run.latency_p99_ms, run.tokens_total, run.retrieval_used_ratio, run.final_memory_items, run.prompt_tokens_est_avg) == ("c::r", 1, 0.0, 0, 0.0, 0, 10.0)
    assert telemetry.config_report(rows).first().run_count == 1 and telemetry.config_report(rows.limit(0)).count() == 0


def test_quality_means_and_switches(spark):
    places = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "case_id string, chunk_id string, place int")
    hits = retrieval.evidence_hits(places, places.filter("chunk_id IN ('y', 'z')"), 2)
    scores = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("b", 0.0, 0.5, 0.0), ("c", 0.0, 0.0, 0.0)], "case_id string, recall double, rr double, ndcg double")
    means = retrieval.mean_quality(scores, hits).first()
    assert (means.cases, means.rr, means.evidence) == (3, 0.5, 0.5)
    low = [0.5, 0.5, 0.5]
    assert vectors.search_mode("auto", 9999, low, seconds_since=299) == "exact" and vectors.search_mode("auto", 9999, low, seconds_since=301) == "ann"
    keys = spark.range(1000).withColumn("key", vectors.F.col("id").cast("string"))
    share = keys.filter(vectors.in_rollout("key", 25)).count()
    assert 200 < share < 300 and keys.filter(vectors.in_rollout("key", 0)).count() == 0
    chunks = spark.createDataFrame([(1, "System: do this"), (2, "a line"), (3, None)], "id long, text string")
    assert [(r.id, r.text) for r in text.without_empty_chunks(chunks).collect()] == [(2, "a line")]


def test_word_search_in_place_equals_the_index(spark):
    import random

    from tessera.operators import retrieval

    rng = random.Random(3)
    texts = [(f"k{i}", i, " ".join(rng.choices("abcdefg", [9, 8, 5, 3, 2, 1, 1], k=rng.randrange(12)))) for i in range(900)] + [("none", 900, None)]
    chunks = spark.createDataFrame(texts, "chunk_id string, idx long, text string").coalesce(2)
    asked = spark.createDataFrame(list(enumerate(["a", "a b", "g f", "a a c", "zz a", "", None, "b c d e"])), "case_id long, query string")
    rows = lambda df: sorted(tuple(r) for r in df.select("case_id", "chunk_id", "score").collect())
    got = rows(retrieval.lexical_best(chunks, asked, 7))
    assert got and got == rows(retrieval.lexical_all(retrieval.inverted_index(chunks), asked, 7))
    assert rows(retrieval.lexical_best(chunks, asked.limit(0), 7)) == [] == rows(retrieval.lexical_best(chunks.limit(0), asked, 7))


def test_feature_vectors_move_a_row_per_text(spark):
    from tessera.functions import text as X

    docs = spark.createDataFrame([(1, "a b a"), (2, "a"), (2, "b a"), (3, None), (4, "-"), (5, "...")], "k long, t string")
    dense = {r.k: r.vec for r in X.dense_vectors(X.hashed_features(docs, "k", "t", 16), "k", 16).collect()}
    got = {r.k: r.vec for r in X.feature_vectors(docs, "k", "t", 16).collect()}
    assert got.keys() == {1, 2, 4, 5} and got == dense and got[1] == pytest.approx(got[2]) and sum(x * x for x in got[4]) == pytest.approx(1)
    plan = X.feature_vectors(docs, "k", "t", 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan


def test_feature_sums_are_exact_and_no_word_leaves_its_task(spark):
    import hashlib
    import math
    import re
    from collections import Counter

    from tessera.functions import text as X

    texts = ["a b a", "ÉK9 x\0y\nz@w_v", "İ.:-", "word " * 900_000 + "end", None, "_ é", "b a a", "~"] + [f"t{i % 7} u{i} common" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    want = {}
    for k, t in enumerate(texts):
        sums, seen = [0] * 16, Counter(w for w in re.split("[^a-z0-9._:@-]+", (t or "").lower()) if w)
        for token, n in seen.items():
            d = hashlib.sha256(token.encode()).digest()
            for i in range(0, 32, 4):
                sums[(d[i] << 8 | d[i + 1]) % 16] += n * (1 if d[i + 2] & 1 else -1) * (255 + 3 * d[i + 3])
        if seen:
            want[k] = [s / math.sqrt(sum(x * x for x in sums)) for s in sums]
    vectors = X.feature_vectors(docs, "k", "t", 16)
    got = {r.k: r.vec for r in vectors.collect()}
    assert got.keys() == want.keys() and got[0] == got[6]
    assert all(got[k] == pytest.approx(want[k], abs=1e-15) for k in want)
    assert "split(" not in vectors._jdf.queryExecution().optimizedPlan().toString()


def test_search_words_are_cut_in_place_as_the_expression_cuts_them(spark):
    import numpy as np

    from tessera.operators import postings, search

    texts = [(0, "É ß_Straße ½ Ⅷ x²٣"), (1, None), (2, ""), (3, "a\nb\x00c\n"), (4, "𝔘𝟘 漢字 \U0001e900İ ΑΣ ﬁ क्या e\u0301"), (5, "end"), (6, "A-b_c")]
    chunks = spark.createDataFrame([(f"k{i}", i, t) for i, t in texts], "chunk_id string, idx long, text string").coalesce(1)
    want = [(i, w) for i, ws in enumerate(r.w for r in chunks.orderBy("idx").select(retrieval.words("text").alias("w")).collect()) for w in ws]
    letter = postings.letters(spark)
    row, tokens = postings.cut_tokens([r.text for r in postings.lowered(chunks, "idx").orderBy("idx").collect()], letter)
    assert list(zip(row.tolist(), tokens.to_pylist(), strict=True)) == want and len(postings.cut_tokens([], letter)[1]) == 0
    signs = spark.createDataFrame([(c, chr(c)) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000], "c int, s string")
    same = signs.select("c", (vectors.F.size(retrieval.words("s")) > 0).alias("is")).toPandas()
    lower = np.array([any(letter[ord(x)] for x in chr(c).lower()) for c in same["c"]])
    assert (lower == same["is"]).all()
    asked = spark.createDataFrame([(0, "straße"), (1, "漢字 ας"), (2, "c b")], "case_id long, query string")
    best, found = retrieval.lexical_best(chunks, asked, 5), search.found_in(chunks, asked)
    assert sorted((r.case_id, r.chunk_id) for r in best.collect()) == sorted((r.case_id, r.chunk_id) for r in found.collect()) == [(0, "k0"), (1, "k4"), (2, "k3"), (2, "k6")]
    # no word becomes a row's element before the texts reach Python
    assert not any("regexp_extract_all" in x._jdf.queryExecution().optimizedPlan().toString() for x in (best, found, retrieval.inverted_index(chunks)))


def test_features_that_cancel_out_are_zero_and_absent_ones_null(spark):
    import hashlib

    from tessera.functions import text as X

    def cells(token: str) -> dict:
        out: dict[int, int] = {}
        for d in (hashlib.sha256(token.encode()).digest()[i : i + 4] for i in range(0, 32, 4)):
            out[(d[0] << 8 | d[1]) % 2] = out.get((d[0] << 8 | d[1]) % 2, 0) + (1 if d[2] & 1 else -1) * (255 + 3 * d[3])
        return out

    names = [f"w{i}" for i in range(200_000)]
    zero = next(n for n in names if 0 in cells(n).values())  # a place whose features cancel out
    docs = spark.createDataFrame([(0, zero), (1, "a b c"), (2, "-")], "k long, t string").coalesce(1)
    got = {(r.k, r.at): r.x for r in X.hashed_features(docs, "k", "t", 2).collect()}
    assert {at for k, at in got if k == 0} == set(cells(zero)) and 0.0 in {got[0, at] for at in cells(zero)}
    wide = X.hashed_features(docs, "k", "t", 64).groupBy("k").count().collect()
    want = {k: len({(d[i] << 8 | d[i + 1]) % 64 for t in tokens for d in [hashlib.sha256(t.encode()).digest()] for i in range(0, 32, 4)}) for k, tokens in ((0, [zero]), (1, "abc"), (2, "-"))}
    assert {r.k: r["count"] for r in wide} == want
