"""Operators 11 to 13 against brute force and defined edge cases; SQL of the training-data queries against DuckDB."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import pytest

from tessera.llm import divergence, phrases, sharding
from tessera.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, ids int, term string, shard string"


def random_docs(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "É", "x1", "to be", "ΑΒ", "z"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\x0b", "\r\n", "?", " - "]
    rows = []
    for i in range(n):
        text = "".join(rng.choices(words, [9, 8, 7, 3, 3, 2, 2, 2, 1])[0] + rng.choices(ends, [30, 5, 3] + [2] * 7)[0] for _ in range(rng.randrange(60)))
        rows.append((i, rng.choice([text, text, text, None, ""]) if i % 7 == 0 else text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), i, "t", "s"))
    return rows + rows[:5]


@pytest.fixture(scope="module")
def rows():
    return random_docs(150, 3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 11 phrases


def brute_phrases(rows: list[tuple], least: int, top: int) -> set[tuple]:
    freq: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    freq[lang or "und"][tuple(w[i : i + k])] += 1
    out = set()
    for lang, f in freq.items():
        known = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in known.items():
            if len(p) == 1 or any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out |= {(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize(("least", "top", "block"), [(30, 2000, 1 << 20), (3, 40, 1 << 20), (5, 2000, 100)])
def test_collocations_equal_brute_force(rows, docs, least, top, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_TOKENS", block)
    monkeypatch.setattr(phrases, "SEGMENT_BYTES", block)
    got = phrases.collocations(docs, least=least, top=top)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == brute_phrases(rows, least, top)
    assert got.count() == got.distinct().count()


def test_segments_lose_nothing(monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT_BYTES", 5)
    data = b"one two. three four five six seven,eight\nnine"
    assert [t for s in phrases.segments(data) for t in s] == [*phrases.TOKEN.findall(data), b"."]


def test_blocks_hold_inverted_lists(spark):
    block = phrases.inverted_blocks(spark.createDataFrame([("b a. a b a", "en")], "text string, lang string"), "lang", "text", 0).first()
    lists, at = {}, 0
    for word, n in zip(block.words, block.counts, strict=True):
        lists[word], at = block.positions[at : at + n], at + n
    assert lists == {"b": [0, 4], "a": [1, 3, 5]}


def test_a_shared_id_is_noticed(spark):
    words = "id long, lang string, word string, f long"
    assert phrases.shares_ids(spark.createDataFrame([(7, "en", "a", 1), (7, "en", "b", 1)], words))
    assert not phrases.shares_ids(spark.createDataFrame([(7, "en", "a", 1), (8, "en", "b", 1)], words))


def test_no_phrases(spark, empty):
    assert phrases.collocations(empty).count() == 0
    blank = spark.createDataFrame([(None, "en"), ("", None), (" \t", "de"), ("word", "fr")], "text string, lang string")
    assert phrases.collocations(blank).count() == 0


# --- 12 divergence


def brute_divergence(rows: list[tuple], least_docs: int, top: int) -> set[tuple]:
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    seen: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    for lang in seen:
        kept = sorted(t for t, d in seen[lang].items() if d >= least_docs)
        groups = {s: {t: n for t, n in c.items() if t in kept} for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        p = lambda c, t: 1 + floor(Fraction(10**9 * (c.get(t, 0) + 1), sum(c.values()) + len(kept)))  # noqa: E731, B023
        for s, c in groups.items():
            pair = [(-sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept), o.encode()) for o, d in groups.items() if o != s]
            term = [(-((p(c, t) - p(whole, t)) ** 2 // p(whole, t)), t.encode()) for t in kept if c.get(t) and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("least", "top", "held"), [(3, 200, 1 << 19), (1, 2, 3), (1000, 5, 1 << 19)])
def test_divergence_equals_brute_force(rows, docs, least, top, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", held)
    monkeypatch.setattr(divergence, "SEGMENT_BYTES", max(held, 10))
    got = divergence.divergence(docs, least_docs=least, top=top)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == brute_divergence(rows, least, top)


def test_divergence_edges(spark, empty):
    assert divergence.divergence(empty).count() == 0
    lone = divergence.divergence(spark.createDataFrame([(None, None, None), ("a a", "x", "s")] + [("1 2", "x", "t")], "text string, lang string, source string"))
    assert sorted(map(tuple, lone.select("lang", "source", "item", "value", "rank").collect())) == [("x", "s", "t", 0, 1), ("x", "t", "s", 0, 1)]


def test_prices_pass_64_bits(spark):
    big = spark.createDataFrame([(2**62, 2**62, 5)], "n long, total long, v long").select(divergence.price("n", "total", "v").alias("p")).first().p
    assert big == 1 + 10**9 * (2**62 + 1) // (2**62 + 5)


# --- 13 sharding


def brute_place(key: str, tree: sharding.Tree) -> tuple[int, int, int]:
    from hashlib import md5
    from math import log

    def winner(path, children):
        draws = [(-log((int(md5(f"{key}/{path}{c}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1)) / w, c) for c, w in children.items()]
        return min(draws)[1]

    g = winner("", tree.children())
    r = winner(f"{g}.", tree.children(g))
    return g, r, winner(f"{g}.{r}.", tree.children(g, r))


@pytest.fixture(scope="module")
def placed(spark):
    rows = [(i, i % 5) for i in range(12_000)]
    tree = sharding.even_tree()
    told = sharding.place(spark.createDataFrame(rows, "doc_id long, extra int"), tree)
    told = sharding.place(told, tree.grown(), names=("g", "r", "grown"))
    told = sharding.place(told, tree.with_weight(1, 1, 13, 3.0), names=("wg", "wr", "heavier"))
    told = sharding.place(told, tree.with_weight(1, 1, 13, 0.0), names=("og", "or", "without"))
    return told.toPandas()


def test_rows_go_by_weight(placed):
    assert set(placed.shard) == set(range(24)) and (placed.groupby("shard").size() - 500).abs().max() < 5 * 500**0.5
    assert abs((placed.heavier == 13).sum() - 12_000 * 3 / 26) < 5 * (12_000 * 3 / 26) ** 0.5
    for r in placed.head(300).itertuples():
        assert (r.region, r.rack, r.shard) == brute_place(str(r.doc_id), sharding.even_tree())
        assert (r.g, r.r, r.grown) == brute_place(str(r.doc_id), sharding.even_tree().grown())


def test_movement_is_confined(placed):
    moved = placed[placed.shard != placed.grown]
    assert set(moved.grown) == {24} and abs(len(moved) - 12_000 / 25) < 5 * (12_000 / 25) ** 0.5
    changed = placed[placed.shard != placed.heavier]
    assert (changed.wg == 1).all()  # only into the region whose weight rose
    inside = changed[changed.region == 1]
    assert (inside.wr == 1).all() and (inside[inside["rack"] == 1].heavier == 13).all()  # in it only into the rack, in that only into the shard
    assert not (placed.without == 13).any() and (placed[placed.shard != placed.without].region == 1).all()


def test_every_growth_takes_rows_only_into_the_new_shard(spark):
    tree, told = sharding.even_tree(2, 1, 2), spark.range(3000).withColumnRenamed("id", "doc_id")
    for n in range(4, 9):
        assert len(tree.shards) == n
        told = sharding.place(told, tree, names=("g", "r", f"s{n}"))
        tree = tree.grown()
    frame = told.toPandas()
    for n in range(4, 8):
        moved = frame[frame[f"s{n}"] != frame[f"s{n + 1}"]]
        assert len(moved) and set(moved[f"s{n + 1}"]) == {n}


@pytest.mark.parametrize("cell_rows", [7, 50_000])
def test_slots_are_gapless(spark, cell_rows):
    from hashlib import md5

    rows = [(i % 50 if i % 3 else 7, i % 4 if i % 5 else None, i % 2) for i in range(900)] + [(None, None, 0)] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text_crc32 long, shard int").repartition(5)
    got = [tuple(r) for r in sharding.slots(frame, cell_rows=cell_rows).select("shard", "slot", "doc_id", "text_crc32").collect()]
    order = lambda x: int(md5(f"{'null' if x[0] is None else x[0]}:{'' if x[1] is None else x[1]}".encode()).hexdigest()[:15], 16)
    want = []
    for s in (0, 1):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (order(r), r[0] is not None, r[0] or 0))
        want += [(s, i, r[0], r[1]) for i, r in enumerate(own)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sharding.slots(frame.limit(0)).count() == 0


def test_sharded_query_and_files(spark, tmp_path):
    got = QUERIES["op13_shards"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
    assert len(got) == len(texts)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sharding.write_shards(docs, f"{tmp_path}/shards", sharding.even_tree())
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert {(r.doc_id, r.shard) for r in back.collect()} == set(zip(got.doc_id, got.shard, strict=True))


def test_sharding_edges(spark, empty):
    tree = sharding.even_tree()
    assert sharding.place(empty, tree).count() == 0
    rows = sharding.place(spark.createDataFrame([(None, "x", 1, "y"), (None, None, 2, "z")], "doc_id long, text string, region int, shard string"), tree).collect()
    assert rows[0].shard == rows[1].shard and rows[0].text == "x" and isinstance(rows[0].shard, int)


def test_places_use_no_python(spark):
    plan = sharding.place(spark.range(3).withColumnRenamed("id", "doc_id"), sharding.even_tree())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


# --- SQL of the training-data queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, asked = QUERIES[name](spark, SF), c.execute(SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(mine.columns)
    assert sorted(map(repr, map(tuple, mine.select(*names).collect()))) == sorted(map(repr, asked.fetchall()))
