"""Queries without an SQL counterpart against plain loops over the whole tables."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tessera.functions.text import UNKNOWN
from tessera.operators import retrieval as R
from tessera.plans import retrieval_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def picks(spark):
    cases: dict[str, list] = {}
    for r in Q._picks(spark, SF).collect():
        cases.setdefault(r.case_id, []).append(r)
    return {c: sorted(own, key=lambda r: r.place) for c, own in cases.items()}


def by_characters(text: str, most: int) -> list[str]:
    parts: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text.strip()):
        rest = paragraph.strip()
        while len(rest) > most:
            at = max((i for i in range(most + 1) if rest[i].isspace()), default=-1)
            at = at if at >= int(0.6 * most) else most
            parts, rest = [*parts, rest[:at].strip()], rest[at:].strip()
        parts.append(rest)
    packed: list[list[str]] = []
    for part in filter(None, parts):
        if packed and len("\n\n".join([*packed[-1], part])) <= most:
            packed[-1].append(part)
        else:
            packed.append([part])
    return ["\n\n".join(p) for p in packed]


def test_chunk_char(spark, documents):
    got: dict[int, dict] = {}
    for r in entry.queries()["chunk_char"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.idx] = r.text
    for key, text in documents.items():
        own = got.get(key, {})
        assert [own[i] for i in range(len(own))] == by_characters(text or "", 900), key


def test_chunk_code(spark, documents):
    got: dict[int, dict] = {}
    for r in entry.queries()["chunk_code"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.idx] = r.text
    for key, text in documents.items():
        lines, at = [x.strip() for x in (text or "").strip().split("\n")], 0
        for i in range(len(got.get(key, {}))):
            own = [x.strip() for x in got[key][i].split("\n")]
            start = next((s for s in range(at, -1, -1) if lines[s : s + len(own)] == own), None)  # the next line, or up to the overlap before it
            assert start is not None and sum(max(1, len(x.split())) for x in lines[start + 1 : at]) <= 20, (key, i)
            assert sum(max(1, len(x.split())) for x in own) <= 220 or len(own) == 1
            at = start + len(own)
            while at < len(lines) and not lines[at]:
                at += 1
        assert at >= len(lines) or not (text or "").strip(), key


def chosen(rows: list, most: int, chars: int, per_source: int, sources: int) -> list[str]:
    order, seen = [], []
    for r in rows:
        if r.source not in seen:
            seen.append(r.source)
            if len(seen) <= sources:
                order.append(r)
    order += [r for r in rows if r not in order]
    kept: list = []
    for r in order:
        fits = not kept or sum(len(k.text) for k in kept) + len(r.text) <= chars
        if len(kept) < most and sum(k.source == r.source for k in kept) < per_source and (fits or r is order[0]):
            kept.append(r)
    return sorted(k.chunk_id for k in kept)


@pytest.mark.parametrize(("name", "limits"), [("diverse_sources", (12, 12_000, 3, 4)), ("code_file_picks", (R.CODE_SIZES["debug"], 1 << 62, 1 << 30, 1 << 30))])
def test_selection(spark, picks, name, limits):
    got: dict[str, list] = {}
    for r in entry.queries()[name](spark, SF).collect():
        got.setdefault(r.case_id, []).append(r.chunk_id)
    assert {c: sorted(own) for c, own in got.items()} == {c: chosen(own, *limits) for c, own in picks.items()}


def test_prefix_dedup(spark, picks):
    got: dict[str, list] = {}
    for r in entry.queries()["prefix_dedup"](spark, SF).collect():
        got.setdefault(r.case_id, []).append(r.chunk_id)
    for case, rows in picks.items():
        kept: list = []
        for r in rows:
            clash = False
            for k in kept:
                n = min(len(k.text), len(r.text))
                same = 0
                while same < n and k.text[same] == r.text[same]:
                    same += 1
                clash |= k.source == r.source and n >= 80 and same > 0.6 * n
            if not clash:
                kept.append(r)
        assert sorted(got[case]) == sorted(k.chunk_id for k in kept)


def test_sentence_answer(spark, picks):
    got = {r.case_id: r for r in entry.queries()["sentence_answer"](spark, SF).collect()}
    split = {r.chunk_id: r.s for r in _sentences(spark, picks)}
    assert set(got) == set(picks)
    for case, rows in picks.items():
        terms, best = R.question_terms(rows[0].query), None
        for r in rows[:3]:
            for n, sentence in enumerate(split[r.chunk_id]):
                low = sentence.lower()
                hits = sum(t in low for t in terms) + 2 * sum(f"{a} {b}" in low for a, b in zip(terms, terms[1:], strict=False))
                if hits and (best is None or (-hits, r.place, n) < best[0]):
                    best = ((-hits, r.place, n), sentence, r.chunk_id)
        assert got[case].answer == (best[1] if best else UNKNOWN)
        cited = [best[2]] if best else []
        assert got[case].citations == list(dict.fromkeys(cited + [r.chunk_id for r in rows[:3]]))


def _sentences(spark, picks):
    from tessera.functions.text import sanitized, sentences

    rows = {(r.chunk_id, r.text) for own in picks.values() for r in own if r.place <= 3}
    return spark.createDataFrame(sorted(rows), "chunk_id string, text string").select("chunk_id", sentences(sanitized("text")).alias("s")).collect()
