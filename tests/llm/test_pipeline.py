"""The corpus pipeline, stage by stage, against brute force on a small table with planted cases."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from tessera.llm import copies, packing

EMAIL = re.compile(r"[\w.]+@mail\d\.example\.com")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    first = docs.text.iloc[0]
    planted = [(9001, first, "fr", "src0"), (9002, first.replace("\n", " ") + " end", "fr", "src0"), (9003, None, "en", "src1"), (9004, "12 !? 34", None, None), (9005, " ".join(reversed(docs.text.iloc[3].split())) + " write to ab.cd@mail1.example.com now", None, None), (None, "", "en", "src2")]
    planted.append(planted[0])
    rows = [tuple(r) for r in docs[["doc_id", "text", "lang", "source"]].itertuples(index=False)] + planted
    path = tmp_path_factory.mktemp("pipeline")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars", "'clash' AS size")
    table.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["input"] = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/out{i}")
        out[name] = docs = spark.read.parquet(f"{sf_dir}/out{i}")
    return {k: v.toPandas() for k, v in out.items()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "pii", "mixing", "packing"]
    for name in ("language", "near_dedup", "pii", "mixing"):
        assert list(stages[name].columns) == list(stages["input"].columns)


def test_language_rejects_texts_without_letters_only(stages):
    letters = stages["input"].text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert len(stages["language"]) == letters.sum()


def test_near_dedup_keeps_the_first_of_each_group(stages):
    """Groups are linked by a Jaccard similarity of 0.8 of sets of five-word shingles, by all pairs."""
    rows = stages["language"].drop_duplicates(["doc_id", "text"]).sort_values("doc_id")
    sets = [set(copies.shingles(t).tolist()) for t in rows.text]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {int(rows.doc_id.iloc[i]) for i in set(label)}
    assert set(stages["near_dedup"].doc_id) == want and len(stages["near_dedup"]) == len(want)
    assert not {9001, 9002} & want


def test_pii_is_gone_and_clean_texts_stay(stages):
    old, new = stages["near_dedup"].set_index("doc_id").text, stages["pii"].set_index("doc_id").text
    assert set(old.index) == set(new.index) and EMAIL.search(old[9005]) and not any(EMAIL.search(t) for t in new)
    clean = [i for i in old.index if not re.search(r"[\d@=]", old[i])]
    assert clean and all(old[i] == new[i] for i in clean)
    assert (stages["pii"].n_chars == stages["pii"].text.map(len)).all()


def test_mixing_takes_each_sources_share(stages):
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    before, after = stages["pii"], stages["mixing"]
    total = before.text.map(count).sum()
    assert after.text.map(count).sum() == pytest.approx(1.5 * total, rel=0.02)
    size = before.groupby("doc_id").text.first().map(count)
    taken = after.groupby("doc_id").text.apply(lambda s: s.map(count).sum())
    assert (taken <= 2 * size.loc[taken.index]).all()


def test_packing_holds_every_token_once(stages):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = sum(len(x) // 4 + 1 for x in packing.word_ids(path, list(stages["mixing"].text)))
    packed = stages["packing"]
    assert packed["length"].sum() == tokens
    per = packed.groupby("sequence_id").agg(n=("length", "sum"), padded=("padded_length", "first"))
    assert (per.n <= 2048).all() and (per.padded.sum() - per.n.sum()) / per.n.sum() < 0.05


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
