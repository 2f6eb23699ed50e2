"""Corpus pipeline: language ID, near-dedup, PII, mixing, packing; each stage is one of the operators in tessera.llm.

Every stage but the last returns the columns of documents. Stages work on all rows their predecessor kept.

Defined cases, besides those of the operators: rows without any letter are rejected by the language
stage; rows that repeat a document go in the near-dedup stage, also with a null doc_id; a document that the
mix takes twice is two rows from there on; n_chars follows the text; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.copies import without_copies
from tessera.llm.language import learn_from_documents, predict
from tessera.llm.mixing import mix, taken_texts, word_count
from tessera.llm.packing import pack_documents
from tessera.llm.pii import QUERY_KEY, replace_pii
from tessera.storage import materialize

#: Share of a text's n-grams that must be known to its language; documents below are in none of them.
LEAST_SCORE = 0.2
#: Near copies are texts of this Jaccard similarity of word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in one of the learned languages."""
    told = predict(docs, learn_from_documents(docs))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the document with the smallest doc_id."""
    return without_copies(docs, ngram=SHINGLE_WORDS, least=SIMILARITY)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets."""
    return _counted(replace_pii(docs, QUERY_KEY), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share of the mix; rows repeat as often as they are taken."""
    return _counted(taken_texts(mix(docs.withColumn("size", word_count("text")))), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A language model, connected components and a packing heuristic are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
