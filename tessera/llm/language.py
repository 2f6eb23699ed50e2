"""Language ID by language-bitmask n-gram filters.

A filter has one slot per hash value and in each slot one bit per language (64 languages to a slice). A
character n-gram sets its language's bit in its slots; the AND of an n-gram's slots gives all languages
that contain it at once. A text's n-grams are looked up, counted per language, and each count is corrected
for the chance hits that the language's fill of the filter lets expect. The largest corrected count wins,
the score is its share of the n-grams.

Training takes whole texts of a sample of about `sample_docs` labelled documents per language (chosen by a
hash of the key; the bound is that parameter). An n-gram belongs to a language if it was counted at least
`least` times and at least `share` as often, by rate, as in the language where it is most frequent; so
quotations in another language don't blur the sets. The filter's size is fixed, so it is collected and
broadcast whatever the corpus holds.

Defined cases: null text and text without a letter are `und` with score 0; so is all text if nothing was
learned; ties go to the language first by code point; a null key is not learned from; repeated rows count
as often as they are there; an empty table gives an empty result; other columns pass through predict().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NGRAM = 4
SLOT_BITS = 19
HASHES = 3
#: Odd multipliers of the n-gram hash and of the slots: fixed values, any others would do.
_CHARS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SLOTS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_hashes(text: str) -> np.ndarray:
    """Hashes of the character n-grams; letters in lower case, all else between them as one blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    c = np.concatenate(([32, 32], np.where(letter, code, 32)[kept], [32, 32])).astype(np.uint64)
    h = c[: -(NGRAM - 1)] * _CHARS[0]
    for k in range(1, NGRAM):
        h += c[k : len(c) - NGRAM + 1 + k] * _CHARS[k]
    return h ^ (h >> np.uint64(31))


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes * m >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in _SLOTS[:HASHES]]


@dataclass
class LanguageFilter:
    """languages in code point order; slices[w][slot]: bits of languages 64 w .. 64 w + 63; chance: hits of unseen n-grams."""

    languages: list[str]
    slices: np.ndarray
    chance: np.ndarray

    def decide(self, text: str | None) -> tuple[str, float]:
        grams = ngram_hashes(text or "")
        if not len(grams) or not self.languages:
            return "und", 0.0
        at = slots(grams)
        counts = []
        for w, part in enumerate(self.slices):
            masks = part[at[0]]
            for s in at[1:]:
                masks = masks & part[s]
            counts += [np.count_nonzero(masks & np.uint64(1 << b)) for b in range(min(64, len(self.languages) - 64 * w))]
        true = np.clip((np.array(counts) - len(grams) * self.chance) / (1 - self.chance), 0, len(grams))
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / len(grams))


def learn(labelled: DataFrame, sample_docs: int = 2000, least: int = 3, share: float = 0.05) -> LanguageFilter:
    """(key, text, lang) rows -> filter. Rows with a null among these are left out."""
    rows = labelled.dropna(subset=["key", "text", "lang"])
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    chosen = F.create_map(*[x for a in languages for x in (F.lit(a), F.lit(min(1.0, sample_docs / sizes[a])))])
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.element_at(chosen, F.col("lang")) * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                for at in range(0, len(texts), 256):
                    grams, n = np.unique(np.concatenate([ngram_hashes(t) for t in texts.iloc[at : at + 256]]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    index = F.create_map(*[x for i, a in enumerate(languages) for x in (F.lit(a), F.lit(i))])
    counted = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = F.create_map(*[x for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect() for x in (F.lit(r["lang"]), F.lit(float(r["n"])))])
    rated = counted.withColumn("rate", F.col("n") / F.element_at(totals, F.col("lang")))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rated.join(best, "gram").filter((F.col("n") >= least) & (F.col("rate") >= share * F.col("best")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in slots(b["gram"].to_numpy().view(np.uint64)):
                yield pd.DataFrame({"slot": s, "slice": b["lang"] // 64, "bit": b["lang"] % 64})

    placed = kept.select("gram", F.element_at(index, F.col("lang")).alias("lang")).mapInPandas(place, "slot long, slice int, bit int")
    masks = placed.groupBy("slot", "slice").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toPandas()  # at most the filter's fixed size
    slices = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
    slices[masks["slice"], masks["slot"]] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(slices[i // 64] & np.uint64(1 << i % 64)) for i in range(len(languages))]) / (1 << SLOT_BITS)
    return LanguageFilter(languages, slices, np.minimum(fill**HASHES, 0.999))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score; other columns pass through, the text only if it is to be kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [shared.value.decide(t) for t in b[text]]
            yield (b if keep_text else b.drop(columns=text)).assign(lang_pred=[x for x, _ in told], score=[x for _, x in told])

    return docs.select(*names).mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if keep_text or f.name != text) + ", lang_pred string, score double")


def held_out(key: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training; a null key is not, but is not learned from either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_from_documents(docs: DataFrame, **settings: float) -> LanguageFilter:
    return learn(docs.filter(~held_out()).select(F.col("doc_id").alias("key"), "text", "lang"), **settings)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn_from_documents(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)
