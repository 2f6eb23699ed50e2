"""Substring dedup by seed and extend.

Words that lie in a window of `length` words which also starts earlier are removed. Seeds are winnowed: of each
window's word n-grams the one with the least hash is its anchor, so equal windows have equal anchors at equal
places, and anchors are the only join keys. A unit is a maximal run of windows with one anchor.

1. Scan: each document gives its units with the hashes of anchor and words. Of equal units in a batch only the first
   travels on as it is; later ones bring their partner along, so copies of a passage don't meet in one task.
2. Seed: equal units meet, and each but the first gets the first as its partner. First units whose anchor also has
   other units stay open: they share some windows at most. Counts of units by anchor are pre-aggregated, and no step
   brings all units of an anchor together.
3. Extend: seeds of a document on one diagonal of one partner form a chain. The partner's words around it are
   fetched, compared word by word on the whole diagonal to both sides, and maximal runs of at least `length`
   equal words are repeats. Windows of open units that no such run covers meet by 128-bit hashes of their
   words; all but the first are repeats. A window's first place is never within a repeat, so none is missed.
4. Overlapping repeats of a document merge to maximal spans, and their words go.

Defined cases: null text has no words; a null key comes before all others; rows that repeat a key are
separate documents in the order of their texts' hashes, and rows that repeat key and text are one document
that gets one result for each row; texts of fewer than `length` words keep all; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import materialize, release

LENGTH = 20
NGRAM = 8
#: An odd multiplier for hashes of word runs, and its inverse modulo 2^64: fixed values, any such pair would do.
STEP = 0x9E3779B97F4A7C15
INVERSE = pow(STEP, -1, 1 << 64)
#: Characters of partners' words that a task gives on at once.
BATCH_CHARS = 1 << 22
#: A unit's place is one number: first window << 5 | windows - 1.
FIRST = 5


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at exactly \x20 and \x09-\x0D


class _Powers:
    """Powers of STEP and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (STEP, INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def units(text: str | None, length: int = LENGTH, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: hash of its n-gram, hash of its unit's words, and the unit's place."""
    words = split_words(text)
    if len(words) < length:
        return (np.empty(0, np.int64),) * 3
    digest = xxhash.xxh3_64_digest
    w = np.frombuffer(b"".join([digest(x) for x in words]), np.uint64)
    up, down = _POWERS(len(w) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * up[:-1])))  # modulo 2^64, as are all run hashes
    gram = _mix((sums[ngram:] - sums[:-ngram]) * down[: len(w) - ngram + 1])
    view = np.lib.stride_tricks.sliding_window_view(gram, length - ngram + 1)
    at = view.argmin(axis=1) + np.arange(len(view))  # of each window its anchor, the first of the least
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    anchor = at[first]
    stop = last + length  # the unit's words are those from first to stop
    unit = (sums[stop] - sums[first]) * down[first]
    unit = _mix(unit + (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (anchor - first).astype(np.uint64))
    return gram[anchor].view(np.int64), unit.view(np.int64), first << FIRST | (last - first)


def _kind(docs: DataFrame) -> str:
    return docs.schema["key"].dataType.simpleString()


def _scan(docs: DataFrame, length: int, ngram: int) -> DataFrame:
    """(key, t, text) -> key, t, place, g, u of all units; those with an equal one before them in the batch have its pkey, pt, pplace."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["key", "t"], na_position="first", ignore_index=True)
            found = [units(t, length, ngram) for t in b["text"]]
            n = np.array([len(x[0]) for x in found], np.int64)
            if not n.sum():
                continue
            g, u, place = (np.concatenate([x[i] for x in found]) for i in range(3))
            row = np.repeat(np.arange(len(b)), n)
            order = np.lexsort((u, g))  # stable: equal units stay in order of document and place
            same = np.concatenate(([False], (g[order[1:]] == g[order[:-1]]) & (u[order[1:]] == u[order[:-1]])))
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            later, partner = order[same], order[head[same]]
            out = pd.DataFrame({"key": b["key"].to_numpy()[row], "t": b["t"].to_numpy()[row], "place": place, "pkey": None, "pt": pd.array([pd.NA] * len(g), "Int64"), "pplace": pd.array([pd.NA] * len(g), "Int64")})
            out["pkey"] = out["pkey"].astype(object)
            out.loc[later, "pkey"] = out["key"].to_numpy()[partner]
            out.loc[later, "pt"], out.loc[later, "pplace"] = out["t"].to_numpy()[partner], place[partner]
            g[later] = _mix(later.astype(np.uint64) * np.uint64(STEP)).view(np.int64)  # they need to meet nobody; any spread will do
            yield out.assign(g=g, u=u)

    return docs.mapInPandas(run, f"key {_kind(docs)}, t long, place long, pkey {_kind(docs)}, pt long, pplace long, g long, u long")


def seeds(docs: DataFrame, length: int, ngram: int) -> DataFrame:
    """key, t, place of units that repeat another one, with its pkey, pt, pplace, and of open units, with null in these."""
    known = F.col("pplace").isNotNull()
    equal = Window.partitionBy("g", "u").orderBy("key", "t", "place")  # those that are known stand alone there
    again = F.row_number().over(equal) > 1
    partner = {p: F.when(known, F.col(p)).when(again, F.first(own).over(equal)).alias(p) for p, own in (("pkey", "key"), ("pt", "t"), ("pplace", "place"))}
    met = _scan(docs, length, ngram).select("key", "t", "place", *partner.values(), F.when(~known & ~again, F.col("g")).alias("g"))
    met = materialize(met, "units")
    mixed = met.filter("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    still = met.filter("g IS NOT NULL").join(mixed, "g", "left_semi").drop("g")
    found = materialize(met.filter("g IS NULL").drop("g").unionByName(still), "seeds")
    release(met)
    return found


def chains(found: DataFrame, length: int) -> DataFrame:
    """Repeating units -> key, t, start, stop (words) of runs of them on one diagonal of one partner, with pkey, pt, pstart."""
    first = F.shiftright("place", FIRST)
    placed = found.filter("pplace IS NOT NULL").select("key", "t", "pkey", "pt", first.alias("start"), (first + F.col("place").bitwiseAND(31) + length).alias("stop"), F.shiftright("pplace", FIRST).alias("pstart"))
    of_doc = Window.partitionBy("key", "t").orderBy("start")
    before = lambda c: F.lag(c).over(of_doc)
    goes_on = F.col("pkey").eqNullSafe(before("pkey")) & (F.col("pt") == before("pt")) & (F.col("start") <= before("stop")) & (F.col("pstart") - F.col("start") == before("pstart") - before("start"))
    numbered = placed.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("new").over(of_doc))
    return numbered.groupBy("key", "t", "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("pkey").alias("pkey"), F.first("pt").alias("pt"), F.min("pstart").alias("pstart")).drop("chain")


def _on_document(docs: DataFrame, other: DataFrame, how: str, names: tuple[str, str] = ("key", "t")) -> DataFrame:
    """Join by document; names: the columns of the other side that name it."""
    right = other.withColumnsRenamed({names[0]: "_key", names[1]: "_t"})
    return docs.join(right, docs.key.eqNullSafe(right["_key"]) & (docs.t == right["_t"]), how).drop("_key", "_t")


def _partners(docs: DataFrame, chained: DataFrame, length: int, at_once: int = 256) -> DataFrame:
    """Chains -> key, t, start, lead and words: the partner's words from lead words before the chain to `length` words behind it.

    A partner's text is read once for about `at_once` chains; one with more of them is joined several times."""
    counts = chained.groupBy("pkey", "pt").agg(F.ceil(F.count("*") / at_once).alias("parts")).withColumnsRenamed({"pkey": "_pkey", "pt": "_pt"})
    sized = chained.join(counts, F.col("pkey").eqNullSafe(F.col("_pkey")) & (F.col("pt") == F.col("_pt")))
    part = F.pmod(F.xxhash64("key", "t", "start"), F.col("parts"))
    asked = sized.groupBy("pkey", "pt", part.alias("part")).agg(F.collect_list(F.struct("key", "t", "start", "stop", "pstart")).alias("asked"))
    met = _on_document(docs, asked, "inner", ("pkey", "pt")).select("key", "text", "asked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "t", "start", "lead", "words"]
        for b in batches:
            out, held = [], 0
            for text, chains_ in zip(b["text"], b["asked"], strict=True):
                words = split_words(text)
                for c in chains_:
                    lead = min(c["pstart"], c["start"], length)
                    found = b" ".join(words[c["pstart"] - lead : c["pstart"] + c["stop"] - c["start"] + length]).decode()
                    out.append((c["key"], c["t"], c["start"], lead, found))
                    held += len(found)
                if held > BATCH_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    return met.mapInPandas(run, f"key {_kind(docs)}, t long, start long, lead long, words string")


def equal_runs(words: list[bytes], at: int, other: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal runs of at least `length` words from place `at` on that equal the other side's."""
    same = np.fromiter((x == y for x, y in zip(words[at : at + len(other)], other, strict=False)), bool)
    turns = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0])))).reshape(-1, 2)
    return [(at + int(x), at + int(y)) for x, y in turns if y - x >= length]


def _extend(docs: DataFrame, length: int) -> DataFrame:
    """(key, t, text, places of open units, matches) -> key, t, start, stop of repeats, and with a, b of the windows left open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, ts, spans, hashes = [], [], [], []
            for key, t, text, places, matches in zip(b["key"], b["t"], b["text"], b["places"], b["matches"], strict=True):
                words = split_words(text)
                gone = np.zeros(max(0, len(words) - length + 1), bool)  # of each window, whether a run covers it
                found = []
                for m in matches:
                    found += equal_runs(words, m["start"] - m["lead"], split_words(m["words"]), length)
                for x, y in found:
                    gone[x : y - length + 1] = True
                p = np.asarray(places, np.int64)
                n = (p & 31) + 1
                starts = np.repeat((p >> FIRST) - np.cumsum(n) + n, n) + np.arange(n.sum())
                starts = starts[~gone[starts]].tolist()
                keys += [key] * (len(found) + len(starts))
                ts += [t] * (len(found) + len(starts))
                spans += found + [(s, s + length) for s in starts]
                hashes += [None] * len(found) + [xxhash.xxh3_128_digest(b" ".join(words[s : s + length])) for s in starts]
            none = np.array([h is None for h in hashes], bool)
            h = np.frombuffer(b"".join([h or bytes(16) for h in hashes]), np.int64).reshape(-1, 2)
            at = np.array(spans, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"key": keys, "t": ts, "start": at[:, 0], "stop": at[:, 1], "a": pd.arrays.IntegerArray(h[:, 0].copy(), none), "b": pd.arrays.IntegerArray(h[:, 1].copy(), none)})

    return docs.mapInPandas(run, f"key {_kind(docs)}, t long, start long, stop long, a long, b long")


def _remove(docs: DataFrame) -> DataFrame:
    """(key, t, text, spans) -> key, t, n_words, removed spans (start, stop) and the kept text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                out = []
                for key, t, text, found in b[["key", "t", "text", "spans"]].iloc[lo : lo + 500].itertuples(index=False):
                    words = split_words(text)
                    spans: list[dict] = []
                    kept, at = [], 0
                    if found is not None and len(found):
                        edges = np.asarray(found, np.int64)
                        depth = np.zeros(len(words) + 1, np.int64)
                        np.add.at(depth, edges >> 32, 1)
                        np.add.at(depth, edges & 0xFFFFFFFF, -1)
                        turns = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(depth)[:-1] > 0).astype(np.int8), [0])))).reshape(-1, 2)
                        spans = [{"start": int(x), "stop": int(y)} for x, y in turns]
                        for x, y in turns:
                            kept += words[at:x]
                            at = y
                    out.append((key, t, len(words), spans, b" ".join(kept + words[at:]).decode()))
                yield pd.DataFrame(out, columns=["key", "t", "n_words", "removed", "kept"])

    return docs.mapInPandas(run, f"key {_kind(docs)}, t long, n_words long, removed array<struct<start:long,stop:long>>, kept string")


def _documents(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """key, t, text: each document once; and how often each is there, if any repeats. t tells documents of one key apart."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    times = rows.groupBy("key", "t").agg(F.count("*").alias("n"))
    told = times.groupBy().agg(F.max("n").alias("most"), F.count("*").alias("documents")).first()
    if (told["most"] or 0) > 1:
        return rows.dropDuplicates(["key", "t"]), times
    if rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows = rows.withColumn("t", F.lit(0).cast("long"))  # the key is enough
    return rows, None


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, ngram: int = NGRAM) -> DataFrame:
    """key, n_words, removed (word spans) and kept (the words that stay, joined by one space) of every document."""
    if not ngram <= length <= ngram + 31:
        raise ValueError("length must be within ngram .. ngram + 31")
    rows, times = _documents(docs, key, text)
    found = seeds(rows, length, ngram)

    matches = _partners(rows, chains(found, length), length)
    none = lambda kind: F.lit(None).cast(kind)
    match = "struct<start:long,lead:long,words:string>"
    asked = found.filter("pplace IS NULL").select("key", "t", "place", none(match).alias("match")).unionByName(matches.select("key", "t", none("long").alias("place"), F.struct("start", "lead", "words").alias("match")))
    by_document = asked.groupBy("key", "t").agg(F.collect_list("place").alias("places"), F.collect_list("match").alias("matches"))
    extended = materialize(_extend(_on_document(rows, by_document, "inner"), length), "extended")

    windows = extended.filter("a IS NOT NULL")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("key", "t", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["a", "b"]).filter(~F.col("first").eqNullSafe(F.struct("key", "t", "start")))
    gone = extended.filter("a IS NULL").select("key", "t", "start", "stop").unionByName(later.select("key", "t", "start", "stop"))
    span = F.shiftleft("start", 32) + F.col("stop")
    out = _remove(_on_document(rows, gone.groupBy("key", "t").agg(F.collect_list(span).alias("spans")), "left"))
    if times is not None:
        out = _on_document(out, times, "inner").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select("key", "n_words", "removed", "kept")


def removed_words(spans: str | Column = "removed") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeat earlier windows of 20 words."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("key").alias("doc_id"), "n_words", removed_words().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
