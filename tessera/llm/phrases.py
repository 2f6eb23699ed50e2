"""Phrase collocation mining over vertical positional inverted lists.

1. Texts become blocks of about BLOCK_TOKENS tokens of one language. A block is a row that holds an inverted list for each
   of its words: the ascending positions where it stands. Piece and document ends take a position of their own, so two
   words are neighbours exactly if their positions are.
2. Level k extends the phrases of k - 1 words: in each block the lists of their occurrences are merge-joined with the lists
   of the words at the next position. The lengths of the new lists, summed over the blocks, are the exact frequencies.
   Positions never leave their block; a level shuffles one row per phrase and task.
3. Frequent phrases of a level go to the blocks as a filter of fixed size (bits). It lets all frequent phrases through, and
   a rare one that slips in is dropped by its own exact frequency, so the filter only saves work. Lists of words that
   it stops are dropped unread.
4. Scores, cuts and covering phrases are joins among frequent phrases only.

A word's id is a 64-bit hash of its language and itself. That no two words share an id is checked against the whole
vocabulary; if two did, the next seed is taken.

Memory: a task holds a block per language, and a text is read in segments that end at a piece's end.

Defined cases: null text is empty and a null language is `und`; texts without a word, and an empty table, give no rows;
repeated rows count each time; ties in a ranking go to the more frequent phrase, then to the smaller one by bytes; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bits import bit_filter, bit_table, holds
from tessera.storage import materialize, release

BLOCK_TOKENS, SEGMENT_BYTES = 1 << 15, 1 << 20
#: A word, or one of the characters that end a piece.
TOKEN = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+|[.,;:!?\n\x0b\x0c\r]")
PIECE_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
ENDS = b".,;:!?\n\x0b\x0c\r"
LIST_COLUMNS = "lang string, words array<string>, ids array<bigint>, counts array<int>, positions array<int>"


class _Block:
    """Tokens of one language, numbered as they come; 0 is a piece's end."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count(1).__next__, {bytes([c]): 0 for c in ENDS})
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, found: list[bytes]) -> None:
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def lists(self, lang: str, seed: int) -> pa.RecordBatch:
        """One row: the words, their ids, and their positions one list after the other."""
        tokens, words = np.concatenate(self.tokens), list(self.numbers)[len(ENDS) :]
        at = np.flatnonzero(tokens).astype(np.int32)
        positions = at[np.argsort(tokens[at], kind="stable")]
        salt = lang.encode() + b"\0"
        ids = np.fromiter((xxhash.xxh64_intdigest(salt + w, seed) for w in words), np.uint64, len(words)).view(np.int64)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        counts = np.bincount(tokens, minlength=len(words) + 1)[1:].astype(np.int32)
        columns = [pa.array([lang]), one(pa.array(words, pa.binary()).cast(pa.string())), one(pa.array(ids)), one(pa.array(counts)), one(pa.array(positions))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "ids", "counts", "positions"])


def segments(data: bytes) -> Iterator[list[bytes]]:
    """Tokens of a text, a bounded part at a time; parts end at a piece's end, the last one with an end added."""
    at = 0
    while at < len(data):
        end = PIECE_END.search(data, at + SEGMENT_BYTES)
        stop = end.end() if end else len(data)
        yield TOKEN.findall(data, at, stop)
        at = stop
    yield [b"."]


def inverted_blocks(docs: DataFrame, lang: str, text: str, seed: int) -> DataFrame:
    """A row per block with its inverted lists."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = defaultdict(_Block)
        for batch in batches:
            for name, value in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                for found in segments(value.as_py().encode().lower()):  # of bytes, lower() changes A-Z only
                    blocks[name].add(found)
                    if blocks[name].size >= BLOCK_TOKENS and found and found[-1] in ENDS:
                        yield blocks.pop(name).lists(name, seed)
        while blocks:
            name, block = blocks.popitem()
            yield block.lists(name, seed)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return rows.mapInArrow(run, LIST_COLUMNS)


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(id, lang, word, f); two rows have one id only if two words share it."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "ids", "counts")).alias("x")).select(F.col("x.ids").alias("id"), "lang", F.col("x.words").alias("word"), F.col("x.counts").cast("long").alias("n"))
    return each.groupBy("id", "lang", "word").agg(F.sum("n").alias("f"))


def shares_ids(words: DataFrame) -> bool:
    return not words.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _rotated(word: str, bits: int) -> Column:
    return F.shiftleft(word, bits).bitwiseOR(F.shiftrightunsigned(word, 64 - bits)) if bits else F.col(word)


def phrase_key(columns: list[str]) -> Column:
    """What stands for a phrase in the filter; `mixed` is the same in numpy."""
    key = F.col(columns[0])
    for k, c in enumerate(columns[1:], 1):
        key = key.bitwiseXOR(_rotated(c, 23 * k % 64))
    return key


def mixed(words: list[np.ndarray]) -> np.ndarray:
    key = words[0].view(np.uint64)
    for k, w in enumerate(words[1:], 1):
        bits, u = np.uint64(23 * k % 64), w.view(np.uint64)
        key = key ^ (u << bits | u >> (np.uint64(64) - bits))
    return key.view(np.int64)


def extended(ids: np.ndarray, counts: np.ndarray, positions: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """Word columns and frequency of the phrases of len(filters) + 1 words in a block, whose parts pass the filters."""
    passed = holds(filters[0], ids)
    positions, word = positions[np.repeat(passed, counts)], np.repeat(ids[passed], counts[passed])
    order = np.argsort(positions, kind="stable")
    positions, word = positions[order], word[order]
    starts, phrase = positions, [word]
    for k in range(1, len(filters) + 1):
        at = np.searchsorted(positions, starts + k)  # both ascend: a merge join of occurrences with the next words' lists
        met = np.flatnonzero(positions[np.minimum(at, len(positions) - 1)] == starts + k)
        starts, phrase = starts[met], [*(c[met] for c in phrase), word[at[met]]]
        parts = [phrase, phrase[1:]] if k < len(filters) else [phrase[1:]]  # the last words of a frequent phrase are frequent too
        ok = np.all([holds(filters[len(part) - 1], mixed(part)) for part in parts], axis=0)
        starts, phrase = starts[ok], [c[ok] for c in phrase]
    order = np.lexsort(phrase[::-1])
    phrase = [c[order] for c in phrase]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in phrase], axis=0)
    first = np.flatnonzero(new)
    return [*(c[first] for c in phrase), np.diff(np.append(first, len(order)))]


def level(blocks: DataFrame, filters: list[np.ndarray], least: int) -> DataFrame:
    """Frequent phrases of one word more than there are filters: columns w1, w2, ... and f."""
    shared = blocks.sparkSession.sparkContext.broadcast(filters)  # each of a fixed size
    names = [f"w{i + 1}" for i in range(len(filters) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts, positions = (batch[c][i].values.to_numpy() for c in ("ids", "counts", "positions"))
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in extended(ids, counts, positions, shared.value)], [*names, "n"])

    counted = blocks.select("ids", "counts", "positions").mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, most_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, ids, f) of all phrases of 1 to most_words words and that frequency, ids being the words'; (lang, n) words of each language."""
    for seed in count():
        blocks = materialize(inverted_blocks(docs, lang, text, seed), "inverted_lists")
        words = materialize(vocabulary(blocks), "vocabulary")
        if not shares_ids(words):
            break
        release(blocks)
        release(words)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.filter(F.col("f") >= least)
    found = known.select("lang", F.col("word").alias("phrase"), F.array("id").alias("ids"), "f")
    filters = [bit_table(bit_filter(known, "id"))]
    named = found
    for k in range(2, most_words + 1):
        names = [f"w{i + 1}" for i in range(k)]
        phrases = materialize(level(blocks, filters, least), f"phrases_{k}")
        filters.append(bit_table(bit_filter(phrases.select(phrase_key(names).alias("key")), "key")))
        last = known.select(F.col("id").alias(names[-1]), "word")
        shorter = named.select("lang", F.col("phrase").alias("before"), F.col("ids").alias("_ids"))
        named = phrases.withColumn("_ids", F.array(*names[:-1])).join(shorter, "_ids").join(last, names[-1])
        named = materialize(named.select("lang", F.concat_ws(" ", "before", "word").alias("phrase"), F.array(*names).alias("ids"), "f"), f"named_{k}")
        found = found.unionByName(named)
    release(blocks)
    return found, totals


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, most_words: int = 4, scale: int = 2_000_000, covered_percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two words or more.

    A phrase scores floor(scale * a / (l + r)) at its lowest-scoring cut. It is dropped if a longer frequent phrase holds its
    words and has at least covered_percent of its frequency. Sums and products are decimals of 38 digits.
    """
    found, totals = frequent_phrases(docs, lang, text, least, most_words)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    size = F.size("ids")
    phrases = found.filter(size > 1)
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.slice("ids", 1, F.col("cut"))).withColumn("right", F.slice("ids", F.col("cut") + 1, size - F.col("cut")))
    part = lambda side, f: found.select(F.col("ids").alias(side), F.col("f").alias(f))
    scored = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    scored = scored.withColumn("_whole", exact("a") * F.lit(scale).cast("decimal(8,0)")).withColumn("_parts", exact("l") + exact("r")).withColumn("score", F.expr("_whole div _parts"))
    scored = scored.groupBy("ids").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda i: F.slice("ids", i, w)))))
    cover = found.filter(size > 2).select(inner.alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = phrases.join(cover, "ids", "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("f") * covered_percent))
    kept = kept.join(scored, "ids").select("lang", "phrase", F.col("f").alias("a"), "least.l", "least.r", "least.score")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's collocations of two to four words."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 5) t(k)
), freq AS (SELECT lang, w[i:i + k - 1] AS words, k, count(*) AS f FROM spans GROUP BY ALL
), known AS (SELECT * FROM freq WHERE f >= 30
), cut AS (SELECT lang, words, f AS a, c, words[:c] AS lw, words[c + 1:] AS rw FROM known, range(1, 4) t(c) WHERE k > c
), cuts AS (
  SELECT cut.lang, cut.words, cut.a, c AS cut, l.f AS l, r.f AS r, (2000000::HUGEINT * cut.a) // (l.f::HUGEINT + r.f) AS score
  FROM cut JOIN known l ON l.lang = cut.lang AND l.words = cut.lw JOIN known r ON r.lang = cut.lang AND r.words = cut.rw
), scored AS (SELECT lang, words, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
), inner_spans AS (SELECT lang, words, k, f, m, unnest(range(1, k - m + 2)) AS i FROM known, range(2, 4) t(m) WHERE m < k
), cover AS (SELECT lang, words[i:i + m - 1] AS words, max(f) AS longer FROM inner_spans GROUP BY ALL
), kept AS (SELECT s.* FROM scored s LEFT JOIN cover c ON c.lang = s.lang AND c.words = s.words WHERE c.longer IS NULL OR 100 * c.longer < 80 * s.a
), ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, score FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE k = 1 GROUP BY lang) t ON t.lang = r.lang WHERE r.rank <= 2000
"""
