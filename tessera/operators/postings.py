"""Posting lists of a batch of chunks, built in its task: no text, word or position moves, only what queries find.

Queries are broadcast while their size is bounded; beyond that they meet a stored inverted index by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters and digits of a token, as a regular expression.
LETTER = r"[\p{L}\p{N}]"
#: Chunks whose words are held at once.
BATCH_CHUNKS = 256


_letters: list[np.ndarray] = []


def letters(spark: SparkSession) -> np.ndarray:
    """Whether each code point is a letter or digit, as Spark's own regular expressions know them; asked for once."""
    if not _letters:
        codes = spark.range(0, 0x110000, 1, 4).select(F.col("id").cast("int").alias("code"))
        sign = F.when(F.col("code").between(0xD800, 0xDFFF), "").otherwise(F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32"))
        table = np.zeros(0x110000, bool)
        table[codes.filter(sign.rlike(LETTER)).toArrow().column("code").to_numpy()] = True
        _letters.append(table)
    return _letters[0]


def lowered(chunks: DataFrame, *columns: str) -> DataFrame:
    """What token_batches takes: these columns and the lower-cased text."""
    return chunks.select(*columns, F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def cut_tokens(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The text of each token and all tokens in order: runs of letters and digits, found by code points at once."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    inside = letter[points]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    kept = points[inside]
    sizes = 1 + (kept > 0x7F).astype(np.int32) + (kept > 0x7FF) + (kept > 0xFFFF)
    offsets = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(ends - starts))].astype(np.int32)
    return row, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept.tobytes().decode("utf-32-le").encode()))


def token_batches(batches: Iterator[pa.RecordBatch], letter: np.ndarray, rows: int = BATCH_CHUNKS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """At most `rows` rows of lowered(), the row of each token, and all tokens in order: those of retrieval.words."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, *cut_tokens(part.column("text").to_pylist(), letter)


def places(row: np.ndarray) -> np.ndarray:
    """The place of each token in its row; rows ascend."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def numbered_by_order(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Tokens as numbers that ascend with them, and the different tokens in that order."""
    told = tokens.dictionary_encode()
    order = pc.sort_indices(told.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[told.indices.to_numpy(zero_copy_only=False)], told.dictionary.take(pa.array(order))


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of a are in b; both ascend."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


class Postings:
    """Where the asked words stand in a batch: at(word) are ascending numbers row * span + place."""

    def __init__(self, row: np.ndarray, tokens: pa.Array, vocabulary: pa.Array, margin: int = 0) -> None:
        word = pc.fill_null(pc.index_in(tokens, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        place = places(row)
        self.span = int(place.max(initial=0)) + 1 + margin  # no phrase reaches from one row into the next
        kept = np.flatnonzero(word >= 0)
        order = kept[np.argsort(word[kept], kind="stable")]
        self._at = row[order] * self.span + place[order]
        self._starts = np.searchsorted(word[order], np.arange(len(vocabulary) + 1))
        self.sizes = np.diff(self._starts)

    def at(self, word: int) -> np.ndarray:
        return self._at[self._starts[word] : self._starts[word + 1]]

    def phrase(self, words: np.ndarray) -> np.ndarray:
        """Starts of the words in a row, rarest first."""
        rest = sorted(range(len(words)), key=lambda i: self.sizes[words[i]])
        found = self.at(words[rest[0]]) - rest[0]
        for i in rest[1:]:
            if not len(found):
                break
            found = found[common(found, self.at(words[i]) - i)]
        return found

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Rows with these words in a row."""
        return np.unique(self.phrase(words) // self.span)

    def within(self, word: int, row: int) -> np.ndarray:
        """Places of a word in one row."""
        own = self.at(word)
        low, high = np.searchsorted(own, [row * self.span, (row + 1) * self.span])
        return own[low:high] - row * self.span
