"""Packing token sequences by minimum bin slack.

Documents become token ids with an end id; whole windows are cut off from the start and the rest of each
document is a piece below the window length. Rests are dealt out by hash and packed in chunks of bounded
size: a window takes the longest rest left and then the multiset of remaining lengths whose sum comes
closest to its capacity. That multiset comes from a subset-sum dynamic programme over a bitset with one
bit per possible sum, with binary splitting of each length's count; going back through the bitsets gives
the counts used, and the same pattern fills further windows as long as its lengths last.

Defined cases: null text is empty, an empty text is the end id alone; null and repeated document keys are
separate documents in separate pieces; very long texts give as many whole windows as they need; an empty
table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from math import ceil
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Bytes of words and ids remembered in each Python worker, and what an entry costs besides; longer words are not kept.
KNOWN_BYTES, ENTRY_BYTES, LONGEST_KEPT = 96 << 20, 200, 64
#: Characters, and words, that go to the tokenizer at once.
PART_CHARS, WORDS_AT_ONCE = 1 << 22, 48
# The normalizer and the pre-tokenizer for which texts may be cut into words here.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same cut for texts of Latin, Greek and Cyrillic letters and common marks.
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\s\w]|_)+")
#: Other characters, a capital sigma (its small form depends on the place) and separators that engines see differently.
OTHER = re.compile(r"[^\x00-\x1b\x20-\u03a2\u03a4-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


class WordIds:
    """Ids of texts, with a memory of words.

    The pre-tokenizer cuts a text into words and the ids of a text are those of its words one after another,
    so words are remembered and only new ones go to the tokenizer, many at once. Texts with characters
    beyond OTHER or with one of the tokenizer's own marks, and texts for any other kind of tokenizer, go to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.whole, self.known, self.held = Tokenizer.from_file(path), {}, 0
        self.words = Tokenizer.from_file(path) if steps == NORMALIZER and cuts == [SPLIT, None] and made["model"].get("end_of_word_suffix") else None
        if self.words:
            self.marks = [x["content"] for x in made.get("added_tokens", [])]
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)  # of each id, whether it ends a word
            for token, i in self.whole.get_vocab().items():
                self.last[i] = token.endswith(made["model"]["end_of_word_suffix"])

    @staticmethod
    def size(words: Iterable[str], ids: Iterable[bytes]) -> int:
        return sum(map(len, words)) + sum(len(x) + ENTRY_BYTES for x in ids)

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def small(self, text: str) -> str | None:
        """The text in small letters, or None if it has to go to the tokenizer whole."""
        if not self.words or OTHER.search(text) or any(m in text for m in self.marks):
            return None
        return (text if is_normalized("NFC", text) else normalize("NFC", text)).lower()

    def encode(self, new: list[str]) -> None:
        """Remember the ids of words that the pre-tokenizer would not cut."""
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, stops = ids.tobytes(), (stops * 4).tolist()
                self.known.update({w: raw[i:j] for w, i, j in zip(part, [0, *stops], stops, strict=False)})
            else:
                self.known.update(zip(part, self.plain(part), strict=True))

    def learn(self, new: list[str]) -> list[str]:
        """Remember the ids of words; returns these and the pieces that had to be learned for them."""
        known, pieces, cut = self.known, set(), {}
        for w in new:
            if w.isalpha():
                pieces.add(w)
            else:
                core = w.rstrip(".,;:!?")
                cut[w] = (core, w[len(core) :]) if core.isalpha() else WORDS.findall(w)
        pieces.update(chain.from_iterable(cut.values()))
        unseen = list(pieces.difference(known))
        self.encode(unseen)
        known.update({w: b"".join([known[x] for x in by]) for w, by in cut.items()})
        return unseen + [w for w in cut if w not in pieces]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        small = [self.small(t or "") for t in texts]
        whole = [i for i, t in enumerate(small) if t is None]
        split = pc.utf8_split_whitespace(pa.array([t or "" for t in small], pa.string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.learn([w for w in words if w not in self.known])
        ids = [self.known[w] for w in words]
        out = gather(ids, coded.indices.to_numpy(), split.value_lengths().to_numpy())
        for i, raw in zip(whole, self.plain([texts[i] for i in whole]) if whole else (), strict=True):
            out[i] = raw
        for w in [w for w in new if len(w) > LONGEST_KEPT]:
            del self.known[w]
        kept = [w for w in new if len(w) <= LONGEST_KEPT]
        self.held += self.size(kept, map(self.known.get, kept))
        if self.held > KNOWN_BYTES:  # the older half goes; common words soon return
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
            self.held = self.size(self.known, self.known.values())
        return out


def gather(ids: list[bytes], index: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Of each text the ids of its words: index has the words of all texts in a row, counts how many each has."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
    n = sizes[index]
    stops = np.concatenate(([0], np.cumsum(n)))
    raw = flat[np.repeat(starts[index] - stops[:-1], n) + np.arange(stops[-1])].tobytes()
    borders = (4 * stops[np.concatenate(([0], np.cumsum(counts)))]).tolist()
    return [raw[i:j] for i, j in zip(borders, borders[1:], strict=False)]


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path](texts)


def parts(texts: list[str | None], rows: int = 1024, chars: int = PART_CHARS) -> Iterator[slice]:
    """Slices of so many texts and characters at most, or of one text."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (i - start == rows or held + n > chars):
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """key, start, length, doc_tokens and ids (little-endian unsigned 32-bit) of every piece."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for part in parts(texts):
                out = []
                for k, ids in zip(b["key"].iloc[part], word_ids(tokenizer, texts[part]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    out += [(k, s, min(window, n - s), n, ids[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                yield pd.DataFrame(out, columns=["key", "start", "length", "doc_tokens", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, start long, length long, doc_tokens long, ids binary")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths, within those there are, whose sum is the largest one up to capacity."""
    full, reach, parts = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            k = min(k, left)
            parts.append((length, k, reach))
            reach |= reach << (length * k) & full
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(parts):
        if not before >> total & 1:
            used[length] += k
            total -= length * k
    return dict(used)


def pack_lengths(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, all of at most `window`."""
    where: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(lengths.tolist()):
        where[x].append(i)
    counts = {x: len(w) for x, w in where.items()}
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for longest in sorted(where, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            pattern = best_fill(counts, window - longest)
            counts[longest] += 1
            pattern[longest] = pattern.get(longest, 0) + 1
            for _ in range(min(counts[x] // n for x, n in pattern.items())):
                at = 0
                for x, n in pattern.items():
                    for _ in range(n):
                        i = where[x].pop()
                        sequence[i], offset[i] = made, at
                        at += x
                made += 1
            for x in pattern:
                counts[x] = len(where[x])
    return sequence, offset


def pack(pieces: DataFrame, window: int = WINDOW, tasks: int | None = None, chunk_rows: int = 20_000) -> DataFrame:
    """Add sequence_id, offset, sequence_tokens and padded_length to pieces (key, start, length, ...).

    A sequence is padded to the window, unless its tokens are a power of two. Pieces are dealt by a hash
    and sorted, so a task that runs again packs alike; chunks bound the memory however many share a hash.
    """
    names = [f.name for f in pieces.schema.fields]
    spark = pieces.sparkSession
    tasks = tasks or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_h", F.xxhash64(*names)).repartition(tasks, "_h").sortWithinPartitions("_h", *names).drop("_h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = TaskContext.get().partitionId() << 40

        def packed(chunk: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            sequence, offset = pack_lengths(chunk["length"].to_numpy(), window)
            tokens = np.bincount(sequence, weights=chunk["length"]).astype(np.int64)
            padded = np.where(tokens & (tokens - 1) == 0, tokens, window)
            out = chunk.assign(sequence_id=sequence + made, offset=offset, sequence_tokens=tokens[sequence], padded_length=padded[sequence])
            made += len(tokens)
            return out

        held, n = [], 0
        for b in batches:
            for at in range(0, len(b), chunk_rows):
                held.append(b.iloc[at : at + chunk_rows])
                n += len(held[-1])
                if n >= chunk_rows:
                    yield packed(pd.concat(held, ignore_index=True))
                    held, n = [], 0
        if n:
            yield packed(pd.concat(held, ignore_index=True))

    added = "sequence_id long, offset long, sequence_tokens long, padded_length long"
    return dealt.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", " + added)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Documents to packed pieces with a checksum of each piece's ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(docs, tokenizer, window=window).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    n, most = docs.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, ceil(n / 5_000)), ceil(n / 200_000))  # each task leaves a window or so unfilled
    return pack(pieces, window, tasks).withColumnRenamed("key", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
