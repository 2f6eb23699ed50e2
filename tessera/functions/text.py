"""Text expressions: chunks, tokens, sentences, sanitising, previews, names. Built-in functions but for the two
chunkers whose next step depends on the last one; those work a row at a time inside batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.postings import BATCH_CHUNKS

# Lines that try to instruct a model.
INJECTION = [
    "ignore (all|any|previous) instructions", "disregard (all|any|previous) instructions", "you are (an|a) (assistant|chatgpt|system)", "act as", "system prompt", "developer message",
    "tool (call|use)", "function (call|use)", "do not answer", "begin prompt", "^system:", "^assistant:", "^user:",
]
# Words that make a sentence procedural.
PROCEDURAL = ["should", "must", "use", "ensure", "avoid", "step", "first", "then", "finally"]
UNKNOWN = "I don't know based on the provided sources."
# Lines at which code may be cut.
CODE_BOUNDARIES = [
    r"[}\])]+[;,]?$", r"(export\s+)?(async\s+)?function\b", r"(export\s+)?class\b", r"(export\s+)?(interface|type|enum)\b", r"(async\s+def|def|class)\b", r"(pub\s+)?fn\b",
    r"(impl|mod|module|namespace)\b", r"(const|let|var)\s+[A-Za-z0-9_$]+\s*=\s*(async\s*)?\(",
]
BLANK = r"^[\s]+|[\s]+$"


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(text, BLANK, "")


def token_chunks(text: Column | str, max_tokens: int = 220, overlap: int = 40) -> Column:
    """Windows of words with their white space; the window that reaches the end is the last."""
    overlap = min(overlap, max_tokens - 1)
    stride = max(1, max_tokens - overlap)
    words = F.regexp_extract_all(stripped(F.coalesce(text, F.lit(""))), F.lit(r"(\S+\s*)"), F.lit(1))

    def windows(w: Column) -> Column:
        last = F.when(F.size(w) <= max_tokens, 0).otherwise(F.ceil((F.size(w) - max_tokens) / stride)).cast("int")
        found = F.transform(F.sequence(F.lit(0), last), lambda i: stripped(F.array_join(F.slice(w, i * stride + 1, F.lit(max_tokens)), "")))
        return F.when(F.size(w) > 0, found).otherwise(F.array().cast("array<string>"))

    # one element that holds the words: all windows share one split of the text
    return F.get(F.transform(F.array(words), windows), F.lit(0))


def pack_characters(text: str, most: int) -> list[str]:
    """Paragraphs packed up to `most` characters; longer ones are cut at white space, unless that is before 60 %."""
    pieces: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        rest = paragraph.strip()
        while len(rest) > most:
            blanks = [m.start() for m in re.finditer(r"\s", rest[: most + 1])]
            cut = blanks[-1] if blanks and blanks[-1] >= int(most * 0.6) else most
            pieces.append(rest[:cut].strip())
            rest = rest[cut:].strip()
        pieces.append(rest)
    out: list[str] = []
    for piece in filter(None, pieces):
        if out and len(out[-1]) + 2 + len(piece) <= most:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
    return out


def pack_code(text: str, most: int, overlap: int) -> list[str]:
    """Lines packed up to `most` words, cut at the last boundary line of a window; the next window repeats up to `overlap` words."""
    lines = text.split("\n")
    cost = [max(1, len(line.split())) for line in lines]
    blank = [not line.strip() for line in lines]
    boundary = [b or any(re.match(p, line.strip()) for p in CODE_BOUNDARIES) for b, line in zip(blank, lines, strict=True)]
    out, at = [], 0
    while True:
        at = next((i for i in range(at, len(lines)) if not blank[i]), len(lines))
        if at == len(lines):
            return out
        end, total = at, 0
        while end < len(lines) and (end == at or total + cost[end] <= most):
            total += cost[end]
            end += 1
        if end < len(lines):
            end = next((i + 1 for i in range(end - 1, at, -1) if boundary[i]), end)
        stop = next((i + 1 for i in range(end - 1, at - 1, -1) if not blank[i]), at + 1)
        out.append("\n".join(lines[at:stop]).strip())
        if stop >= len(lines):
            return out
        again, repeated = stop, 0
        while overlap > 0 and again > at and repeated < overlap and (not repeated or repeated + cost[again - 1] <= overlap):
            again -= 1
            repeated += cost[again]
        again = next((i for i in range(again, stop) if not blank[i]), stop)
        at = again if again > at else min(stop, at + 1)


def chunk_documents(docs: DataFrame, strategy: str = "token", key: str = "doc_id", text: str = "text", max_chars: int = 900, max_tokens: int = 220, overlap: int = 40) -> DataFrame:
    """Doc key, idx, chunk_id and text; a strategy that finds nothing falls back to characters; blank texts give none."""
    if strategy == "token":
        found = docs.select(F.col(key), F.posexplode(token_chunks(text, max_tokens, overlap)).alias("idx", "text"))
    else:
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BATCH_CHUNKS):  # a few texts at a time are objects of Python
                    part = b.slice(at, BATCH_CHUNKS)
                    row, idx, out = [], [], []
                    for i, t in enumerate(part.column("text").to_pylist()):
                        clean = (t or "").strip()
                        cut = pack_code(clean, max_tokens, overlap) if strategy == "code" and clean else []
                        cut = cut or pack_characters(clean, max_chars)
                        row += [i] * len(cut)
                        idx += range(len(cut))
                        out += cut
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row, pa.int64())), pa.array(idx, pa.int32()), pa.array(out, pa.string())], ["key", "idx", "text"])

        kind = rows.schema["key"].dataType.simpleString()
        found = rows.mapInArrow(run, f"key {kind}, idx int, text string").withColumnRenamed("key", key)
    return found.withColumn("chunk_id", F.concat_ws("#", F.col(key).cast("string"), "idx"))


def sanitized(text: Column | str) -> Column:
    """The lines that don't try to instruct a model; blank lines stay."""
    blocked = "(?i)" + "|".join(f"(?:{p})" for p in INJECTION)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: ~stripped(line).rlike(blocked))
    return stripped(F.array_join(lines, "\n"))


def sentences(text: Column | str) -> Column:
    """Sentences of a text, ends kept."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def title(prefix: str, sentence: Column, index: Column) -> Column:
    clean = F.filter(F.split(F.regexp_replace(sentence, r"[^a-zA-Z0-9._:@ -]", " "), r"\s+"), lambda w: w != "")
    return F.when(F.size(clean) > 0, F.concat(F.lit(prefix + ": "), F.array_join(F.slice(clean, 1, 8), " "))).otherwise(F.concat(F.lit(prefix + " "), (index + 1).cast("string")))


def reflections(text: Column | str, most: int = 5) -> Column:
    """(kind, title, content) items: first sentences, procedural ones (all, if none is), and a summary of two."""
    found = sentences(text)
    words = r"(?i)\b(" + "|".join(PROCEDURAL) + r")\b"
    steps = F.filter(found, lambda s: s.rlike(words))
    steps = F.when(F.size(steps) > 0, steps).otherwise(found)
    item = lambda kind, prefix: lambda s, i: F.struct(F.lit(kind).alias("kind"), title(prefix, s, i).alias("title"), s.alias("content"))
    summary = F.when(F.size(found) > 0, F.array(summary_of(text))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.slice(found, 1, most), item("semantic", "Semantic")), F.transform(F.slice(steps, 1, most), item("procedural", "Procedure")), F.transform(summary, item("summary", "Summary")))


def summary_of(text: Column | str) -> Column:
    """The first two sentences."""
    return F.array_join(F.slice(sentences(text), 1, 2), " ")


def page_text(html: Column | str) -> Column:
    """Readable text of a page: no scripts, styles, comments or tags; the common entities resolved."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def path_doc_id(path: Column | str) -> Column:
    """A document id from a path."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/", "__"), " ", "-"), r"[^A-Za-z0-9._-]", "-")
    return F.regexp_replace(F.regexp_replace(flat, "-+", "-"), "^-+|-+$", "")


def preview(text: Column | str, needle: str, width: int = 80) -> Column:
    """A window centred on the first match, marked where it is cut; the start of the text if there is none."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    at = F.locate(needle.lower(), F.lower(flat))
    start = F.when(at > 0, F.greatest(F.lit(1), at - (width - len(needle)) // 2)).otherwise(1)
    cut = F.substr(flat, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width <= F.length(flat), "…").otherwise(""))


def cache_key(text: Column | str) -> Column:
    """A text's key in a cache, blind to white space and case."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


#: Bytes of a feature token, and how many bytes of texts are cut at once.
TOKEN_BYTES, CUT_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789._:@-", np.uint8)), 4 << 20


def _cut_tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The text of each token and all tokens in order, of lower-cased UTF-8; bytes of other letters are never a token's."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = TOKEN_BYTES[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return row, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


def _digests(names: pa.Array) -> bytes:
    """The SHA-256 of each name, one after the other."""
    data, offsets = names.buffers()[2].to_pybytes(), np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1].tolist()
    return b"".join([hashlib.sha256(data[a:b]).digest() for a, b in pairwise(offsets)])


def _feature_sums(docs: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, vec): sums of eight signed hashed features of each token's SHA-256; null at places that no token has. Rows of a key are added up.

    A row's features are summed in place as whole numbers (a feature is one of them by 1020), so equal texts have equal sums, in any
    order of tokens; a batch hashes each token once. Texts without tokens give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                here = np.cumsum(sizes[at:], dtype=np.int64)
                part = b.slice(at, max(1, int(np.searchsorted(here, CUT_BYTES, "right"))))
                at += part.num_rows
                row, found = _cut_tokens([t.encode() for t in part.column("text").to_pylist()])
                if not len(row):
                    continue
                told = found.dictionary_encode()
                word, digests = told.indices.to_numpy(zero_copy_only=False), _digests(told.dictionary)
                byte = np.frombuffer(digests, np.uint8).reshape(-1, 8, 4).astype(np.int64).transpose(2, 1, 0)
                place, x = (byte[0] * 256 + byte[1]) % dim, np.where(byte[2] % 2 == 1, 1.0, -1.0) * (255 + 3 * byte[3])
                size = part.num_rows * dim
                sums = np.zeros(size)
                for own, value in zip(place, x, strict=True):
                    sums += np.bincount(row * dim + own[word], value[word], size)
                # a sum of zero is a place without tokens, or one whose features cancel out: only rows that have some are looked at again
                again = (sums.reshape(-1, dim) == 0).any(axis=1)[row]
                held = sums != 0
                for own in place:
                    held[row[again] * dim + own[word[again]]] = True
                rows = np.unique(row)
                values = pa.array((sums / 1020).reshape(-1, dim)[rows].ravel(), mask=~held.reshape(-1, dim)[rows].ravel())
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), values)], ["key", "vec"])

    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    sums = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, vec array<double>").groupBy("key").agg(F.collect_list("vec").alias("v"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x + y, x, y))
    return sums.select(F.col("key").alias(key), F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0)), add).alias("vec"))


def _normalised(vec: Column) -> Column:
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0))))
    both = F.struct(vec.alias("v"), F.greatest(length, F.lit(1e-300)).alias("n"))  # features that cancel out stay zero
    return F.get(F.transform(F.array(both), lambda b: F.transform(b.v, lambda x: x / b.n)), F.lit(0))


def hashed_features(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """T5: (key, at, x): eight signed hashed features of each token's SHA-256, summed by place and normalised."""
    return _feature_sums(docs, key, text, dim).select(key, F.posexplode(_normalised(F.col("vec"))).alias("at", "x")).filter("x IS NOT NULL")


def feature_vectors(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """T5: (key, vec): hashed_features of all places."""
    return _feature_sums(docs, key, text, dim).select(key, F.transform(_normalised(F.col("vec")), lambda x: F.coalesce(x, F.lit(0.0))).alias("vec"))


def dense_vectors(features: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """(key, at, x) -> key and the vector of all places."""
    filled = features.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    return filled.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("vec"))


#: What code_structure looks for, by name; the first group is the name found.
CODE_NAMES = {
    "exports": r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+([A-Za-z0-9_$]+)",
    "imports": r"(?:\bfrom\s+|\brequire\(\s*|\bimport\s+)['\"]([^'\"]+)['\"]",
    "symbols": r"\b(?:function|class|def|fn|interface|type|enum)\s+([A-Za-z0-9_$]+)",
    "calls": r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
    "routes": r"\.(?:get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]",
    "env": r"process\.env\.([A-Z0-9_]+)",
}


def code_structure(text: Column | str) -> Column:
    """Names a source file exports, imports, defines and calls, its routes and environment variables, sorted."""
    return F.struct(*[F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))).alias(n) for n, p in CODE_NAMES.items()])


def without_empty_chunks(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks with their lines sanitised; those that nothing is left of are dropped."""
    return chunks.withColumn(text, sanitized(text)).filter(F.col(text) != "")
