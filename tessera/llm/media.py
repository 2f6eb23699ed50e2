"""Media columns: interleaved document sequences from HTML, payloads resolved by digest.

parse_pages() reads HTML into an ordered sequence of structs: text runs, and media references with digest
and caption, at consecutive positions. A media table holds one stored form per digest; resolve() joins the
references to it, by digest, and puts each page's sequence together again in order.

Payloads are stored as a binary greymap: a short header, then one 8-bit sample a byte, 64 to a row. What
is read back comes from the stored bytes, header included. Equal payloads are stored and decoded once, so
a group of copies costs one row of the media table; the references that point to it are small rows.

Defined cases: null HTML or text is empty; a reference without a digest, or with one the table lacks, stays
in its place with null payload; media is captioned by its own figure's caption, else by alt text, else null;
null and repeated page keys are separate pages, told apart by the row number within the input; kept columns must not be
named row, parts or as a part's fields; very long
texts are stored whole; an empty table gives an empty result; columns not asked for are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = 64
SCHEME = "digest:"
PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td blockquote figure figcaption br nav".split())


class _Sequence(HTMLParser):
    """Text runs and media of one page, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] | None = None
        self.hidden = 0

    def flush(self) -> None:
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.parts.append({"kind": "text", "text": run, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BLOCKS or tag in ("img", "video", "audio", "source"):
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source") and (given := dict(attrs)).get("src"):
            src = given["src"]
            part = {"kind": "media", "text": src, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": given.get("alt") or None}
            self.parts.append(part)
            if self.figure is not None:
                self.figure.append(part)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for part in self.figure or []:
                part["caption"] = caption or part["caption"]
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **p} for i, p in enumerate(parser.parts)]


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, row (a number of the input row), the columns to keep and the page's parts in order."""
    rows = pages.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), *keep, F.col(html).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                yield part.drop(columns="html").assign(parts=[sequence(h) for h in part["html"]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "html")
    return rows.mapInPandas(run, f"{kept}, parts {PARTS}")


def store_payloads(payloads: DataFrame) -> DataFrame:
    """(payload) rows -> digest, media: one stored form per different payload."""
    height = F.floor(F.octet_length("payload") / ROW).cast("string")
    header = F.concat(F.lit(f"P5\n{ROW} "), height, F.lit("\n255\n")).cast("binary")
    return payloads.select(F.sha2("payload", 256).alias("digest"), F.concat(header, F.col("payload")).alias("media")).dropDuplicates(["digest"])


def decode(media: bytes) -> np.ndarray:
    """Samples of a stored greymap, rows x 64."""
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit binary greymap")
    return np.frombuffer(samples, np.uint8).reshape(height, width)


def mean_hash(samples: np.ndarray) -> str:
    """64 bits: which columns are brighter than the whole, as 16 hex digits."""
    bits = samples.mean(axis=0, dtype=np.float64) > samples.mean(dtype=np.float64)
    return np.packbits(bits).tobytes().hex()


def describe(media: DataFrame, others: tuple[str, ...] = ("digest",)) -> DataFrame:
    """Decode each stored form: the payload that was read back, and its feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                samples = [decode(m) for m in part["media"]]
                yield part[list(others)].assign(payload=[s.tobytes() for s in samples], feature=[mean_hash(s) for s in samples])

    kept = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in others)
    return media.select(*others, "media").mapInPandas(run, f"{kept}, payload binary, feature string")


def resolve(parsed: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Join each page's media references to the table by digest: key, kept columns, and parts with the given columns, in order.

    Positions stay as they were parsed; text parts and unresolved references have null in the columns. Only references
    with a digest are joined; all other parts go past the join."""
    kept = [c for c in parsed.columns if c not in ("row", "parts")]
    parts = parsed.select("row", *kept, F.explode_outer("parts").alias("part")).select("row", *kept, "part.*")
    held = F.col("digest").isNotNull()
    joined = parts.filter(held).join(table.select("digest", *columns), "digest", "left").select(*parts.columns, *columns)
    rest = parts.filter(~held).select(*parts.columns, *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns])
    part = F.struct("position", "kind", "text", "digest", "caption", *columns)
    own = [F.first(c).alias(c) for c in kept]
    return joined.unionByName(rest).groupBy("row").agg(*own, F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), part))).alias("parts")).drop("row")


def text_payload(text: str | Column) -> Column:
    """UTF-8 bytes of a text, zero bytes appended up to a positive multiple of 64."""
    raw = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.octet_length(raw)
    return F.concat(raw.cast("binary"), F.unhex(F.repeat(F.lit("00"), F.when(n == 0, ROW).otherwise(F.pmod(-n, F.lit(ROW))))))


def _escaped(text: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def document_page(text: Column, digest: Column) -> Column:
    """A document as a page: its first line, a captioned figure of its payload, and its other lines."""
    first = F.substring_index(text, "\n", 1)
    rest = F.substr(text, F.length(first) + 1)
    figure = F.concat(F.lit("</p><figure><img src='" + SCHEME), digest, F.lit("'><figcaption>"), F.lit("payload "), F.substring(digest, 1, 8), F.lit("</figcaption></figure><p>"))
    return F.concat(F.lit("<p>"), _escaped(first), figure, _escaped(rest), F.lit("</p>"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page of its own lines around one figure, whose payload is the document's padded text.

    Besides the contract's columns: the number of parts, the figure's position and caption, and the characters of the text runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("payload", text_payload("text"))
    raw = F.coalesce("text", F.lit(""))
    pages = docs.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), document_page(raw, F.sha2("payload", 256)).alias("html"))
    parsed = parse_pages(pages, "doc_id", keep=("n_bytes",))
    # of text runs only their lengths go on from here; the payload holds the text
    light = F.transform("parts", lambda p: F.when(p.kind == "text", p.withField("text", F.length(p.text).cast("string"))).otherwise(p))
    parsed = parsed.withColumn("parts", light)

    stored = store_payloads(docs.select("payload")).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = describe(stored, ("digest", "media_bytes", "media_sha256")).select(
        "digest", "media_bytes", "media_sha256", "feature", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -ROW, ROW)).alias("tail_crc32"),
    )
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    figure = F.element_at(F.filter("parts", lambda p: p.kind == "media"), 1)
    chars = F.aggregate(F.filter("parts", lambda p: p.kind == "text"), F.lit(0).cast("long"), lambda n, p: n + p.text.cast("long"))
    return resolve(parsed, read, columns).withColumn("m", figure).select(
        F.col("key").alias("doc_id"), "n_bytes", *[F.col(f"m.{c}").alias(c) for c in columns],
        F.size("parts").cast("long").alias("n_parts"), F.col("m.position").cast("long").alias("position"), F.col("m.caption").alias("caption"), chars.alias("text_chars"),
    )
