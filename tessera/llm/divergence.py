"""Source divergence audit: how far the term distributions of a language's sources lie apart.

A source gives a term that it holds c times the scaled probability p = 1 + floor(SCALE (c + 1) / (N + V)), with N its terms
and V the language's kept terms. Two probabilities differ by floor((p - q)^2 / q). The sum of that over all V terms is
worked out without a row per term and pair of sources, by inclusion and exclusion over their supports:

- one side: all terms of a source, with the other at count zero, are priced by its histogram (terms by count);
- overlap: terms that both hold are found by joining their postings and counted by the two counts; each such cell is put
  right by f(c, d) - f(c, 0) - f(0, d) + f(0, 0);
- neither: the rest, V less both supports, costs the constant f(0, 0) each.

So the work follows the postings and not V times the pairs. Sums are decimals of 38 digits, as is the numerator of p; the
square of a difference has at most 61 bits.

Terms are counted per batch inside tasks and summed by the engine, so a hot source or language shuffles one row per term
and task. The pairs of one language's sources are the result itself; nothing else is quadratic but a term's own postings.

Defined cases: null text, language and source are ''; a source without terms is a group too; without kept terms all
values are 0; repeated rows count each time; ties in a ranking go to the smaller item by bytes; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import materialize

SCALE = 1_000_000_000
#: Of bytes in lower case: letters a-z and everything beyond ASCII.
TERM, BETWEEN = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: A task hands on its counts when it holds so many.
HELD_COUNTS, SEGMENT_BYTES = 1 << 19, 1 << 22


def _terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a bounded part at a time."""
    at = 0
    while at < len(data):
        stop = at + SEGMENT_BYTES
        end = BETWEEN.search(data, stop) if stop < len(data) else None
        stop = end.start() if end else len(data)
        yield TERM.findall(data, at, stop)
        at = stop


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a null term with count 0 stands for a source's existence."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])

    def told(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in held.items():
            size = len(n) + 1
            columns = [pa.repeat(lang, size), pa.repeat(source, size), pa.array([*n, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0]), pa.array([*map(documents.__getitem__, n), 0])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"], strict=True):
                n, documents = held[lang, source]
                size -= len(n)
                seen: set[bytes] = set()
                for found in _terms(text.as_py().encode().lower()):
                    n.update(found)
                    seen.update(found)
                documents.update(seen)
                size += len(n)
                if size > HELD_COUNTS:
                    yield from told(held)
                    held.clear()
                    size = 0
        yield from told(held)

    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: str, total: str, terms: str) -> Column:
    """p of a count in a group of `total` occurrences, with `terms` kept terms in its language; a whole division, exact."""
    return F.expr(f"1 + (cast({count} as decimal(20,0)) + 1) * cast({SCALE} as decimal(10,0)) div (cast({total} as decimal(20,0)) + {terms})")


def _gap(p: str, q: str) -> str:
    """f of two prices; both are at most SCALE + 1, so the square fits 64 bits."""
    return f"cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(38,0))"


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` for each other source of the language, `term` for the source's own terms above the language's rate."""
    counts = materialize(term_counts(docs, text, lang, source), "term_counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(kept, "kept_terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    postings = materialize(counts.filter("n > 0").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(held, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "support", "v", "lang_total"])
    groups = materialize(groups, "groups").withColumn("p0", F.expr("CASE WHEN v > 0 THEN 1 + cast({0} as decimal(10,0)) div (cast(total as decimal(20,0)) + v) END".format(SCALE)))

    priced = postings.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    priced = priced.withColumn("p", price("n", "total", "v"))
    terms = priced.withColumn("q", price("lang_n", "lang_total", "v")).filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    a, b = (groups.select("lang", *[F.col(c).alias(f"{c}_{side}") for c in ("source", "support", "p0")], *([F.col("v")] if side == "a" else [])) for side in "ab")
    pairs = a.join(b, "lang").filter("source_a != source_b")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # neither side: the terms outside of both supports; overlaps are taken off twice here and come back below
    neither = pairs.select("lang", "source_a", "source_b", F.when(F.col("v") > 0, (wide("v") - F.col("support_a") - F.col("support_b")) * F.expr(_gap("p0_a", "p0_b"))).otherwise(0).cast("decimal(38,0)").alias("value"))
    # one side: the histogram of one source against the other's price of nothing
    histogram = materialize(priced.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("terms")), "histograms")
    mine = histogram.select("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a"), "terms")
    theirs = histogram.select("lang", F.col("source").alias("source_b"), F.col("p").alias("p_b"), "terms")
    one = lambda side, own, p, q: pairs.join(own, ["lang", side]).groupBy("lang", "source_a", "source_b").agg(F.sum(wide("terms") * F.expr(_gap(p, q))).cast("decimal(38,0)").alias("value"))
    sided = one("source_a", mine, "p_a", "p0_b").unionByName(one("source_b", theirs, "p0_a", "p_b"))
    # overlaps: postings of the same term, counted by the two prices; a pair of sources meets once and serves both directions
    left = priced.select("lang", "term", F.col("source").alias("x"), F.col("p").alias("px"))
    right = priced.select("lang", "term", F.col("source").alias("y"), F.col("p").alias("py"))
    cells = left.join(right, ["lang", "term"]).filter("x < y").groupBy("lang", "x", "y", "px", "py").agg(F.count("*").alias("terms"))
    zero = groups.select("lang", "source", "p0")
    cells = cells.join(zero.select("lang", F.col("source").alias("x"), F.col("p0").alias("x0")), ["lang", "x"]).join(zero.select("lang", F.col("source").alias("y"), F.col("p0").alias("y0")), ["lang", "y"])
    mend = lambda p, p0, q, q0: F.sum(wide("terms") * F.expr(f"{_gap(p, q)} - {_gap(p, q0)} - {_gap(p0, q)} + {_gap(p0, q0)}")).cast("decimal(38,0)")
    mended = cells.groupBy("lang", "x", "y").agg(mend("px", "x0", "py", "y0").alias("xy"), mend("py", "y0", "px", "x0").alias("yx"))
    both = F.explode(F.array(F.struct(F.col("x").alias("source_a"), F.col("y").alias("source_b"), F.col("xy").alias("value")), F.struct(F.col("y").alias("source_a"), F.col("x").alias("source_b"), F.col("yx").alias("value"))))
    overlap = mended.select("lang", both.alias("m")).select("lang", "m.*")
    summed = neither.unionByName(sided).unionByName(overlap).groupBy("lang", "source_a", "source_b").agg(F.sum("value").cast("long").alias("value"))
    summed = summed.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    return summed.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distance from the other sources of its language, and the terms it uses above its language's rate."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), grp AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 3
), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), post AS (SELECT c.* FROM counts c JOIN kept USING (lang, term)
), own AS (SELECT lang, source, sum(n) AS total FROM post GROUP BY ALL
), every AS (SELECT lang, term, sum(n) AS n FROM post GROUP BY ALL
), whole AS (SELECT lang, sum(n) AS total FROM every GROUP BY lang
), p AS (
  SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(o.total, 0)::HUGEINT + s.v) AS p
  FROM kept k JOIN grp g ON g.lang = k.lang JOIN size s ON s.lang = k.lang
  LEFT JOIN post c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term LEFT JOIN own o ON o.lang = k.lang AND o.source = g.source
), pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), q AS (SELECT e.lang, e.term, 1 + (1000000000::HUGEINT * (e.n + 1)) // (w.total::HUGEINT + s.v) AS q FROM every e JOIN whole w USING (lang) JOIN size s USING (lang)
), term AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
