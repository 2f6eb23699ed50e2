"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.base import query
from tessera.sources.tables import load

_STRIP = r"regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


@query(rf"WITH w AS (SELECT doc_id, regexp_extract_all({_STRIP.format('text')}, '(\S+\s*)', 1) AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, 1 + CASE WHEN len(w) <= 220 THEN 0 ELSE CAST(ceil((len(w) - 220) / 180.0::DOUBLE) AS BIGINT) END)) AS idx FROM w WHERE len(w) > 0) SELECT doc_id, CAST(idx AS INTEGER) AS idx, doc_id || '#' || idx AS chunk_id, {_STRIP.format("array_to_string(list_slice(w, idx * 180 + 1, idx * 180 + 220), '')")} AS text FROM i")
def chunk_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_documents(_docs(spark, sf_dir))


@query()
def chunk_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_documents(_docs(spark, sf_dir), "char")


@query()
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_documents(_docs(spark, sf_dir), "code", overlap=20)


_BLOCKED = "(?i)" + "|".join(f"(?:{p})" for p in X.INJECTION)


@query(rf"SELECT doc_id, sha256({_STRIP.format(f"array_to_string(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: NOT regexp_matches({_STRIP.format('x')}, '{_BLOCKED}')), chr(10))")}) AS digest FROM documents")
def sanitize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.sanitized("text"), 256).alias("digest"))


@query(f"SELECT doc_id, CAST(len({_SENTENCES}) AS BIGINT) AS n, array_to_string(list_slice({_SENTENCES}, 1, 2), ' ') AS summary FROM documents")
def summary_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(X.sentences("text")).cast("long").alias("n"), X.summary_of("text").alias("summary"))


_WORDS = "|".join(X.PROCEDURAL)


@query(rf"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), p AS (SELECT doc_id, s, list_filter(s, lambda x: regexp_matches(x, '(?i)\b({_WORDS})\b')) AS p FROM s) SELECT doc_id, CAST(least(5, len(s)) AS BIGINT) AS semantic, CAST(least(5, CASE WHEN len(p) > 0 THEN len(p) ELSE len(s) END) AS BIGINT) AS procedural, CAST(CASE WHEN len(s) > 0 THEN 1 ELSE 0 END AS BIGINT) AS summary FROM p")
def reflect_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.size(F.filter("r", lambda x: x.kind == k)).cast("long").alias(k)
    return _docs(spark, sf_dir).withColumn("r", X.reflections("text")).select("doc_id", kind("semantic"), kind("procedural"), kind("summary"))


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", X.page_text("html").alias("text"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(url, '/', '__'), ' ', '-'), '[^A-Za-z0-9._-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS doc FROM pages")
def path_docid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", X.path_doc_id("url").alias("doc"))


@query(r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT *, strpos(lower(t), 'the') AS hit FROM f), s AS (SELECT *, CASE WHEN hit > 0 THEN greatest(1, hit - 38) ELSE 1 END AS st FROM a) SELECT doc_id, CASE WHEN st > 1 THEN '…' ELSE '' END || substr(t, st, 80) || CASE WHEN st + 80 <= length(t) THEN '…' ELSE '' END AS preview FROM s")
def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.preview("text", "the").alias("preview"))


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.cache_key("text").alias("key"))


_BYTE = "CAST('0x' || substr(d, {0} * 2 + 1, 2) AS INTEGER)"


@query(rf"""WITH t AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9._:@-]+'), lambda x: x <> '')) AS token FROM benchmark), d AS (SELECT item_id, sha256(token) AS d, unnest([0, 4, 8, 12, 16, 20, 24, 28]) AS i FROM t),
f AS (SELECT item_id, ({_BYTE.format("i")} * 256 + {_BYTE.format("(i + 1)")}) % 64 AS k, sum(CASE WHEN {_BYTE.format("(i + 2)")} % 2 = 1 THEN 1 ELSE -1 END * (0.25::DOUBLE + {_BYTE.format("(i + 3)")} / 255.0::DOUBLE * 0.75::DOUBLE)) AS x FROM d GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS k, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM f""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.hashed_features(load(spark, sf_dir, "benchmark"), "item_id", "text")
    return out.select("item_id", F.col("at").alias("k"), F.round("x", 6).alias("x"))


@query()
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.feature_vectors(load(spark, sf_dir, "documents"), "doc_id", "text")


def _names_sql(column: str, pattern: str) -> str:
    literal = pattern.replace("'", "''")
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({column}, '{literal}', 1))), ',')"


@query("SELECT page_id, " + ", ".join(f"{_names_sql('html', p)} AS {n}" for n, p in X.CODE_NAMES.items()) + " FROM pages")
def code_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "pages").select("page_id", X.code_structure(F.col("html")).alias("found"))
    return found.select("page_id", *[F.array_join(f"found.{n}", ",").alias(n) for n in X.CODE_NAMES])
