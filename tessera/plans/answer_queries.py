"""Answers of every conversation, with a citation line added to what the assistant said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.plans.base import query
from tessera.sources.tables import load

_SAID = "CASE WHEN role = 'assistant' THEN text || chr(10) || 'Citations: d' || conv_id || '#0, d' || turn || '#1' ELSE text END"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LOW = f"lower({_TRIM.format('said')})"


@query(
    rf"WITH s AS (SELECT conv_id, turn, {_SAID} AS said FROM conversations), c AS (SELECT *, regexp_extract({_TRIM.format('said')}, '(?i)Citations:\s*(.*)$', 1) AS listed FROM s) "
    rf"SELECT conv_id, turn, CASE WHEN regexp_extract({_LOW}, '[a-z]+') IN ('true', 'false', 'invalid') THEN regexp_extract({_LOW}, '[a-z]+') ELSE 'invalid' END AS boolean, CASE WHEN {_LOW} IN ('general', 'understand', 'debug', 'review', 'write', 'improve', 'structure') THEN {_LOW} ELSE 'general' END AS task, "
    rf"regexp_replace({_LOW}, '\s+', ' ', 'g') IN ('i don''t know based on the provided sources.', '{A.UNKNOWN_PLAIN}') AS unknown, sha256(CASE WHEN listed <> '' THEN {_TRIM.format(_TRIM.format('said').replace('said', 'regexp_replace(said, chr(10) || ' + chr(39) + 'Citations: .*$' + chr(39) + ', ' + chr(39) * 2 + ')'))} ELSE {_TRIM.format('said')} END) AS answer_digest, array_to_string(list_filter(string_split_regex(listed, '[,\s]+'), lambda x: x <> ''), ' ') AS citations FROM c"
)
def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SAID.replace("chr(10)", "'\n'")).alias("said"))
    parts = said.withColumn("p", A.split_citations("said"))
    return parts.select("conv_id", "turn", A.boolean_answer("said").alias("boolean"), A.code_task("said").alias("task"), A.is_unknown("said").alias("unknown"), F.sha2("p.answer", 256).alias("answer_digest"), F.array_join("p.citations", " ").alias("citations"))


_INT = "CAST(CASE WHEN CAST('0x' || substr(h, {0}, 8) AS BIGINT) >= 2147483648 THEN CAST('0x' || substr(h, {0}, 8) AS BIGINT) - 4294967296 ELSE CAST('0x' || substr(h, {0}, 8) AS BIGINT) END AS INTEGER)"


@query(f"WITH k AS (SELECT DISTINCT conv_id, sha256('tenant:chat:' || conv_id) AS h FROM conversations) SELECT conv_id, {_INT.format(1)} AS major, {_INT.format(9)} AS minor FROM k")
def lock_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lock of each conversation."""
    rows = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", A.lock_ints(F.concat(F.lit("tenant:chat:"), F.col("conv_id").cast("string"))).alias("k")).select("conv_id", "k.major", "k.minor")
