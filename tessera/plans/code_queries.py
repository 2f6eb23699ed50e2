"""Source files made of the parts and of which parts follow each other in orders; their graph is known from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import code_graph as G
from tessera.plans.base import query
from tessera.sources.tables import load


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per part in its brand's folder; it imports and calls the parts on the next line of an order."""
    parts = load(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "#", "")).alias("brand"), "p_type")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).filter("l_partkey != next").select("l_partkey", "next").distinct()
    told = pairs.join(parts.select(F.col("p_partkey").alias("next"), F.col("brand").alias("folder")), "next").groupBy("l_partkey")
    code = told.agg(F.array_sort(F.collect_list(F.expr("'import { make' || next || ' } from \"../' || folder || '/part' || next || '\";'"))).alias("heads"), F.array_sort(F.collect_list(F.expr("'make' || next || '(n)'"))).alias("calls"))
    nothing = F.array().cast("array<string>")
    own = parts.join(code, parts.p_partkey == code.l_partkey, "left")
    text = F.concat(F.array_join(F.coalesce("heads", nothing), "\n"), F.expr("'\nexport function make' || p_partkey || '(n) { return ['"), F.array_join(F.coalesce("calls", nothing), ", "), F.expr("']; }\nrouter.get(\"/' || lower(p_type) || '/' || p_partkey || '\", handler);\n'"))
    modules = own.select(F.expr("'src/' || brand || '/part' || p_partkey || '.ts'").alias("path"), text.alias("text"))
    facts = modules.select("path", G.code_facts("text", "path").alias("f"))
    return facts.select("path", "f.*")


_PAIRS = """p AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey),
n AS (SELECT p_partkey AS k, 'src/' || lower(replace(p_brand, '#', '')) || '/part' || p_partkey || '.ts' AS path FROM part),
e AS (SELECT x.path AS file, y.path AS to_file, 'make' || b AS symbol FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b)"""


@query(f"WITH {_PAIRS} SELECT 'imports' AS kind, file, NULL AS symbol, to_file FROM e UNION ALL SELECT unnest(['imports_symbol', 'calls', 'references']), file, symbol, to_file FROM e")
def code_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of every module: what it imports, calls and refers to, by path."""
    return G.code_graph(_files(spark, sf_dir)).select("kind", "file", "symbol", "to_file")


@query("SELECT 'route' AS kind, 'src/' || lower(replace(p_brand, '#', '')) || '/part' || p_partkey || '.ts' AS file, 'GET /' || lower(p_type) || '/' || p_partkey AS name FROM part")
def code_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.file_signals(_files(spark, sf_dir))
