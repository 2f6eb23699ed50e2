"""Facts of source files and the graph of how they import, call, refer to and test each other.

Facts come from text by expressions; the graph is equi-joins on resolved module paths and on symbols. A symbol is looked up
only in files that its file imports, or if a single file defines it, so a name that many files define joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize

_FROM = r"import\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"]([^'\"]+)['\"]"
_REQUIRE = r"(?:const|let|var)\s+(\{[^}]*\}|[A-Za-z_$][\w$]*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
_BARE = r"(?:\bimport\s+|\bimport\(\s*|\brequire\(\s*)['\"]([^'\"]+)['\"]"
_EXPORT = r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
_FUNCTION = r"\bfunction\*?\s+([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"
_DEFINED = r"\b(?:function\*?|class|interface|type|enum|def|fn)\s+([A-Za-z_$][\w$]*)"
_ROUTE = r"\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"
_CALL = r"(?<!function )(?<!def )\b([A-Za-z_$][\w$]*)\s*\("
#: Words before a parenthesis that aren't calls.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "function", "return", "require", "import", "await", "typeof", "super"]
#: Kinds of configuration by file name; fixed names.
CONFIG_KINDS = {"package": r"(^|/)package\.json$", "docker": r"(^|/)(dockerfile[^/]*|(docker-)?compose[^/]*\.ya?ml)$", "typescript": r"(^|/)tsconfig[^/]*\.json$", "python": r"(^|/)(pyproject\.toml|requirements[^/]*\.txt|setup\.py)$", "env": r"(^|/)\.env[^/]*$", "ci": r"(^|/)\.github/workflows/[^/]+$"}
TEST_FILE = r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]+$"
RELATIVE = r"^\.{1,2}(/|$)"
EXTENSION = r"\.[A-Za-z0-9]+$"


def _all(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _distinct(found: Column) -> Column:
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def _symbols(clause: Column) -> Column:
    """Names an import clause binds from its module: of `a as b` a, of `* as n` n."""
    parts = F.split(F.regexp_replace(clause, r"[{}]", ""), ",")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"^\*\s+as\s+", ""), r"\s.*$", "")), lambda p: p != "")


def code_facts(text: Column | str, path: Column | str) -> Column:
    """Imports, imported (symbol, module), exports, functions, defined, calls, referenced, routes, env, package, scripts, workspaces, services, config_kinds, is_test.

    In order of appearance, each once. A file that isn't JSON has no package; services are the entries of a compose file."""
    text, path = (F.col(c) if isinstance(c, str) else c for c in (text, path))
    text = F.coalesce(text, F.lit(""))
    name = F.lower(path)
    pairs = lambda pattern: F.arrays_zip(_all(text, pattern, 1).alias("clause"), _all(text, pattern, 2).alias("module"))
    once = lambda value, told: F.get(F.transform(F.array(value), told), F.lit(0))  # noqa: E731  what both facts of it read is worked out once
    symbols = lambda found: F.flatten(F.transform(found, lambda x: F.transform(_symbols(x.clause), lambda s: F.struct(s.alias("symbol"), x.module.alias("module")))))
    bindings = once(pairs(_FROM), lambda p: F.struct(_distinct(F.concat(F.transform(p, lambda x: x.module), _all(text, _BARE))).alias("imports"), F.array_distinct(symbols(F.concat(p, pairs(_REQUIRE)))).alias("imported")))
    body = F.regexp_replace(F.regexp_replace(text, _FROM, " "), _REQUIRE, " ")
    names = once(body, lambda b: F.struct(F.filter(_distinct(_all(b, _CALL)), lambda c: ~c.isin(NOT_CALLS)).alias("calls"), _distinct(_all(b, r"([A-Za-z_$][\w$]*)", 1)).alias("words")))
    routes = F.transform(F.arrays_zip(_all(text, _ROUTE, 1).alias("verb"), _all(text, _ROUTE, 2).alias("path")), lambda x: F.concat(F.upper(x.verb), F.lit(" "), x.path))
    json = F.when(name.rlike(CONFIG_KINDS["package"]), text)
    compose = F.when(name.rlike(CONFIG_KINDS["docker"]), F.regexp_extract(F.concat(text, F.lit("\n")), r"(?m)^services:[ \t]*\n((?:[ \t#].*\n|\n)*)", 1))
    kinds = F.array_compact(F.array(*[F.when(name.rlike(p), F.lit(k)) for k, p in CONFIG_KINDS.items()]))
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    functions = F.concat(_all(text, _FUNCTION, 1), _all(text, _FUNCTION, 2))
    return F.struct(
        bindings["imports"].alias("imports"), bindings["imported"].alias("imported"), _distinct(_all(text, _EXPORT)).alias("exports"),
        _distinct(functions).alias("functions"), _distinct(F.concat(_all(text, _DEFINED), functions, _all(text, _EXPORT))).alias("defined"),
        names["calls"].alias("calls"), names["words"].alias("words"),
        F.array_distinct(routes).alias("routes"), _distinct(_all(text, r"process\.env\.([A-Z0-9_]+)")).alias("env"), F.get_json_object(json, "$.name").alias("package"),
        strings(F.json_object_keys(F.get_json_object(json, "$.scripts"))).alias("scripts"), strings(F.from_json(F.get_json_object(json, "$.workspaces"), "array<string>")).alias("workspaces"),
        strings(_all(compose, r"(?m)^  ([A-Za-z0-9_.-]+):")).alias("services"), kinds.alias("config_kinds"), name.rlike(TEST_FILE).alias("is_test"),
    )


def resolved(module: Column, folder: Column) -> Column:
    """The path a relative module names from a folder, '.' and '..' worked out; null for others. Leading '..' too many are dropped."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), module), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    return F.when(module.rlike(RELATIVE), F.array_join(walked, "/"))


def module_files(files: DataFrame) -> DataFrame:
    """(path, imports) -> path, module, to_file of modules that name a file: by its path, without extension, or a folder's index.

    A relative module that names none is looked up by the rest of its path, if exactly one file ends with it."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    asked = files.select("path", folder.alias("folder"), F.explode(F.array_distinct("imports")).alias("module")).filter(F.col("module").rlike(RELATIVE)).withColumn("key", resolved(F.col("module"), F.col("folder")))
    stem = F.regexp_replace("path", EXTENSION, "")
    index = F.regexp_extract(stem, r"^(.*)/(?:index|__init__|mod)$", 1)
    keys = F.explode(F.array_compact(F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate((F.col("path"), stem, F.nullif(index, F.lit(""))))])))
    known = files.select(F.col("path").alias("to_file"), keys.alias("k")).select("to_file", "k.*").filter("key IS NOT NULL")
    best = known.groupBy("key").agg(F.min(F.struct("rank", "to_file")).alias("b")).select("key", "b.to_file")
    met = materialize(asked.join(best, "key", "left"), "resolved")
    parts = F.split(stem, "/")
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    only = files.select(F.col("path").alias("tail_file"), tails.alias("tail")).groupBy("tail").agg(F.min("tail_file").alias("tail_file"), F.count("*").alias("n")).filter("n = 1").drop("n")
    missing = met.filter("to_file IS NULL").withColumn("tail", F.regexp_replace(F.regexp_replace("module", r"^(?:\.{1,2}/)+", ""), EXTENSION, ""))
    by_tail = missing.join(only, "tail").select("path", "module", F.col("tail_file").alias("to_file"))
    return met.filter("to_file IS NOT NULL").select("path", "module", "to_file").unionByName(by_tail).filter("path != to_file")


def code_graph(files: DataFrame) -> DataFrame:
    """(path, imports, imported, defined, calls, words, is_test) -> kind, file, symbol, to_file, each edge once.

    imports and tests (of a test file) go to the file a module names; imports_symbol, calls and references to the file that
    defines the symbol: one that the file imports, or else the only one that defines it."""
    # texts are read for their facts once, and each join is made once
    files = materialize(files.select("path", "imports", "imported", "defined", "calls", "words", "is_test"), "facts")
    links = materialize(module_files(files), "links")
    imports = links.select("path", "to_file").distinct()
    nothing = F.lit(None).cast("string").alias("symbol")
    edges = [imports.select(F.lit("imports").alias("kind"), F.col("path").alias("file"), nothing, "to_file")]
    edges.append(imports.join(files.filter("is_test").select("path"), "path").select(F.lit("tests").alias("kind"), F.col("path").alias("file"), nothing, "to_file"))
    defined = files.select(F.col("path").alias("to_file"), F.explode(F.array_distinct("defined")).alias("symbol"))
    named = files.select("path", F.explode("imported").alias("i")).select("path", "i.symbol", "i.module").join(links, ["path", "module"]).join(defined, ["to_file", "symbol"])
    edges.append(named.select(F.lit("imports_symbol").alias("kind"), F.col("path").alias("file"), "symbol", "to_file").distinct())
    sole = defined.groupBy("symbol").agg(F.min("to_file").alias("sole_file"), F.count("*").alias("n")).filter("n = 1").drop("n")
    bound = files.select("path", F.transform("imported", lambda i: i.symbol).alias("_bound"), "calls", "words", "defined")
    referred = F.filter("words", lambda w: F.array_contains("_bound", w))
    of = lambda kind, symbols: F.transform(symbols, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("symbol")))
    used = bound.select("path", F.explode(F.concat(of("calls", F.array_except("calls", "defined")), of("references", referred))).alias("u")).select("path", "u.*")
    # what a file can reach is a row per symbol, never one per import and symbol used
    reached = materialize(used.join(imports.join(defined, "to_file"), ["path", "symbol"], "left"), "reached")
    near = reached.filter("to_file IS NOT NULL")
    far = reached.filter("to_file IS NULL").drop("to_file").join(sole, "symbol").filter("path != sole_file").withColumnRenamed("sole_file", "to_file")
    edges.append(near.unionByName(far).select("kind", F.col("path").alias("file"), "symbol", "to_file"))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    # rows of different paths give each edge once
    return out if files.groupBy("path").count().filter("count > 1").isEmpty() else out.distinct()


def file_signals(files: DataFrame) -> DataFrame:
    """Kind, file, name of what a file exposes or configures: route, package, script, workspace, service, env."""
    lists = {"route": F.col("routes"), "package": F.array_compact(F.array("package")), "script": F.col("scripts"), "workspace": F.col("workspaces"), "service": F.col("services"), "env": F.col("env")}
    of = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    each = F.explode(F.flatten(F.array(*[of(k, c) for k, c in lists.items()])))
    return files.select(F.col("path").alias("file"), each.alias("s")).select("s.kind", "file", "s.name")
