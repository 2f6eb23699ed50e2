"""Readers and writers: folders of text, code and office documents, NDJSON telemetry, CSV reports, logs.

Files are listed and read by Spark, so any store it can read will do; a file that can't be parsed gets its error
in a column and never stops the rest.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources of their own.
SKIPPED_FOLDERS = [
    ".git", ".hg", ".svn", ".next", ".nuxt", ".turbo", ".cache", ".pnpm-store", ".yarn", ".gradle", ".idea", ".vscode", ".venv", "venv", "env",
    "node_modules", "dist", "build", "coverage", "out", "target", "vendor", "Pods", "DerivedData", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".serverless", ".aws-sam",
]
# Languages by whole file name, then by extension.
LANGUAGE_BY_NAME = {
    "dockerfile": "docker", "makefile": "makefile", "jenkinsfile": "groovy", "procfile": "procfile", "gemfile": "ruby", "rakefile": "ruby",
    "podfile": "ruby", "brewfile": "ruby", "package.json": "json", "package-lock.json": "json", "pnpm-lock.yaml": "yaml", "yarn.lock": "yaml",
    "tsconfig.json": "json", "jsconfig.json": "json", "pyproject.toml": "toml", "requirements.txt": "text", "pipfile": "toml", "cargo.toml": "toml",
    "cargo.lock": "toml", "go.mod": "go", "go.sum": "go", "pom.xml": "xml", "build.gradle": "groovy", "build.gradle.kts": "kotlin",
    "settings.gradle": "groovy", "settings.gradle.kts": "kotlin", "gradle.properties": "properties", "composer.json": "json", "composer.lock": "json",
    "mix.exs": "elixir", "mix.lock": "elixir",
}
LANGUAGE_BY_EXTENSION = {
    "c": "c", "cc": "cpp", "conf": "conf", "cpp": "cpp", "cs": "csharp", "css": "css", "cxx": "cpp", "go": "go", "gradle": "groovy",
    "groovy": "groovy", "h": "c", "hh": "cpp", "hpp": "cpp", "htm": "html", "html": "html", "ini": "ini", "java": "java", "js": "javascript",
    "json": "json", "jsx": "jsx", "kt": "kotlin", "kts": "kotlin", "less": "less", "mjs": "javascript", "mdx": "mdx", "php": "php",
    "ps1": "powershell", "py": "python", "rb": "ruby", "rs": "rust", "sass": "sass", "scala": "scala", "scss": "scss", "sh": "shell", "sql": "sql",
    "svelte": "svelte", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "tsx", "vue": "vue", "xml": "xml", "yaml": "yaml", "yml": "yaml",
    "zsh": "shell",
}

# Extensions of text that a folder gives besides those of a language.
TEXT_EXTENSIONS = ["txt", "md", "markdown", "csv", "log", "cfg", "bash"]


def code_language(path: Column | str) -> Column:
    """By file name, else by extension, else null."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.element_at(table(LANGUAGE_BY_NAME), name), F.element_at(table(LANGUAGE_BY_EXTENSION), F.element_at(F.split(name, r"\."), -1)))


def is_binary(head: bytes) -> bool:
    """A NUL, or 15 % control bytes within the first 2 KiB."""
    head = head[:2048]
    odd = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
    return b"\0" in head or (len(head) > 0 and odd / len(head) >= 0.15)


def tidy(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def docx_text(raw: bytes) -> str:
    """S3: paragraphs of a word-processor document, from the XML in its archive."""
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    piece = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    return tidy("\n".join("".join(piece[e.tag](e) for e in p.iter() if e.tag in piece) for p in root.iter(f"{w}p")))


def pdf_text(raw: bytes) -> str:
    """S3: needs the optional pypdf."""
    import pypdf

    return tidy("\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages))


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = (*TEXT_EXTENSIONS, "docx", "pdf", *LANGUAGE_BY_EXTENSION)) -> DataFrame:
    """Path, text and error of the files of a folder tree; hidden and build folders and binaries are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    inside = F.replace(F.col("path"), F.lit(path.rstrip("/")), F.lit(""))
    hidden = F.exists(F.split(inside, "/"), lambda s: s.startswith(".") | s.isin(SKIPPED_FOLDERS))
    wanted = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(list(extensions)) | F.lower(F.element_at(F.split("path", "/"), -1)).isin(list(LANGUAGE_BY_NAME))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, raw in zip(b["path"], b["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    if kind in ("docx", "pdf"):
                        out.append((name, (docx_text if kind == "docx" else pdf_text)(raw), None))
                    elif not is_binary(raw):
                        out.append((name, raw.decode("utf-8", "replace"), None))
                except Exception as error:  # noqa: BLE001  one file's fault is that file's
                    out.append((name, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.filter(wanted & ~hidden).mapInPandas(run, "path string, text string, error string")


ENVELOPE = "timestamp string, timestamp_ms bigint, request_id string, tenant_id string, config_id string, policy string, run_id string, event_type string"


def read_telemetry(spark: SparkSession, path: str, fields: str = "", ordered: bool = False) -> DataFrame:
    """NDJSON events; blank and malformed lines and those without a valid time go; missing names are 'unknown'.

    ordered: by time, and events of one time as they were written: by file name, block and line."""
    read = spark.read.schema(ENVELOPE + (", " + fields if fields else "")).option("mode", "DROPMALFORMED").json(path)
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    rows = read.withColumns(place) if ordered else read
    at = F.coalesce("timestamp_ms", F.expr("unix_millis(try_to_timestamp(timestamp))"))
    named = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")) for c in ("tenant_id", "config_id", "policy", "run_id", "event_type")}
    events = rows.withColumn("ms", at).filter("ms IS NOT NULL").withColumns(named)
    return events.orderBy("ms", *place).drop(*place) if ordered else events


def without_health_checks(lines: DataFrame) -> DataFrame:
    """NDJSON lines (value) without the request events of health endpoints; malformed lines stay."""
    field = lambda k: F.get_json_object("value", f"$.{k}")
    health = field("event_type").isin("request_start", "request_finish") & F.substring_index(field("path"), "?", 1).isin("/health", "/v1/health")
    return lines.filter(~F.coalesce(health, F.lit(False)))


def write_report(df: DataFrame, path: str) -> None:
    """CSV with quotes where they are needed and a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_events(df: DataFrame, path: str) -> None:
    """NDJSON."""
    df.write.mode("append").json(path)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """K4, V1: a write-ahead log of text lines -> seq (struct in log order), op, id, value, ttl_s, vec. Lines that don't parse go."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("seq"))  # sorts as the log was written: file by name, block, line
    part = F.split("value", " ")
    op = F.get(part, F.lit(0))
    ttl = F.when((op == "SET") & (F.get(part, F.size(part) - 2) == "EX"), F.expr("try_cast(element_at(split(value, ' '), -1) AS BIGINT)"))
    vec = F.when(op == "VSET", F.transform(F.slice(part, 4, F.greatest(F.size(part) - 3, F.lit(0))), lambda x: x.cast("float")))
    known = lines.filter(op.isin("SET", "DEL", "VSET", "VDEL", "VDELPREFIX", "VCLEAR"))
    return known.select("seq", op.alias("op"), F.get(part, F.lit(1)).alias("id"), F.when(op == "SET", F.get(part, F.lit(2))).alias("value"), ttl.alias("ttl_s"), vec.alias("vec"))
