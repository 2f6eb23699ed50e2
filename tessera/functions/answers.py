"""What a model's answer says: its citations, a yes-or-no word, the task of a question, whether it doesn't know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import UNKNOWN, stripped

# The words of a yes-or-no answer, the tasks of a code question, and the unknown answer without its apostrophe.
BOOLEAN_ANSWERS = ["true", "false", "invalid"]
CODE_TASKS = ["general", "understand", "debug", "review", "write", "improve", "structure"]
UNKNOWN_PLAIN = "i dont know based on the provided sources."
_CITED = r"(?i)Citations:\s*(.*)$"


def _lower(text: Column | str) -> Column:
    return F.lower(stripped(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def boolean_answer(text: Column | str, fallback: str = "invalid") -> Column:
    """The first run of letters a-z if it is true, false or invalid."""
    word = F.regexp_extract(_lower(text), "[a-z]+", 0)
    return F.when(word.isin(BOOLEAN_ANSWERS), word).otherwise(fallback)


def code_task(text: Column | str, fallback: str = "general") -> Column:
    """A known task's name, blind to case and white space around it."""
    word = _lower(text)
    return F.when(word.isin(CODE_TASKS), word).otherwise(fallback)


def is_unknown(text: Column | str) -> Column:
    """Whether this is the canonical answer that the sources don't say, blind to case and white space."""
    return F.regexp_replace(_lower(text), r"\s+", " ").isin(UNKNOWN.lower(), UNKNOWN_PLAIN)


def split_citations(text: Column | str) -> Column:
    """(answer, citations): the last line's list after `Citations:`, cut at commas and white space; without any, the text as it is."""
    raw = stripped(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    listed = F.filter(F.split(F.regexp_extract(raw, _CITED, 1), r"[,\s]+"), lambda x: x != "")
    answer = F.when(F.regexp_extract(raw, _CITED, 1) != "", stripped(F.regexp_replace(raw, _CITED, ""))).otherwise(raw)
    return F.struct(answer.alias("answer"), listed.alias("citations"))


def lock_ints(key: Column | str) -> Column:
    """(major, minor): the first two big-endian 32-bit integers of a key's SHA-256, for advisory locks."""
    digest = F.sha2(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")), 256)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
    return F.struct(signed(part(1)).alias("major"), signed(part(9)).alias("minor"))
