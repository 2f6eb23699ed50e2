"""Answer parts, lock integers, file extensions and the order of telemetry."""

from __future__ import annotations

import hashlib
import struct


from tessera.functions import answers as A
from tessera.sources import files


def told(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r.got for r in rows.select("i", f("v").alias("got")).orderBy("i").collect()]


def test_answers(spark):
    assert told(spark, A.boolean_answer, ["TRUE", "false.", "invalid", "maybe", " - True, because", None, ""]) == ["true", "false", "invalid", "invalid", "true", "invalid", "invalid"]
    assert told(spark, A.code_task, ["DEBUG", "structure", "unknown-mode", " review\n", None]) == ["debug", "structure", "general", "review", "general"]
    unknown = ["I don't know based on the provided sources.", " i DONT know  based\non the provided sources. ", "I don't know.", None]
    assert told(spark, A.is_unknown, unknown) == [True, True, False, False]
    cited = told(spark, A.split_citations, ["It is.\nCitations: a#0, b#1  c#2", "no list", "x Citations:", None, "citations: a#1\nmore", "A Citations: one\nB Citations: two"])
    assert [(c.answer, c.citations) for c in cited] == [("It is.", ["a#0", "b#1", "c#2"]), ("no list", []), ("x Citations:", []), ("", []), ("citations: a#1\nmore", []), ("A Citations: one\nB", ["two"])]


def test_lock_ints(spark):
    keys = ["a:b:c", "", "t:chat:7", None]
    assert [tuple(x) for x in told(spark, A.lock_ints, keys)] == [struct.unpack(">ii", hashlib.sha256((k or "").encode()).digest()[:8]) for k in keys]


def test_folder_takes_all_text_extensions(spark, tmp_path):
    for name in ("a.csv", "b.log", "c.markdown", "d.cfg", "e.bash", "f.txt", "g.py", "h.bin", "i.exe"):
        (tmp_path / name).write_text("text")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.read_folder(spark, str(tmp_path)).collect()) == ["a.csv", "b.log", "c.markdown", "d.cfg", "e.bash", "f.txt", "g.py"]


def test_telemetry_in_order_of_time(spark, tmp_path):
    for f, times in (("1", [30, 10, 20, 20]), ("2", [20, 5, 10])):
        (tmp_path / f"{f}.ndjson").write_text("\n".join(f'{{"timestamp_ms": {t}, "request_id": "{f}-{i}", "event_type": "x"}}' for i, t in enumerate(times)) + "\nbroken\n")
    got = [(r.ms, r.request_id) for r in files.read_telemetry(spark, str(tmp_path), ordered=True).collect()]
    assert got == [(5, "2-1"), (10, "1-1"), (10, "2-2"), (20, "1-2"), (20, "1-3"), (20, "2-0"), (30, "1-0")]
    assert "ms" in files.read_telemetry(spark, str(tmp_path)).columns
