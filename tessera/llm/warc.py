"""WARC archives packaged in ZIP files: written, located through their directories, and read by ranges.

write_archives() puts each task's records into one ZIP archive with two stored members, the WARC file and
its index (a line of JSON per record: id, offset, length). An archive is written under a name of the attempt
and then renamed to one that depends on the partition only, so a task that runs again leaves the same file.

list_records() opens an archive with three small reads: the end record (with the ZIP64 locator and end
record, if there are any), the central directory, and the local header of each stored member; then it
reads the index. A WARC member without an index is walked record by record. read_records() fetches each record by its range and parses
its header; nothing is extracted. Members that are not stored are refused, as they have no record ranges.

Archives live in the shared folder and are opened by pyarrow's file systems, local or remote.

Defined cases: null payload is empty; a null record key has its own group and writes "null"; rows that repeat
a key are records of their own; several rows with the smallest key of a payload are all responses; an
empty table gives no archive and an empty result; other columns are not carried.
"""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import fresh_path, materialize

REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: ZIP record signatures and the mark of a field that has gone to its 64-bit form (fixed by the ZIP format).
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def warc_record(key: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit has no payload and names the record that has it."""
    head = {
        "WARC-Type": "revisit" if refers_to is not None else "response",
        "WARC-Record-ID": f"<urn:record:{key}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(url.split()) if url else "",
        "WARC-Payload-Digest": f"sha256:{digest}",
        **({"WARC-Refers-To": f"<urn:record:{refers_to}>", "WARC-Profile": PROFILE} if refers_to is not None else {}),
        "Content-Length": str(0 if refers_to is not None else len(payload)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + (b"" if refers_to is not None else payload) + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def zip_members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, length) of every stored member, from the central or ZIP64 directory."""
    tail_at = max(0, size - 22 - FULL16)
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, at = struct.unpack("<10xHII", tail[end : end + 20])
    locator = tail[end - 20 : end] if end >= 20 else _read(f, max(0, tail_at + end - 20), 20)
    if locator[:4] == LOCATOR64:
        end64 = _read(f, struct.unpack("<8xQ", locator[:16])[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, at = struct.unpack("<32xQQQ", end64)
    directory, place, found = _read(f, at, length), 0, {}
    for _ in range(entries):
        if directory[place : place + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, stored, full, n_name, n_extra, n_comment, local = struct.unpack("<10xH8xIIHHH8xI", directory[place : place + 46])
        name = directory[place + 46 : place + 46 + n_name].decode()
        extra = directory[place + 46 + n_name : place + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the 64-bit forms of the full fields, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full, stored, local = (next(wide) if x == FULL32 else x for x in (full, stored, local))
            extra = extra[4 + n :]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed; records can't be read by range")
        head = _read(f, local, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        found[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), stored)
        place += 46 + n_name + n_extra + n_comment
    return found


def _walk(f, at: int, length: int) -> Iterator[tuple[str, int, int]]:
    """(id, offset, length) of the records of a WARC member that has no index, one small read a record."""
    place, n = at, 1 << 14
    while place < at + length:
        raw = _read(f, place, min(n, at + length - place))
        head, found, _ = raw.partition(b"\r\n\r\n")
        if not found:
            if len(raw) < n:
                raise ValueError("broken WARC record")
            n *= 2
            continue
        fields, _ = parse_record(head + found)
        size = len(head) + 4 + int(fields["Content-Length"]) + 4
        yield fields["WARC-Record-ID"][len("<urn:record:") : -1], place, size
        place, n = place + size, 1 << 14


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """(key, url, payload, digest, refers_to) -> one row for each archive written: archive, bytes, records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        store, folder = _open_fs(path)
        name, made, index = f"{folder}/part-{task.partitionId():06d}.zip", 0, []
        attempt = f"{folder}/_attempt-{task.taskAttemptId()}.tmp"
        first = next(batches, None)
        while first is not None and not len(first):
            first = next(batches, None)
        if first is None:
            return
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(attempt) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            with archive.open("records.warc", "w", force_zip64=True) as member:
                b = first
                while b is not None:
                    for r in b.itertuples(index=False):
                        raw = warc_record(r.key, r.url, bytes(r.payload), r.digest, None if pd.isna(r.refers_to) else r.refers_to)
                        member.write(raw)
                        index.append((r.key, made, len(raw)))
                        made += len(raw)
                    b = next(batches, None)
            with archive.open("records.idx", "w", force_zip64=True) as member:
                for k, at, n in index:
                    member.write(json.dumps({"id": k, "offset": at, "length": n}).encode() + b"\n")
        store.move(attempt, name)
        yield pd.DataFrame({"archive": [path + name[len(folder) :]], "bytes": [store.get_file_info(name).size], "records": [len(index)]})

    rows = records.select("key", "url", "payload", "digest", "refers_to")
    return rows.mapInPandas(run, "archive string, bytes long, records long")


def list_records(archives: DataFrame) -> DataFrame:
    """(archive, bytes) -> key, archive, offset and length of every record, from the archives' own directories."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, size in zip(b["archive"], b["bytes"], strict=True):
                store, path = _open_fs(name)
                with store.open_input_file(path) as f:
                    members = zip_members(f, size)
                    for member, (at, n) in members.items():
                        if not member.endswith(".warc"):
                            continue
                        told = members.get(member[: -len(".warc")] + ".idx")
                        if told:
                            lines = map(json.loads, _read(f, *told).splitlines())
                            found = [(x["id"], at + x["offset"], x["length"]) for x in lines]
                        else:
                            found = list(_walk(f, at, n))
                        for k in range(0, len(found), 10_000):
                            yield pd.DataFrame(found[k : k + 10_000], columns=["key", "offset", "length"]).assign(archive=name)

    return archives.select("archive", "bytes").mapInPandas(run, "key string, offset long, length long, archive string")


def read_records(located: DataFrame) -> DataFrame:
    """(archive, offset, length) -> key, record_type, refers_to, digest and, of responses, payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "record_type", "refers_to", "digest", "payload"]
        open_name, f = None, None
        for b in batches:
            out, held = [], 0
            for name, at, n in zip(b["archive"], b["offset"], b["length"], strict=True):
                if name != open_name:
                    if f is not None:
                        f.close()
                    store, path = _open_fs(name)
                    open_name, f = name, store.open_input_file(path)
                fields, block = parse_record(_read(f, at, n))
                revisit = fields["WARC-Type"] == "revisit"
                ref = fields["WARC-Refers-To"][len("<urn:record:") : -1] if revisit else None
                out.append((fields["WARC-Record-ID"][len("<urn:record:") : -1], fields["WARC-Type"], ref, fields["WARC-Payload-Digest"].removeprefix("sha256:"), None if revisit else block))
                held += len(block)
                if held > 1 << 24:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)
        if f is not None:
            f.close()

    return located.select("archive", "offset", "length").mapInPandas(run, "key string, record_type string, refers_to string, digest string, payload binary")


def mark_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, payload, digest, n) -> refers_to: the smallest page_id with that payload, on rows that revisit it.

    Only digests that occur more than once are joined, and they are counted before the shuffle."""
    big = F.when(F.col("n") >= least_bytes, F.col("digest"))
    first = pages.select(big.alias("digest"), "page_id").dropna(subset=["digest"]).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    first = materialize(first, "copies")  # its size is known now, and decides whether it is broadcast or both sides are shuffled
    joined = pages.withColumn("_big", big).join(first.withColumnRenamed("digest", "_big"), "_big", "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("_big", "first")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged archives and read back by ranges."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = mark_revisits(pages.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload")))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    archives = materialize(write_archives(pages.withColumn("key", key).withColumn("refers_to", F.col("refers_to").cast("string")), fresh_path(spark, "warc")), "archives")
    located = list_records(archives.repartition(max(1, archives.count())))  # a task an archive
    records = read_records(located).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256)).drop("payload")
    records = materialize(records, "records")
    full = records.filter("record_type = 'response'").groupBy(F.col("key").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.first("payload_bytes").alias("_bytes"))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(full, ["refers_to", "digest"])
    revisits = revisits.withColumnsRenamed({"_bytes": "payload_bytes"}).withColumn("payload_digest", F.col("digest"))
    columns = [F.expr("CAST(nullif(key, 'null') AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")]
    return records.filter("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
