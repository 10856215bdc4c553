"""WARC archives with an index.

write_archive() writes gzip-per-record WARC/1.1 files to a shared folder and, for
every record, an index row: file, offset, length, url, digest.  read_records()
takes any selection of index rows, sorts it by place, merges neighbouring byte
ranges into one read each, and parses the records.

A file begins with a warcinfo record, which the index leaves out.  A response
record holds an HTTP response whose body is the payload.  Responses are written
first and get random record ids; revisits, which have no body, are written then
and name the record id of their response.

Defined cases: a null payload is empty, a null url is written as an empty
target; rows with a null id are written and read like others, but never become
the target of a revisit while a row with an id has the same payload.  Rows that
repeat both the id and the payload of a response are responses too; revisits name
one of them.  Empty tables give an empty index.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, read_table, small_batches

REVISIT_BYTES = 100  # equal payloads below this size are all written in full
RANGE_GAP = 64 << 10  # a gap between two wanted records up to this is read through
RANGE_MOST = 8 << 20  # bytes of one merged read
FILE_BYTES = 256 << 20  # a task starts another file beyond this
TASK_BYTES = 16 << 20  # of the archives, that a reading task takes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, page_id long, record_type string, record_id string, refers_to long, size long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_INDEX_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
_INDEX_NAMES = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]


def _filesystem(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _id(name: str) -> str:
    return f"<urn:uuid:{name}>"


def _head(kind: str, record_id: str, date: str, lines: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(record_id)}", f"WARC-Date: {date}", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(page_id, url, payload: bytes, size: int, digest: str, record_id: str, date: str, refers_to=None, target: str | None = None) -> bytes:
    """A response, or a revisit of the record target (of page refers_to)."""
    lines = [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}"]
    if target is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(target)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
        return _head("revisit", record_id, date, lines, b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _head("response", record_id, date, [*lines, "Content-Type: application/http; msgtype=response"], http + payload)


def _warcinfo(name: str, date: str) -> bytes:
    lines = [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _head("warcinfo", str(uuid.uuid4()), date, lines, b"software: tarnlake\r\nformat: WARC File Format 1.1\r\n")


def _parse(raw: bytes) -> dict:
    """A record's fields; a record whose payload does not match its own header is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    f = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(f["Content-Length"])
    block, tail = rest[:n], rest[n:]
    if tail != b"\r\n\r\n" or len(block) != n:
        raise ValueError("a WARC record is cut off")
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
    if f["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a WARC payload does not match its digest")
    number = lambda x: int(y) if (y := f.get(x, "")) else None
    return {
        "page_id": number("X-Page-ID"), "url": f["WARC-Target-URI"], "record_type": f["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


def decide(pages: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """One row per digest of REVISIT_BYTES or more that repeats: digest, first id."""
    seen = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")
    )
    return (
        seen.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )


def _writer(root: str, date: str, record: Callable[[dict, str], bytes | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the records of rows to files of a task's own; gives their index rows.
    Rows for which record() gives None have an index row without a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(root)
        system.create_dir(folder, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            index: list[tuple] = []
            for r in batch.to_pylist():
                own = str(uuid.uuid4())
                raw = record(r, own)
                if raw is None:
                    index.append((None, None, None, r["url"], r["digest"], r["page_id"], "revisit", None, r["first"], len(r["payload"])))
                    continue
                member = zlib.compress(raw, 4, wbits=31)
                if out is None or at + len(member) > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    first = zlib.compress(_warcinfo(name, date), 4, wbits=31)
                    out.write(first)
                    at = len(first)
                out.write(member)
                again = r.get("target") is not None
                size = r["size"] if again else len(r["payload"])
                index.append((f"{root}/{name}", at, len(member), r["url"], r["digest"], r["page_id"], "revisit" if again else "response", own, r["first"] if again else None, size))
                at += len(member)
            columns = zip(*index) if index else [[]] * len(_INDEX_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX_TYPES)], names=_INDEX_NAMES)
        if out is not None:
            out.close()

    return write


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> DataFrame:
    """Writes one WARC record per row below root; returns the index, itself
    written as Parquet.  A task that is run again writes files of other names;
    the index only names those of the attempt that counts.  date: that of all
    records, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = small_batches(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    rows = rows.join(decide(pages, id_col, payload), "digest", "left")

    def response(r: dict, own: str) -> bytes | None:
        size = len(r["payload"])
        if size >= REVISIT_BYTES and r["first"] is not None and r["page_id"] != r["first"]:
            return None
        return _record(r["page_id"], r["url"], r["payload"], size, r["digest"], own, date)

    written = materialize(rows.mapInArrow(_writer(root, date, response), INDEX_SCHEMA), "warc-responses")
    responses = written.where("file is not null")
    # Revisits have no payload: what is shuffled here is index rows.
    wanted = written.where("file is null").drop("file", "offset", "length", "record_type", "record_id").withColumnRenamed("refers_to", "first")
    target = responses.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", F.col("page_id").alias("first")).agg(F.min("record_id").alias("target"))
    wanted = wanted.join(target, ["digest", "first"])
    again = lambda r, own: _record(r["page_id"], r["url"], b"", r["size"], r["digest"], own, date, r["first"], r["target"])
    return responses.unionByName(materialize(wanted.mapInArrow(_writer(root, date, again), INDEX_SCHEMA), "warc-revisits"))


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows.  Rows are dealt by file and stretch
    of it to as many tasks as their bytes need, sorted by offset within each
    task, and read in merged ranges."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = path = handle = None
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

        def packed(found):
            return pa.RecordBatch.from_arrays([pa.array([r[n] if with_payload or n != "payload" else None for r in found], t) for n, t in zip(names, types)], names=names)

        def fetch(ranges):
            nonlocal system, path, handle
            found, size = [], 0
            start = ranges[0][1]
            if path != ranges[0][0]:
                if handle is not None:
                    handle.close()
                path = ranges[0][0]
                system, inner = _filesystem(path)
                handle = system.open_input_file(inner)
            data = handle.read_at(max(o + n for _, o, n in ranges) - start, start)
            for _, o, n in ranges:
                found.append(_parse(zlib.decompress(data[o - start : o - start + n], wbits=31)))
                size += len(found[-1]["payload"])
                if size > RANGE_MOST:
                    yield packed(found)
                    found, size = [], 0
            if found:
                yield packed(found)

        wait: list[tuple[str, int, int]] = []
        for batch in batches:
            for r in batch.to_pylist():
                item = (r["file"], r["offset"], r["length"])
                if wait and (item[0] != wait[0][0] or item[1] - (wait[-1][1] + wait[-1][2]) > RANGE_GAP or item[1] + item[2] - wait[0][1] > RANGE_MOST):
                    yield from fetch(wait)
                    wait = []
                wait.append(item)
        if wait:
            yield from fetch(wait)
        if handle is not None:
            handle.close()

    # Index rows are small and what they stand for is not: AQE would see the
    # former only, so the number of tasks is set by the bytes to be read.
    spark = selected.sparkSession
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    stretch = max(1 << 20, min(TASK_BYTES, size // (4 * tasks) + 1))
    placed = selected.select("file", "offset", "length", F.floor(F.col("offset") / F.lit(stretch)).alias("stretch"))
    placed = placed.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return placed.mapInArrow(read, RECORD_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archive(read_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
