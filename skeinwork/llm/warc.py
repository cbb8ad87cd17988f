"""WARC archives: one gzip member per record, written per task and read sequentially.

Writing: payload digests are grouped first, so that one of the records with an equal payload (the
one with the largest page_id) is a response and the others revisit it.  Every task writes files of
bounded size into a folder that all executors share and returns their names; only files named by
tasks that succeeded are read, so a task that ran twice leaves nothing that counts.

Reading: members are decompressed incrementally, a record's block is framed by its Content-Length,
and block and payload digests are verified; a truncated or altered archive raises an error.

Edge cases: a null html is an empty payload; a null url is an empty one, and control characters in
urls are percent-encoded; a null page_id stays null: such a record is a response only if no page
with that payload has an id; rows that repeat the largest page_id of a payload are all responses;
extra columns are not archived; no rows give no files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import checkpoint, shared_dir

#: Compressed bytes after which a task begins another file.
FILE_BYTES = 32 << 20

#: Bytes that the reader takes from a file at a time.
BITE = 1 << 16

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which holds no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    where = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {where}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a binary stream."""
    waiting = b""
    while waiting or (waiting := stream.read(BITE)):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            bite = waiting or stream.read(BITE)
            if not bite:
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(bite))
            waiting = unpack.unused_data
        yield b"".join(parts)


def fields(head: bytes) -> dict[str, str]:
    """Named fields after the first line, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read(stream) -> Iterator[tuple]:
    """Verified records of one archive, as rows of ``RECORDS``."""
    for member in members(stream):
        head, gap, rest = member.partition(b"\r\n\r\n")
        named = fields(head)
        n = int(named["content-length"])
        block = rest[:n]
        if not head.startswith(b"WARC/1.") or not gap or len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError("a record is not framed by its Content-Length")
        if named["warc-block-digest"] != f"sha1:{sha1(block)}":
            raise ValueError("a block does not match its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = int(fields(http)["content-length"]), named["warc-payload-digest"].removeprefix("sha1:")
        if named["warc-type"] == "response" and (len(payload) != size or sha1(payload) != digest):
            raise ValueError("a payload does not match its digest")
        page, refers = (int(named[k]) if k in named else None for k in ("x-page-id", "x-refers-to-page-id"))
        yield page, named["warc-target-uri"], named["warc-type"], refers, size, digest, payload if named["warc-type"] == "response" else None


def write(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages`` (page_id, url, html); returns the files written.

    Payloads of at least ``least`` bytes are stored once; smaller ones each time.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    largest = known.groupBy("sha").agg(F.max("page_id").alias("keep"))
    revisits = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")) & (F.octet_length("html") >= least)
    rows = known.join(largest, "sha").select("page_id", "url", "html", F.when(revisits, F.col("keep")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name, out, n = "", None, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    name, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                payload = html.as_py().encode()
                out.write(record(page.as_py(), url.as_py(), payload, sha1(payload), refers.as_py(), date))
                n += 1
                if out.tell() >= FILE_BYTES:
                    done.append((name, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, n, out.tell()))
            out.close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        columns = [pa.array([_uri(folder, top, x) for x in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "n_records", "n_bytes"])

    return checkpoint(rows.mapInArrow(run, FILES))


def _uri(folder: str, top: str, name: str) -> str:
    """The address of a file below ``folder``, whose path in its file system is ``top``."""
    return folder.rstrip("/") + name[len(top.rstrip("/")) :]


def read_files(files: DataFrame) -> DataFrame:
    """The records of the archives that the rows of ``files`` name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for row in read(stream):
                        rows.append(row)
                        size += len(row[6] or b"") + 200
                        if size >= 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    n = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(4 * n).mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
