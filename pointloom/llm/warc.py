"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

Archives are WARC/1.1 files of gzip members, one a record, written by Spark's
own writers. A row of a writer is a block of members of about ``BLOCK`` bytes, and
a file takes ``BLOCKS_PER_FILE`` of them, so that bytes bound files, not pages.
Resolution moves headers alone: (digest, length, page, place) rows are summed by
digest to the first page of each payload, joined back, and grouped by archive
file; the task that gets a file's decisions opens the file itself, walks it as a
stream and writes fresh records, the repeated ones as revisits without payload.
Tasks open files by pyarrow's file systems (local or mounted paths, HDFS, S3, GCS);
the archives lie below the folder that the caller names, in a store of these.

A task holds one record and what decides over its file (``RECORDS_PER_BLOCK`` times
``BLOCKS_PER_FILE`` records at most), whatever the file's size.

Edges: a null page is an empty payload (equal to other empty payloads); a null
or odd URL is percent-encoded; equal page ids of equal payloads are ordered by
their place in the archive; a null page id sorts before all others; an empty table gives
empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, scratch_dir, table, texts_of

#: Bytes of a block from which it is closed, its records at most, and the blocks of a file.
BLOCK, RECORDS_PER_BLOCK, BLOCKS_PER_FILE = 8 << 20, 512, 16
#: Bytes that a reader takes from a file at once, and records whose headers or texts it hands on at once.
CHUNK, HANDED = 1 << 20, 500
#: Tasks of the second writing pass: one a file, up to so many.
MOST_TASKS = 20_000
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Spark's text writer ends every row by a separator; an empty gzip member is one that readers pass over.
SEPARATOR = gzip.compress(b"", mtime=0).decode("latin-1")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:pointloom:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def clean_uri(url: str | None) -> str:
    return quote(url or "about:blank", safe="%/:?#[]@!$&'()*+,;=-._~")


def record(kind: str, page_id: int | None, uri: str, digest: str, payload: bytes, payload_bytes: int, refers_to: int | None = None, refers_uri: str | None = None) -> bytes:
    """One record; a revisit keeps the HTTP header (with the payload's length) and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {refers_uri}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + body + b"\r\n\r\n"


def members(source: bytes | BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that isn't empty, read as a stream."""
    file = io.BytesIO(source) if isinstance(source, bytes) else source
    at, left = 0, file.read(CHUNK)
    while left:
        d, size, out = zlib.decompressobj(31), 0, []
        while not d.eof:
            if not left and not (left := file.read(CHUNK)):
                raise ValueError("an archive member is cut short")
            out.append(d.decompress(left))
            size += len(left) - len(d.unused_data)
            left = d.unused_data
        content = b"".join(out)
        if content:
            yield at, size, content
        at += size
        left = left or file.read(CHUNK)


def open_file(uri: str) -> BinaryIO:
    """A file of any store that pyarrow knows, as a stream of bytes."""
    if uri.startswith("file:"):  # Spark writes file:/a or file:///a
        return open("/" + uri[5:].lstrip("/"), "rb")
    system, path = pa.fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record, by its Content-Length."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _write(blocks: DataFrame, path: str) -> None:
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def _blocks(records: Iterator[bytes], block: int) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, joined to blocks."""
    held, size = [], 0
    for r in records:
        held.append(gzip.compress(r, LEVEL, mtime=0))
        size += len(held[-1])
        if size >= block or len(held) >= RECORDS_PER_BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["block"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["block"])


def write_archive(pages: DataFrame, path: str) -> str:
    """Write each page as a response record below ``path``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for i, u, h in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)).to_pylist(), texts_of(batch.column(2)), strict=True):
                payload = h.as_py().encode("utf-8", "surrogatepass")
                yield record("response", i, clean_uri(u), payload_digest(payload), payload, len(payload))

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(map_arrow(rows, lambda batches: _blocks(made(batches), BLOCK), "block binary"), path)
    return path


HEADERS = "file string, position long, page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below ``path``; a response's digest and length are taken from its payload."""
    names, kinds = [x.split()[0] for x in HEADERS.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def header(file: str, at: int, data: bytes) -> tuple:
        fields, http, payload = parse(data)
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
        if kind == "response":
            if payload_digest(payload) != digest:
                raise ValueError(f"{file} at {at}: the payload doesn't match its digest")
            size, refers = len(payload), None
        else:
            size, refers = int(re.search(rb"Content-Length: (\d+)", http)[1]), page_of(fields["WARC-Refers-To"])
        return file, at, page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, size, refers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with open_file(file) as stream:
                    rows = (header(file, at, data) for at, _, data in members(stream))
                    while some := list(itertools.islice(rows, HANDED)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    return map_arrow(_files(spark, path), run, HEADERS)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The archive files, dealt by their bytes; only their names are read here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")


def resolve(headers: DataFrame, min_payload: int = 0) -> DataFrame:
    """Headers with the decision of each: ``kind``, ``refers`` and ``refers_uri``.

    Only headers are shuffled. Sums by digest are combined before the shuffle;
    the sums of repeated payloads are written out and joined as a plain table, so
    that the join's partitions of a hot digest can be split.
    """
    place = F.struct("page_id", "file", "position", "uri")
    first = headers.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("payload_digest", "payload_bytes", "first"))
    other = (F.col("first").isNotNull()) & (F.struct("file", "position") != F.struct("first.file", "first.position"))
    return headers.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "file", "position", "page_id", F.when(other, "revisit").otherwise("response").alias("kind"), F.when(other, F.col("first.page_id")).alias("refers"), F.when(other, F.col("first.uri")).alias("refers_uri")
    )


def rewrite(spark: SparkSession, source: str, decisions: DataFrame, path: str) -> str:
    """Write the archives of ``source`` anew below ``path``: first payloads as responses, the others as revisits."""
    of_file = F.collect_list(F.struct("position", "kind", "refers", "refers_uri")).alias("d")  # bounded by the records of a file
    tasks = max(1, min(MOST_TASKS, _files(spark, source).count()))
    by_file = decisions.repartition(tasks, "file").groupBy("file").agg(of_file)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for file, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                decided = {x["position"]: x for x in d.as_py()}
                with open_file(file) as stream:
                    for at, _, data in members(stream):
                        fields, _, payload = parse(data)
                        x = decided[at]
                        yield record(x["kind"], page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload_digest(payload), payload, len(payload), x["refers"], x["refers_uri"])

    _write(map_arrow(by_file, lambda batches: _blocks(made(batches), BLOCK), "block binary"), path)
    return path


def deduplicate_archive(spark: SparkSession, pages: DataFrame, folder: str, min_payload: int = 0) -> str:
    """Archive ``pages``, resolve repeats and write the deduplicated archives; returns their folder."""
    source = write_archive(pages, f"{folder}/all")
    decisions = resolve(materialize(read_headers(spark, source)), min_payload)
    return rewrite(spark, source, decisions, f"{folder}/deduplicated")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = deduplicate_archive(spark, table(spark, sf_dir, "pages"), scratch_dir(spark))
    return read_headers(spark, final).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
x AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
  list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1) AS q FROM d),
y AS (SELECT *, list_transform(range(32), lambda k: list_sum(list_transform(range(5), lambda j:
    ((q[(k * 5 + j) // 4 + 1] >> (3 - (k * 5 + j) % 4)) & 1) << (4 - j)))::BIGINT) AS v FROM x)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM y
"""
