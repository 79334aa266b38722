"""WARC archives with per-record Zstandard compression and an embedded dictionary.

An archive starts with a skippable frame that holds the dictionary, built from the archive's own records; every record
is then a frame of its own, so that readers can start at any record. Payloads that occurred before are revisit records.
Archives are rows of a table (``archive``, ``content``): Spark's writers put them into any store. ``export`` writes them
as files where all machines mount the target.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize

# Fixed values of the formats: the dictionary's skippable frame, WARC's version line and the revisit profile.
SKIPPABLE = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 8 << 20  #: payload bytes after which an archive is closed
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20  #: payload bytes that a dictionary is built from, spread over the archive's records
REVISIT_BYTES = 100  #: shorter payloads are always stored
LEVEL = 3

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page}')}>"


def _record(page, url, html, digest, size, refers_to) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += ["WARC-Page-Key:" + ("" if page is None else f" {page}"), f"WARC-Payload-Length: {size}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Page-Key: {refers_to}"]
        block = http
    else:
        block = http + html
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    """A ``.warc.zst`` file of uncompressed records. Without enough text for a dictionary it has an empty frame."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[i : i + 4096] for r in records[::step] for i in range(0, len(r), 4096)]
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, max(256, total // 8)), samples, level=LEVEL)
        words = trained.as_bytes()
    except zstandard.ZstdError:
        words = b""
    trained = zstandard.ZstdCompressionDict(words) if words else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(words)), words, *map(press.compress, records)])


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, read one frame at a time with the dictionary that the archive brings."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't start with a dictionary frame")
    words = zstandard.ZstdCompressionDict(content[8 : 8 + size]) if size else None
    rest = memoryview(content)[8 + size :]
    plain = zstandard.ZstdDecompressor(dict_data=words)
    while len(rest):
        frame = plain.decompressobj()
        record = frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :] if frame.unused_data else rest[len(rest) :]
        head, _, block = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = dict(re.split(r": ?", line, maxsplit=1) for line in lines[1:])
        yield headers, block[: int(headers["Content-Length"])]


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records, size = [], 0

    def close() -> pa.RecordBatch:
        content = write_archive(records)
        name = f"{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"
        return pa.record_batch([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "size", "refers_to")), strict=True):
            page, url, html, digest, length, first = (x.as_py() for x in row)
            records.append(_record(page, url, (html or "").encode(), digest, length, first))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
                records, size = [], 0
    if records:
        yield close()


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row; returns the archives (``archive``, ``content``), written in the shared folder.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id is a response, the
    others revisit it. Digests are grouped with partial sums and joined back by sort-merge, so a payload with a third of
    all rows is split over tasks; rows of different content under the same id are told apart by payload. Null texts are
    empty payloads, null urls empty targets; a null id never becomes the response that others refer to; equal rows are
    one response and revisits only if their ids differ (the same id twice gives two responses). An empty table gives no
    archives. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    payload = F.coalesce("html", F.lit(""))
    rows = rows.withColumns({"digest": F.sha2(payload.cast("binary"), 256), "size": F.octet_length(payload).cast("long")})
    repeated = (
        rows.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    rows = rows.join(repeated, "digest", "left")
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "html", "digest", "size", revisit.alias("refers_to"))
    return materialize(rows.mapInArrow(_write_batches, "archive string, content binary"), "warc")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    for batch in batches:
        for content in batch.column(0):
            out: list[tuple] = []
            size = 0
            for h, block in read_archive(content.as_py()):
                body = block.partition(b"\r\n\r\n")[2]
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                stored = h["WARC-Type"] == "response"
                if stored and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(h["WARC-Payload-Length"])):
                    raise ValueError(f"record {h['WARC-Record-ID']} doesn't match its digest")
                key, to = h["WARC-Page-Key"], h.get("WARC-Refers-To-Page-Key")
                out.append(
                    (
                        int(key) if key else None,
                        h["WARC-Target-URI"],
                        int(h["WARC-Payload-Length"]),
                        digest,
                        h["WARC-Type"],
                        int(to) if to else None,
                        body.decode() if stored else None,
                    )
                )
                size += len(body)
                if size > ARCHIVE_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=names)


_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("html", T.StringType()),
    ]
)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` and ``html`` (null for revisits). Stored payloads are checked against their digests."""
    return archives.select("content").mapInArrow(_read_batches, _SCHEMA)


def export(archives: DataFrame, folder: str) -> None:
    """Write archives as files into a folder that all machines mount; a retried task replaces its own files."""

    def put(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row.archive}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, os.path.join(folder, row.archive))

    archives.foreachPartition(put)


SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (SELECT page_id, payload_digest, octet_length(b) AS n FROM p),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM q WHERE n >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM q LEFT JOIN f ON d = payload_digest
"""
