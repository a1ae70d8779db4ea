"""WARC archives: a writer through Spark's own text sink, and a reader that splits gzip archives by byte ranges.

Writing. Every record is a gzip member of its own. Spark's text sink puts a separator after each row; here
a row is a block of members followed by the first twelve bytes of an empty gzip member, and the separator is
that member's trailer, eight zero bytes, so each file is a plain sequence of gzip members and Spark's commit
protocol guards it. Of records with equal payloads (of min_revisit_bytes at least) the one with the smallest
page_id is a response and the others are revisits that refer to it; shorter payloads are responses always.

Reading. A task gets a byte range, looks for gzip's magic number in it, takes a candidate as a member only
if it inflates to a WARC header, and owns each record that starts inside its range, reading past the end of
the range as far as its last record needs.

Defined cases: a null html is an empty payload; a null url gives no target URI; a null page_id sorts after
all others (a response only if no equal payload has an id) and comes back null; rows that repeat the
smallest page_id with the same payload are responses all; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EMPTY_HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00"
_TRAILER = "\x00" * 8
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    revisit = first is not None and page_id != first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_warc(
    pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 4, block_bytes: int = 1 << 20
) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives in the folder path."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    groups = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(groups.filter("n > 1").drop("n"), "sha", "left")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for page_id, url, data, sha, first in zip(*(b[c] for c in ("page_id", "url", "payload", "sha", "first")), strict=True):
                sha32 = base64.b32encode(sha.as_py()).decode()
                out.append(_gzip(_record(page_id.as_py(), url.as_py(), data.as_py(), sha32, first.as_py(), date), level))
                size += len(out[-1])
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pydict({"value": [b"".join([*out, _EMPTY_HEAD])]})
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"value": [b"".join([*out, _EMPTY_HEAD])]})

    members = rows.mapInArrow(blocks, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", _TRAILER).text(path)


def _header(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _parse(record: bytes) -> dict | None:
    head, cut, block = record.partition(b"\r\n\r\n")
    if not cut:
        return None
    h = _header(head)
    block = block[: int(h.get("content-length", len(block)))]
    http, cut, payload = block.partition(b"\r\n\r\n")
    is_http = bool(cut) and h.get("content-type", "").startswith("application/http")
    row = {"warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri")}
    if row["warc_type"] == "revisit":
        n = _header(http).get("content-length") if is_http else None
        return row | {"payload": None, "payload_bytes": int(n) if n else None, "payload_digest": h.get("warc-payload-digest", "").rpartition(":")[2]}
    payload = payload if is_http else block
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": _digest(payload)}


def _records(read, start: int, end: int, length: int) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """Offset and inflated bytes of each WARC record whose member starts in [start, end). read: (offset, size) -> bytes.

    Members inflate from pieces that double from 4 KB to 64 KB, so reading is linear in the range's length.
    """
    data, more = read(start, min(length, end + (1 << 16)) - start), 1 << 20
    at = 0
    while (at := data.find(_MAGIC, at)) >= 0 and start + at < end:
        probe = zlib.decompressobj(31)
        try:
            begins = probe.decompress(data[at : at + 4096], 8)
        except zlib.error:
            begins = b""
        if not begins.startswith(b"WARC/"):
            at += 1
            continue
        z, parts, place, piece = zlib.decompressobj(31), [], at, 1 << 12
        try:
            while not z.eof:
                if place == len(data):
                    if start + len(data) >= length:
                        break
                    data += read(start + len(data), min(more, length - start - len(data)))
                    more *= 2
                parts.append(z.decompress(data[place : place + piece]))
                place, piece = min(place + piece, len(data)), min(2 * piece, 1 << 16)
        except zlib.error:
            pass
        if not z.eof:
            at += 1
            continue
        yield start + at, b"".join(parts)
        at = place - len(z.unused_data)


def _open(path: str):  # noqa: ANN202
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


_SCHEMA = "path string, offset long, warc_type string, record_id string, refers_to string, target_uri string, payload binary, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str, split_bytes: int = 32 << 20, with_payload: bool = True) -> DataFrame:
    """A row for each record of the gzip archives under path: where it is, its main headers, payload, its length and digest.

    payload_bytes and payload_digest are computed from the payload, for revisits taken from the record's
    headers. with_payload=False leaves payload null. Stores that pyarrow cannot open are read whole by
    Spark's binaryFile source, one task for each file.
    """
    files = spark.read.format("binaryFile").load(path)
    ranged = (urlsplit(path).scheme or "file") in ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")

    def parsed(name: str, found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), *((c, pa.string()) for c in ("warc_type", "record_id", "refers_to", "target_uri")), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for offset, record in found:
            if (row := _parse(record)) is None:
                continue
            if not with_payload:
                row["payload"] = None
            out.append({"path": name, "offset": offset, **row})
            size += len(row["payload"] or b"") + 500
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with _open(row["path"]) as f:

                    def read(at: int, n: int, f=f) -> bytes:  # noqa: ANN001
                        f.seek(at)
                        return f.read(n)

                    yield from parsed(row["path"], _records(read, row["start"], min(row["start"] + split_bytes, row["length"]), row["length"]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                data = content.as_py()
                yield from parsed(name, _records(lambda at, n, d=data: d[at : at + n], 0, len(data), len(data)))

    if not ranged:
        return files.select("path", "content").mapInArrow(whole, _SCHEMA)
    scheme = F.regexp_replace("path", "^s3a:", "s3:")
    splits = files.filter("length > 0").select(scheme.alias("path"), "length", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"))
    tasks = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    return splits.repartition(tasks).mapInArrow(by_range, _SCHEMA)
