"""Legacy web archives: ARC files of version 1 and 2 to WARC 1.1.

An ARC file begins with a file description whose second line gives the version, and whose third names the fields of the header lines that
follow. A record is such a line and as many bytes as its last field declares. Version 1 has five fields, version 2 ten;
the first is the URL, which may hold spaces, so lines are read from the right. The converter makes up what WARC wants beyond that: record
ids (name-based, so a second run gives the same), dates in ISO form, types, and digests.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest source id is a response, the others are
revisits that refer to it; smaller ones are all responses. A source id travels in the ``X-Source-Id`` header of the archived
answer. Records that share the smallest id are all responses; records without an id are revisits where another has one.

Archives are gzipped files of bounded size; each is one row of a Spark write, so a task holds one at a time and Spark's
commit protocol covers lost executors. Null payloads are empty, null URLs read ``unknown:``, line feeds and other white space in URLs are
percent-encoded. An empty table gives no records. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_columns, hot_keys, read_blobs, salted_join, write_blobs

#: Bytes after which an archive ends, before compression.
SEGMENT_BYTES = 4 << 20
# The field lists of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_ID_SPACE = uuid.UUID("9f1c6f0e-51d3-5c0b-8a55-0b9b6f9a7d11")


def _safe_url(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c.isspace() or ord(c) < 32 else c for c in url) if url else "unknown:"


def arc_begin(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 invoicelake\n{ARC_FIELDS[version]}\n".encode()
    tail = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str | None, source_id: int | None, payload: bytes, date: str, at: int, name: str) -> bytes:
    named = "" if source_id is None else f"X-Source-Id: {source_id}\r\n"
    block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    middle = "text/html" if version == 1 else f"text/html 200 {zlib.crc32(block):08x} - {at} {name}"
    return f"{_safe_url(url)} 0.0.0.0 {date} {middle} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: url, ip, date, mime, block. Raises ValueError where lines and lengths disagree."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    described = data[end + 1 : end + 1 + length].decode().split("\n")
    version = int(described[0].split(" ")[0])
    names = described[1].split(" ")
    if names != ARC_FIELDS.get(version, "").split(" "):
        raise ValueError(f"not a field list of version {version}: {described[1]}")
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = dict(zip(names, data[at:end].decode("utf-8", "replace").rsplit(" ", len(names) - 1)))
        size = int(fields["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError("a record is longer than its file")
        yield {"url": fields["URL"], "ip": fields["IP-address"], "date": fields["Archive-date"], "mime": fields["Content-type"], "block": data[end + 1 : end + 1 + size]}
        at = end + 1 + size


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head, payload and headers of an archived answer; one that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    cut = block.find(b"\r\n\r\n")
    cut = len(block) if cut < 0 else cut + 4
    headers = dict(x.split(": ", 1) for x in block[:cut].decode("latin-1").split("\r\n")[1:] if ": " in x)
    return block[:cut], block[cut:], {k.lower(): v for k, v in headers.items()}


def iso_date(date: str) -> str:
    """14 digits, or fewer of them, as YYYY-MM-DDThh:mm:ssZ."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, source_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID_SPACE, f'{url} {date} {source_id} {digest}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:cut].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        begin, n = cut + 4, int(headers["content-length"])
        yield headers, data[begin : begin + n]
        if data[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at = begin + n + 4


def _segments(make, begin) -> Iterator[bytes]:
    """Joins the records of ``make`` into files of about SEGMENT_BYTES; begin(k) is what file k starts with."""
    parts: list[bytes] = []
    size = k = 0
    for record in make:
        if not parts:
            parts.append(begin(k))
            size = len(parts[0])
        parts.append(record)
        size += len(record)
        if size >= SEGMENT_BYTES:
            yield b"".join(parts)
            parts, k = [], k + 1
    if parts:
        yield b"".join(parts)


def _blob_batches(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for b in blobs:
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], names=["content"])


def arc_files(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20000101000000") -> DataFrame:
    """(content): ARC files of the rows of a table, of version 1 and 2 by turns of the partitions."""
    source = pages.select(F.col(id_col).cast("long").alias("source_id"), F.col(url_col).cast("string").alias("url"), as_bytes(F.col(payload_col)).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"
        rows = (x for cols in batch_columns(batches, "source_id", "url", "payload") for x in zip(*cols))
        records = (arc_record(version, url, source_id, payload, date, k, name) for k, (source_id, url, payload) in enumerate(rows))
        yield from _blob_batches(_segments(records, lambda k: arc_begin(version, name, date)))

    return source.mapInArrow(run, "content binary")


_RECORD = "source_id long, url string, ip string, date string, head binary, payload binary, digest string, bytes long"
_RECORD_ARROW = pa.schema([("source_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("bytes", pa.int64())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (contents,) in batch_columns(batches, "content"):
        for data in contents:
            rows = []
            for r in parse_arc(data):
                head, payload, headers = _http(r["block"])
                known = headers.get("x-source-id")
                rows.append((None if known is None else int(known), r["url"], r["ip"], r["date"], head, payload, hashlib.sha256(payload).hexdigest(), len(payload)))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_ARROW.types)], schema=_RECORD_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_ARROW.types)], schema=_RECORD_ARROW)


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def info(k: int) -> bytes:
        body = b"software: invoicelake\r\nformat: WARC File Format 1.1\r\nconformsTo: converted from ARC\r\n"
        name = f"part-{part:05d}-{k:05d}.warc"
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "", None, "")), ("WARC-Date", iso_date("20000101")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)

    def records() -> Iterator[bytes]:
        names = ("source_id", "url", "ip", "date", "head", "payload", "digest", "bytes", "first_id", "first_url", "first_date")
        for cols in batch_columns(batches, *names):
            for source_id, url, ip, date, head, payload, digest, n, first_id, first_url, first_date in zip(*cols):
                again = first_id is not None and source_id != first_id
                block = head if again else head + payload
                headers = [
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(url, date, source_id, digest)), ("WARC-Date", iso_date(date)), ("WARC-Target-URI", url),
                    ("WARC-IP-Address", ip), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                    ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(n)),
                ]
                if source_id is not None:
                    headers.append(("X-Source-Id", str(source_id)))
                if again:
                    headers += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first_url, first_date, first_id, digest)),
                        ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", iso_date(first_date)), ("X-Refers-To-Source-Id", str(first_id)),
                    ]
                yield warc_record(headers, block)

    # the writer ends each file with a line feed: the last byte of the last record
    yield from _blob_batches(b[:-1] for b in _segments(records(), info))


#: First records of repeated payloads are sent to every executor up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def convert(arcs: DataFrame, path: str, *, least_bytes: int = 100) -> None:
    """ARC files, one per row of ``content`` -> gzipped WARC files below ``path``."""
    work = Scratch(arcs.sparkSession, "arc")
    records = work.store(arcs.select("content").mapInArrow(_parse, _RECORD))
    same = records.filter(F.col("bytes") >= least_bytes).groupBy("digest")
    first = same.agg(F.min("source_id").alias("first_id"), F.count("*").alias("n"), F.min(F.when(F.col("source_id").isNotNull(), F.struct("source_id", "url", "date"))).alias("k"))
    first = work.store(first.filter("n > 1 and first_id is not null").select("digest", "n", "first_id", F.col("k.url").alias("first_url"), F.col("k.date").alias("first_date")))
    n, size = first.agg(F.count("*"), F.sum(F.coalesce(F.length("first_url"), F.lit(0)))).first()
    firsts = first.drop("n")
    large = records.filter(F.col("bytes") >= least_bytes)
    if n * 200 + (size or 0) <= BROADCAST_BYTES:
        large = large.join(F.broadcast(firsts), "digest", "left")
    else:  # a payload that is everywhere is dealt out over many tasks
        large = salted_join(large, firsts, ["digest"], hot_keys(first, ["digest"], first.agg(F.sum("n")).first()[0]), F.xxhash64("source_id", "url", "date"), "left")
    small = records.filter(F.col("bytes") < least_bytes).withColumns({c: F.lit(None).cast(t) for c, t in (("first_id", "long"), ("first_url", "string"), ("first_date", "string"))})
    written = large.unionByName(small).select("source_id", "url", "ip", "date", "head", "payload", "digest", "bytes", "first_id", "first_url", "first_date")
    write_blobs(written.mapInArrow(_warc, "content binary"), path, "content", "gzip")
    work.drop(records, first)


_READ_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (contents,) in batch_columns(batches, "content"):
        for data in contents:
            rows = []
            for headers, block in parse_warc(zlib.decompress(data, 31)):
                if headers["warc-type"] == "warcinfo":
                    continue
                _, payload, _ = _http(block)
                digest, n = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                if headers["warc-type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
                ids = [None if (v := headers.get(k)) is None else int(v) for k in ("x-source-id", "x-refers-to-source-id")]
                rows.append((ids[0], n, digest, headers["warc-type"], ids[1], headers["warc-target-uri"], headers["warc-record-id"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_ARROW.types)], schema=_READ_ARROW)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id of every record; digests of responses are checked."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"
    return Scratch(spark, "warc-index").store(read_blobs(spark, path).select("content").mapInArrow(_read, schema))
