"""Legacy web archives: ARC files read by their version, and converted to WARC.

An ARC file opens with a version block, a ``filedesc://`` record whose body names
the version and the fields of all header lines that follow: version 1 has URL,
IP, date, type and length; version 2 adds result code, checksum, location, offset
and file name.  A record's body is as long as its header line declares, whatever
it holds; blank lines between records are skipped.  A line that is no header, or
a length that runs past the file's end, raises an error with the offset.

Conversion keeps the body byte by byte and makes up what WARC needs: a
``warcinfo`` record at the head of each file, identifiers (a UUID from the
archive's own name, the offset, URL, date and payload, so that a second run names
records alike), ISO dates, record types, and SHA-1 digests of payload and block.
Bodies that are no HTTP message become ``resource`` records.  Of equal HTTP
payloads one is the response; the others are ``revisit`` records, which hold the
HTTP headers and name the response by identifier, URL and date.

Archives are packed in tasks, one row of bytes each, closed at ARCHIVE_BYTES (a
single longer record makes a longer archive).  Spark's text writer stores each
row as a file and ends it with the separator that the format asks for, so
archives reach any store that Spark reaches.  Files are compressed with gzip;
files of one gzip member for each record, or of none, are read as well.

Null payloads are empty and null URLs are ``urn:none``; blanks in URLs are
escaped.  Pages that repeat an id keep a record each; of equal payloads the one
with the smallest id, then the first by file and offset, is the response.  A null
id comes after all others.  An empty table gives no archives and no rows.  Dates
of less than 14 digits are completed by the first instant; dates without a year
become 1970.  Columns beside id, URL and payload are not carried.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, scratch, text_of, written

#: Bytes at which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: How archive files are written: each row of bytes is one file.
FILES = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1}
SOFTWARE = "archive-converter"

# Field names of the two versions' URL records, separators and names of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_BREAK, WARC_BREAK = "\n", "\r\n\r\n"
ARC_HEAD = b"filedesc://"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

_PAGE = re.compile(rb"X-Page-Id: (-?\d+)\r\n")
_DATE = re.compile(rb"\d{4,14}")


def _string(data: bytes) -> str:
    """Bytes of a header as text; those that are no UTF-8 are replaced."""
    return data.decode("utf-8", "replace")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def version_block(version: int, name: str, date: str) -> bytes:
    """The record that opens an ARC file and names the fields of the others."""
    body = f"{version} 0 {SOFTWARE}\n{ARC_FIELDS[version]}\n".encode()
    between = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {between}{len(body)}\n".encode() + body + ARC_BREAK.encode()


def _write_files(archives: DataFrame, path: str, end: str) -> None:
    """Store each row of bytes as a file; the writer adds the last separator."""
    archives.select(F.col("content").cast("string").alias("value")).write.option("lineSep", end).options(**FILES).text(path)


def _packed_arc(limit: int):
    """One row of bytes per archive; each version has an archive of its own."""

    def run(batches):
        worker, closed, waiting = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for page, url, date, version, payload in zip(
                *(batch.column(c).to_pylist() for c in ("page", "url", "date", "version", "payload"))
            ):
                if version not in waiting:
                    name = f"pages-{worker:06d}-{closed + len(waiting):06d}-{version}.arc"
                    head = version_block(version, name, date)
                    waiting[version] = [name, len(head), [head]]
                name, at, parts = waiting[version]
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'-' if page is None else page}\r\n\r\n".encode() + payload
                between = "" if version == 1 else f"200 {base32_sha1(payload)} - {at} {name} "
                record = f"{url} 192.0.2.1 {date} text/html {between}{len(body)}\n".encode() + body + ARC_BREAK.encode()
                parts.append(record)
                waiting[version][1] += len(record)
                if waiting[version][1] >= limit:
                    yield _one_archive(waiting.pop(version)[2], ARC_BREAK)
                    closed += 1
        for _, _, parts in waiting.values():
            yield _one_archive(parts, ARC_BREAK)

    return run


def _one_archive(parts: list[bytes], end: str) -> pa.RecordBatch:
    """A row of all records; the last separator is left to the writer."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[: -len(end)]], pa.binary())], ["content"])


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as ARC files; even ids go by version 1, odd ids by version 2.

    The body is an HTTP response whose headers carry the page's id.
    """
    number = F.coalesce(F.col(key).cast("long"), F.lit(0))
    date = F.date_format(F.timestamp_seconds(F.lit(1_200_000_000) + F.pmod(number, F.lit(10**8))), "yyyyMMddHHmmss")
    address = F.regexp_replace(F.coalesce(F.nullif(F.col(url), F.lit("")), F.lit("urn:none")), r"\s", "%20")
    rows = pages.select(
        F.col(key).cast("long").alias("page"),
        address.alias("url"),
        date.alias("date"),
        F.when(number % 2 == 0, 1).otherwise(2).alias("version"),
        text_of(html).cast("binary").alias("payload"),
    )
    _write_files(rows.mapInArrow(_packed_arc(ARCHIVE_BYTES), "content binary"), path, ARC_BREAK)


def _arc_header(line: bytes, fields: list[str], at: int) -> dict[str, bytes]:
    """The fields of a header line; a URL may hold blanks, all others may not."""
    parts = line.rstrip(b"\r").rsplit(b" ", len(fields) - 1)
    header = dict(zip(fields, parts))
    if len(parts) < len(fields) or not header["Archive-length"].isdigit() or not _DATE.fullmatch(header["Archive-date"]):
        raise ValueError(f"no ARC header line at {at}: {line[:200]!r}")
    return header


def arc_entries(data: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """Offset, header fields and body of each record of an ARC file, without its version blocks.

    A version block sets the fields of the header lines from there on; the
    archive's own name is the field ``Archive``.
    """
    at, fields, archive = 0, ARC_FIELDS[1].split(), b""
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end] if end >= 0 else data[at:]
        opening = line.startswith(ARC_HEAD)
        if opening:
            size = line.rsplit(b" ", 1)[-1].rstrip(b"\r")
            if not size.isdigit():
                raise ValueError(f"no ARC version block at {at}: {line[:200]!r}")
            header, size = {}, int(size)
        else:
            header = _arc_header(line, fields, at)
            size = int(header["Archive-length"])
        body = data[end + 1 : end + 1 + size]
        if end < 0 or len(body) < size:
            raise ValueError(f"the record at {at} declares {size} bytes, {len(body)} are left")
        if opening:
            archive = line.split(b" ", 1)[0].removeprefix(ARC_HEAD)
            version, _, named = body.partition(b"\n")
            number = version.split(b" ", 1)[0]
            if not number.isdigit() or int(number) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version at {at}: {version[:200]!r}")
            fields = _string(named).split() or ARC_FIELDS[int(number)].split()
            if not {"URL", "Archive-date", "Archive-length"} <= set(fields):
                raise ValueError(f"the version block at {at} lacks fields: {fields}")
        else:
            yield at, header | {"Archive": archive}, body
        at = end + 1 + size


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def unzipped(data: bytes) -> bytes:
    """The bytes of a file of one or many gzip members, or of none."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line, and payload; headers are empty if the body is no HTTP message."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    at, gap = min((body.find(g) % (len(body) + 1), len(g)) for g in (b"\r\n\r\n", b"\n\n"))
    return body[: at + gap], body[at + gap :]


def _stamp(date: bytes) -> str:
    """A date of up to 14 digits in ISO form."""
    d = date.decode()
    d += "00000101000000"[len(d) :]
    if not int(d[:4]):
        d = "1970" + d[4:]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _identifier(*origin: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '#'.join(map(str, origin)))}>"


_INDEX = "file string, at long, page long, bytes long, digest string, is_http boolean, record_id string, url binary, date string"
_RECORDS = "file string, at long, ip binary, type binary, head binary, payload binary"


def _arc_index(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for at, header, body in arc_entries(unzipped(content.as_py())):
                head, payload = split_http(body)
                page, digest, date = _PAGE.search(head), base32_sha1(payload), _stamp(header["Archive-date"])
                name = _string(header["Archive"]) or path.rpartition("/")[2]
                rows.append(
                    (
                        path,
                        at,
                        int(page[1]) if page else None,
                        len(payload),
                        digest,
                        bool(head),
                        _identifier(name, at, _string(header["URL"]), date, digest),
                        header["URL"],
                        date,
                    )
                )
            yield _batch(rows, _INDEX)


def _arc_records(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, size = [], 0
            for at, header, body in arc_entries(unzipped(content.as_py())):
                head, payload = split_http(body)
                rows.append((path, at, header.get("IP-address", b"0.0.0.0"), header.get("Content-type", b"-"), head, pack(payload)))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    yield _batch(rows, _RECORDS)
                    rows, size = [], 0
            yield _batch(rows, _RECORDS)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the ARC files under a path: its place, page, payload size and digest, and identifier."""
    return whole_files(spark, path).mapInArrow(_arc_index, _INDEX)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the ARC files under a path with its HTTP headers and its payload, compressed."""
    return whole_files(spark, path).mapInArrow(_arc_records, _RECORDS)


def roles(index: DataFrame, least_bytes: int) -> DataFrame:
    """``file, at, original``: where a record repeats an earlier payload, the response that it refers to."""
    order = F.struct(F.col("page").isNull().alias("unknown"), "page", "file", "at", "record_id", "url", "date")
    shared = index.where(F.col("is_http") & (F.col("bytes") >= least_bytes))
    groups = shared.groupBy("digest").agg(
        F.min(order).alias("original"),
        F.count("*").alias("n"),
    ).where("n > 1").select("digest", "original")
    same = (F.col("original.file") == F.col("file")) & (F.col("original.at") == F.col("at"))
    return shared.select("file", "at", "digest").join(groups, "digest").where(~same).select("file", "at", "original")


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record with its block digest, length and separator; values may be bytes."""
    lines = [b"WARC/1.1"]
    for name, value in [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", len(block))]:
        lines.append(name.encode() + b": " + (value if isinstance(value, bytes) else str(value).encode()))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + WARC_BREAK.encode()


def _info(worker: int, number: int, row: dict) -> bytes:
    """The record that opens a WARC file."""
    name = f"pages-{worker:06d}-{number:06d}.warc.gz"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", _identifier(name, row["record_id"])),
        ("WARC-Date", row["date"]),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return warc_record(fields, f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode())


def _converted(row: dict, payload: bytes) -> bytes:
    """The WARC record of one ARC record."""
    original = row["original"]
    kind = "revisit" if original else "response" if row["is_http"] else "resource"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["url"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("Content-Type", HTTP_TYPE if row["is_http"] else row["type"]),
    ]
    if original:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", original["record_id"]),
            ("WARC-Refers-To-Target-URI", original["url"]),
            ("WARC-Refers-To-Date", original["date"]),
        ]
    return warc_record(fields, row["head"] if original else row["head"] + payload)


def _packed_warc(limit: int):
    def run(batches):
        worker, closed, size, parts = TaskContext.get().partitionId(), 0, 0, []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                if not parts:
                    parts.append(_info(worker, closed, row))
                parts.append(_converted(row, unpack(row["payload"])))
                size += len(parts[-1])
                if size >= limit:
                    yield _one_archive(parts, WARC_BREAK)
                    closed, size, parts = closed + 1, 0, []
        if parts:
            yield _one_archive(parts, WARC_BREAK)

    return run


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Convert ARC files to WARC files; equal HTTP payloads of at least ``least_bytes`` are written once."""
    arrow_batches(spark)
    index = written(arc_index(spark, arc_path), "arc-index")
    original = F.struct("original.record_id", "original.url", "original.date").alias("original")
    later = roles(index, least_bytes).select("file", "at", original)
    known = index.drop("page", "bytes").join(later, ["file", "at"], "left")
    records = read_arc(spark, arc_path).join(known, ["file", "at"])
    _write_files(records.mapInArrow(_packed_warc(ARCHIVE_BYTES), "content binary"), warc_path, WARC_BREAK)


def warc_entries(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """Header fields, by names in lower case, and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if end < 0 or not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {at}")
        pairs = (line.partition(b":") for line in lines)
        header = {_string(name).lower(): value.strip() for name, _, value in pairs}
        size = int(header["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at {at} declares {size} bytes, {len(block)} are left")
        yield header, block
        at = end + 4 + size


_ROWS = "page long, bytes long, digest string, kind string, record_id string, refers_to_id string, warc_date string, target_uri string"


def _warc_rows(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for header, block in warc_entries(unzipped(content.as_py())):
                kind, name = _string(header["warc-type"]), _string(header["warc-record-id"])
                if kind == "warcinfo":
                    continue
                head, payload = split_http(block)
                page, digest = _PAGE.search(head), _string(header["warc-payload-digest"]).removeprefix("sha1:")
                whole = kind != "revisit"
                if whole and base32_sha1(payload) != digest or f"sha1:{base32_sha1(block)}" != _string(header["warc-block-digest"]):
                    raise ValueError(f"the record {name} differs from its digest")
                other = header.get("warc-refers-to")
                rows.append(
                    (
                        int(page[1]) if page else None,
                        len(payload) if whole else None,
                        digest,
                        kind,
                        name,
                        other and _string(other),
                        _string(header["warc-date"]),
                        _string(header["warc-target-uri"]),
                    )
                )
            yield _batch(rows, _ROWS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files under a path but ``warcinfo``: its page, payload size (null for revisits) and digest, type, and what it refers to."""
    return whole_files(spark, path).mapInArrow(_warc_rows, _ROWS)


def with_originals(rows: DataFrame) -> DataFrame:
    """Rows of ``read_warc`` with the page that a revisit refers to as ``other``, and payload sizes of revisits too."""
    whole = rows.where("kind != 'revisit'")
    original = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page").alias("other"), F.col("bytes").alias("other_bytes"))
    later = rows.where("kind = 'revisit'").join(original, "refers_to_id", "left").withColumn("bytes", F.col("other_bytes")).drop("other_bytes")
    return later.unionByName(whole.withColumn("other", F.lit(None).cast("long")))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per page."""
    spark = pages.sparkSession
    arrow_batches(spark)
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc, key, url, html)
    convert(spark, arc, warc, least_bytes)
    rows = with_originals(written(read_warc(spark, warc), "warc-rows"))
    return rows.select(
        F.col("page").cast(pages.schema[key].dataType).alias(key),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("other").cast(pages.schema[key].dataType).alias("refers_to"),
        "record_id",
        "warc_date",
        "target_uri",
    )
