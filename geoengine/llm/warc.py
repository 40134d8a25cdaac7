"""WARC archives: writing with revisits, and a reader that salvages what damage leaves.

Writing: of records with equal payloads of at least ``min_bytes`` bytes, the one
of the smallest id is a response, the others revisit it. The smallest id of a
payload comes from a grouped aggregation over digests, so a payload that fills a
third of the table is one partial result for each task. Records become gzip
members (or plain records), concatenated into archive files of about
``file_bytes``. Archives are rows (archive, content): Spark writes them to
whatever store it has, and a task holds one file's bytes at a time.

Reading: at each place the next member or version line must check out - the gzip
checksum, the header, the block's length and the payload's digest. If it does
not, the reader searches for the next place at which a whole record checks out
and goes on there; the bytes between are logged as a quarantined gap. Plain and
gzip records may be mixed in a file.

Null html is the empty payload. Rows of null id come last in the order of ids: a
group without any other id has only responses. Rows that repeat the smallest id
of a payload are all responses. A null url is left out of the header. Empty
tables give no archives and no records; further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import utf8

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 1 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def header_line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (without the payload) if it refers to another."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {header_line(url)}"] if url else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int]] = field(default_factory=list)


def parse(data: bytes, at: int, offset: int) -> tuple[Record, int] | None:
    """The record at that place and its end, if all of it checks out."""
    if not data.startswith(b"WARC/1.", at):
        return None
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    try:
        lines = data[at:head].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(headers["content-length"])
    except (ValueError, KeyError):
        return None
    start = head + 4
    block = data[start : start + length]
    if length < 0 or len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
        return None
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "")
    cut = block.find(b"\r\n\r\n")
    payload, size = None, 0
    if kind in ("response", "revisit"):
        if cut < 0:
            return None
        size = next((int(x[15:]) for x in block[:cut].decode("latin-1").split("\r\n") if x.lower().startswith("content-length:") and x[15:].strip().isdigit()), 0)
        if kind == "response":
            payload = block[cut + 4 :]
            if len(payload) != size or digest and digest != f"sha256:{hashlib.sha256(payload).hexdigest()}":
                return None
    return Record(offset, headers, payload, size), start + length + 4


def whole(data: bytes, at: int) -> tuple[list[Record], int] | None:
    """The records of the member or of the plain record at that place, and its end."""
    if data.startswith(GZIP, at):
        z = zlib.decompressobj(31)
        try:
            inner = z.decompress(memoryview(data)[at:])
        except zlib.error:
            return None
        if not z.eof:
            return None
        end, place, records = len(data) - len(z.unused_data), 0, []
        while place < len(inner):
            got = parse(inner, place, at)
            if got is None:
                return None
            records.append(got[0])
            place = got[1]
        return records, end
    got = parse(data, at, at)
    return ([got[0]], got[1]) if got else None


def read(data: bytes) -> Salvage:
    """All records that check out, and the gaps between them."""
    out, at = Salvage(), 0
    while at < len(data):
        got, place = whole(data, at), at
        while got is None:
            found = [x for x in (data.find(GZIP, place + 1), data.find(b"WARC/1.", place + 1)) if x >= 0]
            if not found:
                place = len(data)
                break
            place = min(found)
            got = whole(data, place)
        if place > at:
            out.gaps.append((at, place))
        if got is None:
            break
        out.records += got[0]
        at = got[1]
    return out


def planned(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to: what is to be written."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(html_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__d"), "first")
    joined = rows.join(first, F.col("digest") == F.col("__d"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def archives(rows: DataFrame, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """archive (its name), content: the planned records as archive files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def file() -> pa.RecordBatch:
            content = b"".join(parts)
            name = f"{hashlib.sha256(content).hexdigest()[:24]}.warc{'.gz' if compress else ''}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*[b.column(i) for i in range(5)]):
                data = record(page_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers.as_py())
                parts.append(member(data) if compress else data)
                size += len(parts[-1])
                if size >= file_bytes:
                    yield file()
                    parts, size = [], 0
        if parts:
            yield file()

    return rows.mapInArrow(run, "archive string, content binary")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record, and for each quarantined gap (kind = gap): archive, kind, offset, length, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    names = ["archive", "kind", "offset", "length", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                if not content.is_valid:
                    continue
                got = read(content.as_buffer().to_pybytes())
                rows = [(name, "gap", a, z - a, *[None] * 7) for a, z in got.gaps]
                for r in got.records:
                    h = r.headers
                    rows.append((name, "record", r.offset, None, number(h.get("x-page-id")), h.get("warc-target-uri"), r.payload_bytes, h.get("warc-payload-digest", "").removeprefix("sha256:"), h.get("warc-type"), number(h.get("x-refers-to-page-id")), r.payload if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    return files.mapInArrow(run, "archive string, kind string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
