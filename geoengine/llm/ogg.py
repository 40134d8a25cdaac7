"""Ogg media columns: payloads stored as 8-bit samples in two multiplexed logical streams.

Writing: a payload is cut into blocks of 4096 samples; blocks take turns
between the logical streams. Each stream begins with a header packet on its own
page (the number of streams, this stream's number, block size and sample rate);
then its blocks follow as packets, laced into segments of 255 bytes and pages of
at most 255 segments. A page's granule position is the time, in samples of the
whole recording, at which its last whole packet ends; pages are written in the
order of time. Serial numbers are fixed, so equal payloads give equal bytes.

Reading: a page is taken if its checksum holds; else the bytes up to the next
capture pattern that starts a good page are skipped and reported. Packets are
reassembled from the lacing values over pages, streams are told apart by serial
number, and each packet's time is derived backwards from the granule position
of the page that it ends on. The payload is the packets in the order of time.

The checksum is the unreflected CRC-32 of Ogg. zlib has the reflected one; with
the bits of each byte reversed, and then those of the result, both agree.

The media column holds whole files, one a row. A null text is the empty text;
its payload is 64 zero bytes. A null file reads as a null row. Empty tables give
empty results, repeated rows repeated results; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import utf8

BLOCK, RATE, STREAMS, SERIAL = 4096, 8000, 2, 0x53414D50
MAGIC = b"\x01pcm8\0\0\0"
CONTINUED, FIRST, LAST = 1, 2, 4
#: The page header: pattern, version, flags, granule position, serial, sequence, checksum, segments.
HEAD = struct.Struct("<4sBBqIIIB")
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, unreflected, from zero."""
    crc = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def page(body: bytes, lacing: bytes, flags: int, granule: int, serial: int, sequence: int) -> bytes:
    rest = lacing + body
    bare = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + rest
    return HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, checksum(bare), len(lacing)) + rest


def pages(packets: list[tuple[bytes, int]], serial: int, sequence: int) -> Iterator[tuple[int, bytes]]:
    """(time it starts at, page) of packets (data, end time), the last of which ends the stream. A packet may run over any number of pages."""
    lacing, body, flags, granule, start = bytearray(), [], 0, -1, 0
    for n, (data, end) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while values:
            part = values[: 255 - len(lacing)]
            values = values[len(part) :]
            lacing += part
            body.append(data[at : at + sum(part)])
            at += len(body[-1])
            granule = granule if values else end
            last = not values and n == len(packets) - 1
            if len(lacing) == 255 or last:
                yield start, page(b"".join(body), bytes(lacing), flags | LAST * last, granule, serial, sequence)
                sequence, flags, start = sequence + 1, CONTINUED if values else 0, max(start, granule, 0)
                lacing, body, granule = bytearray(), [], -1


def write(payload: bytes, streams: int = STREAMS, block: int = BLOCK, rate: int = RATE) -> bytes:
    """The payload's bytes as an Ogg file of 8-bit samples."""
    blocks = [payload[i : i + block] for i in range(0, len(payload), block)]
    heads, rest = [], []
    for s in range(streams):
        own = [(blocks[i], min((i + 1) * block, len(payload))) for i in range(s, len(blocks), streams)]
        info = MAGIC + struct.pack("<BBIIQ", streams, s, block, rate, len(payload))
        heads.append(page(info, bytes([len(info)]), FIRST | LAST * (not own), 0, SERIAL + s, 0))
        rest += [(start, s, p) for start, p in pages(own, SERIAL + s, 1)]
    return b"".join(heads) + b"".join(p for *_, p in sorted(rest, key=lambda x: x[:2]))


@dataclass
class Recording:
    payload: bytes = b""
    streams: int = 0
    pages: int = 0
    packets: int = 0
    rate: int = 0
    samples: int = 0
    skipped: list[tuple[int, int]] = field(default_factory=list)
    lost: int = 0


def good_page(data: bytes, at: int) -> tuple[tuple, int] | None:
    """(header, end) of a page at that place, if it is whole and its checksum holds."""
    if data[at : at + 4] != b"OggS" or at + HEAD.size > len(data):
        return None
    head = HEAD.unpack_from(data, at)
    body = at + HEAD.size + head[7]
    end = body + sum(data[at + HEAD.size : body])
    if head[1] or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != head[6]:
        return None
    return head, end


def read(data: bytes) -> Recording:
    """What a file holds. Damaged pages are skipped, with the packets that they cut."""
    out, at = Recording(), 0
    open_: dict[int, bytearray | None] = {}
    next_: dict[int, int] = {}
    info: dict[int, tuple] = {}
    timed: list[tuple[int, bytes]] = []
    while at < len(data):
        got = good_page(data, at)
        if got is None:
            again = data.find(b"OggS", at + 1)
            while again >= 0 and good_page(data, again) is None:
                again = data.find(b"OggS", again + 1)
            again = len(data) if again < 0 else again
            out.skipped.append((at, again))
            at = again
            continue
        (_, _, flags, granule, serial, sequence, _, count), end = got
        lacing = data[at + HEAD.size : at + HEAD.size + count]
        place, at = at + HEAD.size + count, end
        out.pages += 1
        gap = sequence != next_.get(serial, sequence)
        next_[serial] = sequence + 1
        if gap or not flags & CONTINUED:
            out.lost += open_.get(serial) is not None
            open_[serial] = None
        whole: list[bytes] = []
        current = open_.get(serial)
        orphan = bool(flags & CONTINUED) and current is None
        current = bytearray() if current is None else current
        part = False
        for value in lacing:
            current += data[place : place + value]
            place += value
            part = value == 255
            if not part:
                if orphan:
                    orphan, out.lost = False, out.lost + 1
                else:
                    whole.append(bytes(current))
                current = bytearray()
        open_[serial] = current if part and not orphan else None
        if flags & FIRST:
            if whole and whole[0].startswith(MAGIC):
                info[serial] = struct.unpack_from("<BBIIQ", whole.pop(0), len(MAGIC))
                out.streams += 1
        out.packets += len(whole)
        if serial not in info:
            out.lost += len(whole)
            continue
        streams, _, block, out.rate, out.samples = info[serial]
        finish = granule
        for packet in reversed(whole):
            timed.append((finish - len(packet), packet))
            # this stream's packet before ended a whole round of blocks earlier
            finish = finish - len(packet) - (streams - 1) * block
    out.payload = b"".join(p for _, p in sorted(timed, key=lambda x: x[0]))
    return out


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def encode(df: DataFrame, payload: Column, name: str = "media") -> DataFrame:
    """``df`` with the column ``name``: each payload (bytes) as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 1
            media = [write(x.as_buffer().to_pybytes()) if x.is_valid else None for x in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(media, pa.binary())], names=[f"c{i}" for i in range(n)] + ["media"])

    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], payload.alias("__p"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields)] + ["media binary"])
    return inner.mapInArrow(run, schema).toDF(*df.columns, name)


def decode(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns of ``df`` with payload (bytes), media_bytes, media_sha256, streams, pages, packets, seconds, mean (of the samples), skipped (places of damaged bytes) and lost (packets)."""
    others = [c for c in df.columns if c != media_col]
    fields = [("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("streams", pa.int32()), ("pages", pa.int32()), ("packets", pa.int32()), ("seconds", pa.float64()), ("mean", pa.float64()), ("skipped", pa.list_(pa.list_(pa.int64()))), ("lost", pa.int32())]

    def row(data: bytes) -> tuple:
        r = read(data)
        samples = np.frombuffer(r.payload, np.uint8)
        return (r.payload, len(data), hashlib.sha256(data).hexdigest(), r.streams, r.pages, r.packets, samples.size / (r.rate or RATE), float(samples.mean()) if samples.size else 0.0, [list(x) for x in r.skipped], r.lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 1
            rows = [row(x.as_buffer().to_pybytes()) if x.is_valid else (None,) * len(fields) for x in b.column(n)]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(list(zip(*rows)) or [()] * len(fields), fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *arrays], names=[f"c{i}" for i in range(n)] + [f for f, _ in fields])

    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(media_col))
    schema = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(others)] + ["payload binary, media_bytes long, media_sha256 string, streams int, pages int, packets int, seconds double, mean double, skipped array<array<bigint>>, lost int"])
    return inner.mapInArrow(run, schema).toDF(*others, *[f for f, _ in fields])


def text_payload(text_col: str = "text") -> Column:
    """The text's UTF-8 bytes followed by zeros up to a positive multiple of 64."""
    text = utf8(text_col)
    n = F.octet_length(text)
    zeros = F.when(n == 0, 64).otherwise((64 - n % 64) % 64)
    return F.concat(text, F.substring(F.lit(b"\0" * 64), 1, zeros))


def tail_crc32(payload: Column) -> Column:
    """crc32 of the last 64 bytes."""
    return F.crc32(F.substring(payload, -64, 64))
