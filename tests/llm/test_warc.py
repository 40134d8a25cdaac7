import hashlib
import random

import pytest

from geoengine.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, archive int"


def pages():
    long, other = "<p>" + "x" * 200, "<p>é" + "y" * 120
    return [(5, "http://a", long, "", 1), (3, "http://b", long, "", 1), (9, None, long, "", 1), (1, "u\r\nv", other, "", 1), (2, "u", "short", "", 1), (4, "u", "short", "", 1), (6, "u", None, "", 1), (7, "u", "", "", 1), (None, "u", long, "", 1), (None, "u", "<p>" + "z" * 300, "", 1), (3, "http://b", long, "", 1), (8, "u", "WARC/1.1\r\n" + "\x1f\x8b\x08" + "q" * 500_000, "", 1)]


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        refers = first[h] if h in first and first[h] != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_written_and_read(spark, compress):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(2)
    got = warc.read_archives(warc.archives(warc.planned(df), compress, 2000)).collect()
    assert {r.kind for r in got} == {"record"}
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(pages())
    assert warc.read_archives(warc.archives(warc.planned(df.where("false")))).collect() == []


def built(compress, n=12):
    parts = []
    for i in range(n):
        payload = random.Random(i).randbytes(50 + 40 * i)
        data = warc.record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), None)
        parts.append(warc.member(data) if compress else data)
    return parts


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_after_each_kind_of_damage(compress):
    parts = built(compress)
    ids = lambda s: [int(r.headers["x-page-id"]) for r in s.records]
    whole = b"".join(parts)
    assert ids(warc.read(whole)) == list(range(12)) and warc.read(whole).gaps == []
    starts = [len(b"".join(parts[:i])) for i in range(13)]
    bad = bytearray(whole)
    bad[starts[4] + len(parts[4]) - 30] ^= 0x55  # in the payload
    bad[starts[7]] ^= 1  # the first byte
    got = warc.read(bytes(bad))
    assert ids(got) == [0, 1, 2, 3, 5, 6, 8, 9, 10, 11]
    assert got.gaps == [(starts[4], starts[5]), (starts[7], starts[8])]
    cut = warc.read(whole[: starts[11] + 20])
    assert ids(cut) == list(range(11)) and cut.gaps == [(starts[11], starts[11] + 20)]
    mixed = warc.read(b"noise" + parts[0] + b"\x1f\x8b\x08more noise WARC/1.1" + built(not compress)[1] + parts[2][: len(parts[2]) // 2] + parts[3])
    assert ids(mixed) == [0, 1, 3] and len(mixed.gaps) == 3
    assert warc.read(b"").records == [] and warc.read(b"only noise").gaps == [(0, 10)]


def test_gaps_are_logged_as_rows(spark):
    parts = built(True, 3)
    df = spark.createDataFrame([("a", bytearray(parts[0] + b"??" + parts[1])), ("b", None)], "archive string, content binary")
    rows = warc.read_archives(df, with_payload=True).collect()
    assert [(r.offset, r.length) for r in rows if r.kind == "gap"] == [(len(parts[0]), 2)]
    assert sorted(r.page_id for r in rows if r.kind == "record") == [0, 1]
    assert {r.page_id: bytes(r.payload) for r in rows if r.kind == "record"}[1] == random.Random(1).randbytes(90)
