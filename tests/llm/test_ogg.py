import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from geoengine.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", b"OggS", random.Random(1).randbytes(999)):
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 64, 254, 255, 256, 4095, 4096, 4097, 8192, 65_025, 65_026, 300_001])
@pytest.mark.parametrize("streams", [1, 2, 3])
def test_round_trip(n, streams):
    data = random.Random(n).randbytes(n)
    got = ogg.read(ogg.write(data, streams))
    assert got.payload == data and not got.skipped and not got.lost and got.streams == streams and got.samples == n


def test_packets_over_pages():
    data = random.Random(5).randbytes(400_000)
    got = ogg.read(ogg.write(data, 2, block=150_000))
    assert got.payload == data and got.packets == 3


def test_damage_is_skipped_and_the_rest_is_read():
    data = random.Random(2).randbytes(400_000)
    file = bytearray(ogg.write(data))
    places = [i for i in range(len(file)) if file.startswith(b"OggS", i) and ogg.good_page(bytes(file), i)]
    file[places[3] + 1000] ^= 1
    got = ogg.read(b"junk" + bytes(file))
    assert got.skipped[0] == (0, 4) and got.skipped[1] == (places[3] + 4, places[4] + 4)
    assert got.pages == len(places) - 1
    kept = got.payload
    assert len(kept) < len(data) and all(kept[i : i + 4096] in data for i in range(0, len(kept) - 4096, 4096))
    assert ogg.read(b"").payload == b"" and ogg.read(b"OggS").skipped == [(0, 4)]


def test_columns(spark):
    texts = ["abc", None, "", "x" * 64, "é" * 40_000, "abc", "\0\0"]
    df = spark.createDataFrame([(i, t, b"m", "p") for i, t in enumerate(texts)], "doc_id long, text string, media0 binary, payload0 string").repartition(2)
    stored = ogg.encode(df, ogg.text_payload())
    assert stored.columns == [*df.columns, "media"]
    rows = {r.doc_id: r for r in ogg.decode(stored).withColumn("tail", ogg.tail_crc32(F.col("payload"))).collect()}
    for i, t in enumerate(texts):
        want = ogg.padded((t or "").encode())
        assert rows[i].payload == want and len(want) % 64 == 0 and want
        assert rows[i].tail == zlib.crc32(want[-64:])
        assert rows[i].media_sha256 == hashlib.sha256(ogg.write(want)).hexdigest()
    assert rows[0].media_sha256 == rows[5].media_sha256
    assert ogg.decode(ogg.encode(df.where("false"), ogg.text_payload())).collect() == []
    assert ogg.decode(df.select("doc_id", F.lit(None).cast("binary").alias("media"))).first().payload is None
