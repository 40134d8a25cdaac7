import random

import numpy as np
import pytest

from geoengine.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")

TEXTS = ["", " ", "Hello world", "  two  spaces ", "a\nb\n\n c", "é\x00z\t\r\n", "日本語 テキスト", "<s> hi </s>", "A\xa0b ﬁ 🙂", "x" * 300, "the " * 200 + "end", "\n", "Ünïcödé " * 30, "nospace" * 40 + " and " + "q" * 65, "a" * 64 + " " + "b" * 64]


def plain(model, text, key, dropout):
    """Merge dropout by its definition: of all pairs that form a piece and are not skipped, the best first."""
    drop = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
    out = []
    for unit in pieces.UNIT.findall(" " + text) if text else []:
        points = np.array([ord(c) for c in unit], np.uint32)
        if len(unit) <= pieces.WIDE:
            mark = (points * pieces.POWERS[: len(unit)]).sum(dtype=np.uint64)
        else:
            mark = np.uint64(pieces.xxhash.xxh64_intdigest(points.tobytes()))
        h = pieces.mix(np.array([key], np.uint64) ^ mark)
        parts = [(unit[i].replace(" ", "▁") if unit[i] != "▁" else None, i) for i in range(len(unit))]
        while True:
            best = None
            for k, ((a, i), (b, _)) in enumerate(zip(parts, parts[1:])):
                p = model.ids.get(a + b) if a and b else None
                if p is None or a not in model.ids or b not in model.ids:
                    continue
                x = pieces.mix(h + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p) * np.uint64(0xC2B2AE3D27D4EB4F))[0]
                if not (drop and x < drop) and (best is None or model.rank[p] < best[0]):
                    best = (model.rank[p], k)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k][1])]
        for a, i in parts:
            out += [model.ids[a]] if a in model.ids else [model.bytes[x] for x in unit[i].encode()]
    return out


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.MODEL)


def test_without_dropout_equals_the_library(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = model.encode([t.encode() for t in TEXTS], [0] * len(TEXTS), 0.0)
    assert [x.tolist() for x in got] == lib.encode(TEXTS)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_against_its_definition(model, dropout):
    keys = [random.Random(i).getrandbits(64) for i in range(len(TEXTS))]
    got = model.encode([t.encode() for t in TEXTS], keys, dropout)
    with np.errstate(over="ignore"):
        for t, k, x in zip(TEXTS, keys, got):
            assert x.tolist() == plain(model, t, k, dropout)
            assert model.decode(x) == t.encode()


def test_marks_bad_bytes_and_long_texts_come_back(model):
    for raw in ("▁ a▁▁b ▁".encode(), b"\xff\xfe ok \x80", ("word▁ " * 9000).encode(), b"y" * 20_000):
        for dropout in (0.0, 0.3):
            (x,) = model.encode([raw], [7], dropout)
            assert model.decode(x) == raw


def test_groups_do_not_matter(model, monkeypatch):
    raw = [t.encode() for t in TEXTS]
    a = model.encode(raw, list(range(len(raw))), 0.2)
    monkeypatch.setattr(pieces, "GROUP", 1)
    b = model.encode(raw, list(range(len(raw))), 0.2)
    assert all((x == y).all() for x, y in zip(a, b))


def test_columns(spark):
    rows = [(i, t, [1], "x") for i, t in enumerate(TEXTS)] + [(90, None, [2], "x"), (None, "a null id", [3], "x"), (2, TEXTS[2], [4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 array<int>, c1 string").repartition(3)
    out = pieces.encode(df, check=True)
    assert out.columns == [*df.columns, "ids", "lossless"]
    got = pieces.decode(out).collect()
    assert len(got) == len(rows) and all(r.lossless and r.decoded == (r.text or "") for r in got)
    again = {(r.doc_id, r.c0[0]): r.ids for r in pieces.encode(df.repartition(1)).collect()}
    assert all(again[r.doc_id, r.c0[0]] == r.ids for r in got)
    other = {r.doc_id: r.ids for r in pieces.encode(df, seed=12).collect()}
    assert any(other[r.doc_id] != r.ids for r in got)
    assert pieces.encode(df.where("false"), check=True).collect() == []
