import random

import pytest
from pyspark.sql import functions as F

from geoengine.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, score double"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < (0.2 if i % 5 == 0 else 0.9)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 60))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en" if i % 2 else "de", f"host{i % 5}", 0.0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    extra = [(900, None, "en", "host1", 0.0), (901, "", None, None, 0.0), (None, docs[1][1], "en", None, 0.0), (902, "w " * 60_000, "fr", "alone", 0.0), docs[7]]
    df = spark.createDataFrame(docs + extra, SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], LABELS)
    out = quality.classify(df, lab).collect()
    assert len(out) == len(docs) + len(extra)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    bad = [r.host_score for r in out if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 5 == 0]
    good = [r.host_score for r in out if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 5 == 1]
    assert max(bad) < min(good)
    again = {r.doc_id: r.score for r in quality.classify(df.repartition(1), lab).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


def test_posteriors_against_their_definition(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs, SCHEMA)
    out = {r.doc_id: r for r in quality.classify(df, spark.createDataFrame(labels, LABELS)).collect()}
    p = {i: out[i].doc_score for i in out}
    host, path = {i: docs[i][3] for i in p}, {i: docs[i][2] for i in p}
    prior = sum(p.values()) / len(p)
    sites = spark.createDataFrame([(h, sum(x := [p[i] for i in p if host[i] == h]), sum(v * v for v in x), len(x)) for h in sorted(set(host.values()))], "host string, p double, q double, n long")
    w = quality.weight(sites, F.lit(prior))
    for i in (0, 1, 17, 60):
        rest = [p[j] for j in p if host[j] == host[i] and j != i]
        assert out[i].host_score == pytest.approx((prior * w + sum(rest)) / (w + len(rest)), rel=1e-6)


def test_sparse_sites_shrink_more(spark):
    sites = spark.createDataFrame([("a", 90.0, 82.0, 100), ("b", 20.0, 6.0, 100), ("c", 50.0, 27.0, 100)], "host string, p double, q double, n long")
    w = quality.weight(sites, F.lit(0.5))
    assert 1 <= w < 20
    alike = spark.createDataFrame([("a", 50.0, 30.0, 100), ("b", 50.0, 30.0, 100)], "host string, p double, q double, n long")
    assert quality.weight(alike, F.lit(0.5)) == 1e4


def test_without_labels_and_empty(spark):
    docs, labels = corpus(10)
    none = spark.createDataFrame([], LABELS)
    assert quality.classify(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).collect() == []
    out = quality.classify(spark.createDataFrame(docs, SCHEMA), none).collect()
    assert {round(r.score, 6) for r in out} == {0.5}
