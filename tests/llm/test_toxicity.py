import random

import numpy as np

from geoengine.llm import toxicity

SCHEMA = "doc_id long, text string, score double, lang string"
LABELS = "doc_id long, quality int, toxic int"


def all_maximal(scores):
    """Maximal-scoring segments by their definition: recursively the best segment, then what lies left and right of it."""
    out = []

    def cut(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12 or (abs(total - best[0]) <= 1e-12 and j + 1 - i > best[2] - best[1])):
                    best = (total, i, j + 1)
        if best:
            out.append((best[1], best[2], best[0]))
            cut(a, best[1])
            cut(best[2], b)

    cut(0, len(scores))
    return sorted(out)


def test_segments_against_the_definition():
    rng = random.Random(2)
    for _ in range(200):
        scores = np.array([rng.uniform(-3, 2.5) for _ in range(rng.randint(0, 25))])
        got = sorted(toxicity.segments(scores))
        want = all_maximal(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus(n=400):
    rng = random.Random(1)
    words = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(body))
            body[at:at] = [rng.choice(["vilely", "NASTY!!", "foulest", "foulish"]) for _ in range(6)]
        docs.append((i, " ".join(body), 0.0, "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    extra = [(900, None, 0.0, ""), (901, "", 0.0, ""), (902, "12 !!", 0.0, ""), (None, docs[0][1], 0.0, ""), (903, "wa " * 50_000 + "nasty vilely foulest nasty vilely foulest", 0.0, ""), (0, docs[0][1], 0.0, "")]
    df = spark.createDataFrame(docs + extra, SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (0, 1, 1)], LABELS)
    out = toxicity.detect(df, lab).collect()
    assert len(out) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in out}
    for i in (900, 901, 902):
        assert by[i].predicted == 0 and by[i].passages == [] and 0 <= by[i].score <= 1
    assert by[903].predicted == 1 and by[903].passages[0].start >= 49_990 and by[None].predicted == 1
    kept = toxicity.keep_clean(df, lab)
    assert kept.columns == df.columns
    got = {r.doc_id for r in kept.collect()}
    assert 903 not in got and {900, 901, 902, 1, 2} <= got
    again = {r.doc_id: r.score for r in toxicity.detect(df.repartition(5), lab).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


def test_without_labels_and_empty(spark):
    docs, labels = corpus(12)
    df = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity.detect(df, none).collect()} == {0}
    assert toxicity.detect(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).collect() == []
    assert {r.predicted for r in toxicity.detect(df, spark.createDataFrame([(1, 0, 1)], LABELS)).collect()} <= {0, 1}
