import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from geoengine.llm import lm

SCHEMA = "doc_id long, text string, ids string, held int, chunk string"


def rows(n=150):
    rng = random.Random(5)
    vocabulary = ["the", "a", "of", "is", "."] + ["w%d" % i for i in range(60)]
    out = [(i, " ".join(rng.choice(vocabulary[:5] if rng.random() < 0.6 else vocabulary) for _ in range(rng.randint(0, 60))), "x", 1, "c") for i in range(n)]
    return out + [(900, None, "", 0, ""), (901, "", "", 0, ""), (902, "The THE É \x85 the\tunseen", "", 0, ""), (None, "the a of", "", 0, ""), (903, "the of " * 30_000, "", 0, ""), out[3]]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def test_counts_and_base_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = lm.score(df, chunk_tokens=700, bucket_docs=40).collect()
    assert len(out) == len(data)
    seen = Counter()
    for i, t, *_ in data:
        if not held(i):
            seen.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(seen.values()), len(seen)
    for r in out:
        t = next(x[1] for x in data if x[0] == r.doc_id)
        words = [*(t or "").encode().lower().split(), b" "]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(seen[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0
    test = [r for r in out if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    again = {(r.doc_id, r.score) for r in lm.score(df, chunk_tokens=700, bucket_docs=40).collect()}
    assert again == {(r.doc_id, r.score) for r in out}


def bucket(n_words=40, seed=1):
    rng = np.random.default_rng(seed)
    pairs = {(int(w), int(c)): int(rng.choice([0, 1, 1, 2, 3, 70, 400])) for w in range(1, n_words) for c in (3, 7, lm.START) if rng.random() < 0.7}
    keys = sorted(pairs)
    h, c, n = np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint32), np.array([pairs[k] for k in keys], np.int64)
    vocabulary = len({k[0] for k in keys if pairs[k]})
    setting = {"d": 0.6, "d0": 0.5, "theta": 2.0, "theta0": 3.0, "vocabulary": vocabulary, "tokens": int(n.sum()), "customers": np.bincount(c, weights=n, minlength=lm.CONTEXTS).astype(np.int64), "seed": 1, "sweeps": 3, "burn": 1}
    return lm.Bucket(0, lm.packed(h, c, n), setting), pairs, setting


def test_probabilities_sum_to_one():
    own, pairs, setting = bucket()
    for k in range(3):
        totals = {"tables": np.bincount(own.c, weights=own.t, minlength=lm.CONTEXTS).astype(np.int64), "t0": int(own.t0.sum())}
        unigram = own.unigram(totals)
        known = np.add.reduceat(own.n, own.starts) > 0
        unknown = (setting["theta0"] + setting["d0"] * totals["t0"]) / (setting["vocabulary"] + 1) / (setting["theta0"] + totals["tables"].sum())
        assert unigram[known].sum() + unknown == pytest.approx(1)
        p = own.predictive(totals)
        for c in (3, 7, lm.START):
            at = own.c == c
            back = (setting["theta"] + setting["d"] * totals["tables"][c]) / (setting["theta"] + setting["customers"][c])
            there = np.zeros(known.size, bool)
            there[own.word[at]] = True
            rest = unigram[known & ~there].sum() + unknown
            assert p[at][known[own.word[at]]].sum() + back * rest == pytest.approx(1)
        own.sweep(k, totals)


def arrangements(c):
    """All seatings of c customers: (tables, weight without the base)."""

    def go(sizes, left):
        if not left:
            yield sizes
            return
        yield from go([*sizes, 1], left - 1)
        for i in range(len(sizes)):
            yield from go([*sizes[:i], sizes[i] + 1, *sizes[i + 1 :]], left - 1)

    return go([], c)


def test_tables_follow_their_conditional():
    c, d, theta, others, base = 5, 0.4, 1.5, 7, 0.03
    weights = np.zeros(c + 1)
    for sizes in arrangements(c):
        w = 1.0
        for n in sizes:
            for j in range(1, n):
                w *= j - d
        for j in range(len(sizes)):
            w *= (theta + d * (others + j)) * base
        weights[len(sizes)] += w
    want = weights[1:] / weights.sum()
    k = 200_000
    got = lm.seated(np.full(k, c), np.full(k, others), np.full(k, base), theta, d, lm.stirling(d), np.random.default_rng(3))
    share = np.bincount(got, minlength=c + 1)[1:] / k
    assert np.abs(share - want).max() < 0.004


def test_many_customers_seat_near_the_expected_number():
    k, c, d, theta = 400, 3000, 0.5, 1.0
    got = lm.seated(np.full(k, c), np.zeros(k, np.int64), np.ones(k), theta, d, lm.stirling(d), np.random.default_rng(1))
    # with the base certain this is one Pitman-Yor restaurant
    want = math.exp(math.lgamma(theta + d + c) - math.lgamma(theta + c) + math.lgamma(theta + 1) - math.lgamma(theta + d)) / d - theta / d
    assert got.mean() == pytest.approx(want, rel=0.08) and got.max() <= c


def test_merged_buckets():
    rng = np.random.default_rng(0)
    parts = [(rng.integers(0, 20, 50).astype(np.uint64), rng.integers(0, 4, 50).astype(np.uint16), rng.integers(0, 3, 50).astype(np.uint32)) for _ in range(3)]
    want = Counter()
    for h, c, n in parts:
        for x, y, z in zip(h.tolist(), c.tolist(), n.tolist()):
            want[x, y] += z
    h, c, n = lm.merged(parts)
    assert {(a, b): x for a, b, x in zip(h.tolist(), c.tolist(), n.tolist())} == dict(want)
    assert sorted(zip(h.tolist(), c.tolist())) == list(zip(h.tolist(), c.tolist()))


def test_contexts_and_empty(spark):
    assert {lm.context(bytes([b]) * n) for b, n in product(range(33, 256), range(1, 7))} <= set(range(lm.START))
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    only = next(i for i in range(100) if held(i))
    (r,) = lm.score(spark.createDataFrame([(only, "a b", "", 0, "")], SCHEMA)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("buckets", [1, 16, 3750])
def test_pairs_are_packed_without_loss_and_in_little_room(buckets):
    rng = np.random.default_rng(buckets)
    words = np.unique(rng.integers(0, (1 << 64) // buckets - 1, 20_000, dtype=np.uint64)) * np.uint64(buckets) + np.uint64(buckets - 1)
    h = np.repeat(words, rng.geometric(0.25, words.size))
    c = rng.integers(0, lm.CONTEXTS, h.size).astype(np.uint32)
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    data = lm.packed_pairs(h, c, buckets)
    back = lm.unpacked_pairs(data, buckets - 1, buckets)
    assert all(np.array_equal(x, y) for x, y in zip(back, (h, c))) and back[0].dtype == h.dtype and back[1].dtype == c.dtype
    assert len(data) < 0.9 * len(lm.packed(h, c))
    none = lm.packed_pairs(h[:0], c[:0], buckets)
    assert all(x.size == 0 for x in lm.unpacked_pairs(none, 0, buckets))
