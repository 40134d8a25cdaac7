import math

import pytest
from pyspark.sql import functions as F

from geoengine.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, k string"


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare the excess until no source is above its cap. sizes: source -> words, in order."""
    w = {s: weights[i % 3] for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        level = left / max(1, sum(w[s] for s in free))
        over = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in sizes}
        capped |= over


def make(spark):
    rows = []
    for s, (name, n) in enumerate([("A", 400), ("B", 30), ("C", 7), ("é", 300), (None, 90)]):
        for i in range(n):
            text = " ".join(["w"] * (1 + (i * 37 + s) % 61)) if i % 29 else (None if i % 2 else " \t")
            rows.append((1000 * s + i, text, name, -1, "x"))
    rows += [rows[3], rows[3], (None, "a null id", "A", 1, "y"), (5, "same id", "B", 1, "y")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_taken_and_reruns(spark):
    df, rows = make(spark)
    got = mixing.draws(df, block_docs=16, shards=4)
    assert got.columns[:5] == df.columns
    out = got.collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    sizes = dict(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")))
    want = plain_targets(sizes)
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-6 for s in sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert {r["__m_source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["__m_target"] == pytest.approx(want[s])
        taken = sum(r["__m_size"] * len(r["__m_shards"]) for r in mine)
        assert abs(taken - want[s]) <= max(3, 0.01 * want[s])
        assert all(len(r["__m_shards"]) <= 3 for r in mine)
    again = mixing.draws(df.repartition(3), block_docs=16, shards=4).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mixed = mixing.mix(df, block_docs=16, shards=4)
    assert mixed.columns == df.columns and mixed.count() == sum(len(r["__m_shards"]) for r in out)


def test_shard_counts_are_exact_and_balanced(spark):
    q = spark.createDataFrame([(0, 100), (1, 7), (2, 0), (3, 10_000)], "k long, draws long")
    ends = {r.k: r.ends for r in mixing.shard_counts(q, 3, 5).collect()}
    assert [ends[k][-1] for k in range(4)] == [100, 7, 0, 10_000]
    per = [sum(ends[k][i] - (ends[k][i - 1] if i else 0) for k in ends) for i in range(8)]
    assert sum(per) == 10_107 and max(per) - min(per) <= 1
    assert all(a <= b for e in ends.values() for a, b in zip(e, e[1:]))


def test_hypergeometric_follows_the_distribution(spark):
    n = 4000
    got = spark.range(n).select(mixing._hypergeometric(F.lit(50), F.lit(20), F.lit(12), (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
    for r in got:
        p = math.comb(20, r.x) * math.comb(30, 12 - r.x) / math.comb(50, 12)
        assert abs(r["count"] / n - p) < 1.5 / n


@pytest.mark.parametrize("bits", [0, 1, 2, 5, 9])
def test_permutation_is_one(spark, bits):
    got = spark.range(1 << bits).select(mixing._permuted(F.col("id"), F.lit(bits), F.lit(-1234567890123)).alias("x")).distinct()
    assert sorted(r.x for r in got.collect()) == list(range(1 << bits))


def test_empty_and_sizeless(spark):
    assert mixing.draws(spark.createDataFrame([], SCHEMA)).collect() == []
    out = mixing.draws(spark.createDataFrame([(1, None, "A", 0, ""), (2, " ", None, 0, "")], SCHEMA)).collect()
    assert [(r["__m_size"], r["__m_target"]) for r in out] == [(0, 0.0), (0, 0.0)]


def test_ids_of_any_type_and_without_ids(spark):
    df, rows = make(spark)
    named = df.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    out = mixing.draws(named, block_docs=16, shards=4).collect()
    assert len(out) == len(rows) and any(r["__m_shards"] for r in out)
    # rows without an id are dealt by their texts, not into one block
    none = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 300, "A").otherwise("B").alias("source"))
    sources, _ = mixing.plan(none, block_docs=16, shards=4)
    keyed = none.select("source", mixing.row_key("doc_id", "text", 17).alias("h"), F.lit(2).alias("size"))
    per = [r["count"] for r in mixing._placed(keyed, sources, 17).groupBy("source", "rank").count().collect()]
    assert len(per) > 30 and max(per) < 40
    taken = {s: 0 for s in "AB"}
    for r in mixing.draws(none, block_docs=16, shards=4).collect():
        taken[r.source] += 2 * len(r["__m_shards"])
    assert taken == {"A": 400, "B": 800}


def test_room_of_the_last_block_goes_on(spark):
    # one document of the source is far larger than a block's share; small ones of later blocks fill the room
    rows = [(i, "w " * (400 if i % 8 == 0 else 1 + i % 3), "A") for i in range(512)] + [(1000 + i, "w " * 60, "B") for i in range(512)]
    out = mixing.draws(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=8, shards=4).collect()
    for s in "AB":
        mine = [r for r in out if r.source == s]
        taken = sum(r["__m_size"] * len(r["__m_shards"]) for r in mine)
        assert abs(taken - mine[0]["__m_target"]) <= 60
