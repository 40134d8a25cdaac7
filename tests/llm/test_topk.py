import math
import random

from geoengine.llm import topk


def plain(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is None or not v or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        ok.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q in ok:
        if q % every == 0:
            mine = min(ok[q])
            scores = sorted((-max(dot(mine, v) for v in ok[c]), c) for c in ok if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(map(tuple, topk.top_k(df, **options).collect()))


def f32(x):
    return __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]


def test_against_all_products(spark):
    rng = random.Random(4)
    rows = [(i, [f32(rng.gauss(0, 1) * (1 + i % 5) / (j + 1)) for j in range(12)]) for i in range(700)]
    rows += [(700 + i, list(rows[3][1])) for i in range(60)]  # ties
    rows += [(None, rows[1][1]), (800, None), (801, []), (802, [1.0, None] + [0.0] * 10), (900, [float("nan")] * 12), (901, [float("inf")] * 12), (1000, [0.0] * 12), (1001, [3.5]), (1100, [2.5, -1.25])]
    rows += [rows[7], rows[10], rows[100], (20, [f32(9.0)] * 12)]
    assert run(spark, rows, every=10, query_block=40, head=4) == plain(rows, 10, 10)
    assert run(spark, rows, every=100) == plain(rows, 10, 100)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, -1.0]), (7, [1.0, 0.0])]
    assert run(spark, rows) == plain(rows, 10, 100)
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0]), (5, [2.0])]) == []
    assert run(spark, [(0, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [f32(2e5 + i), f32(-3e4 * i)]) for i in range(0, 40, 4)]
    assert run(spark, rows, every=8) == plain(rows, 10, 8)
