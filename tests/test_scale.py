"""What keeps the joins and kernels in proportion to their input: plans, shared places, shapes that need no kernel."""

import random

import numpy as np
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.operators import grid, joins, network, overlay


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def places(spark, n, names, copies=1, seed=5):
    r = random.Random(seed)
    at = [(r.randrange(40), r.randrange(40)) for _ in range(n)]
    return spark.createDataFrame([(i, *at[i % n]) for i in range(n * copies)], f"{names[0]} long, {names[1]} long, {names[2]} long")


def test_sides_of_a_cell_join_are_not_broadcast(spark):
    a, b = places(spark, 20, ("id", "x", "y")), places(spark, 20, ("sid", "rx", "ry"), seed=6)
    box = lambda df, x, y, p: df.select("*", *[(F.col(c) + d).alias(f"{p}{n}") for n, (c, d) in enumerate(((x, 0), (y, 0), (x, 3), (y, 3)))])
    names = lambda p: tuple(f"{p}{n}" for n in range(4))
    boxes = joins.box_pairs(box(a, "x", "y", "a"), box(b, "rx", "ry", "b"), names("a"), names("b"), 4.0)
    for df in (joins.point_pairs(a, b, 5.0), boxes):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)


def test_rows_at_one_place_share_their_search(spark, monkeypatch):
    a, b = places(spark, 15, ("id", "x", "y"), copies=20), places(spark, 15, ("sid", "rx", "ry"), copies=20, seed=6)
    left, right = a.collect(), b.collect()
    seen, pairs = [], joins.point_pairs
    monkeypatch.setattr(joins, "point_pairs", lambda l, r, *o: seen.append((l.count(), r.count())) or pairs(l, r, *o))
    got = {(r.id, r["rank"]): r.sid for r in joins.k_nearest(a, b, 3, "id", "sid").collect()}
    for p in left:
        best = sorted(((p.x - q.rx) ** 2 + (p.y - q.ry) ** 2, q.sid) for q in right)[:3]
        assert [got[p.id, n + 1] for n in range(3)] == [sid for _, sid in best]
    # 15 places, and of neighbours at a place three at most
    assert all(m <= 15 and n <= 45 for m, n in seen)
    near = {(p.id, q.sid) for p in left for q in right if (p.x - q.rx) ** 2 + (p.y - q.ry) ** 2 <= 25}
    assert {tuple(r) for r in joins.get_neighbor_indices(a, b, 5, right_key="sid").collect()} == near
    stats = {r.sid: (r.n, r.nearest) for r in joins.within_distance_stats(a, b, 5).collect()}
    for q in right:
        d = [((p.x - q.rx) ** 2 + (p.y - q.ry) ** 2) ** 0.5 for p in left if (p.x - q.rx) ** 2 + (p.y - q.ry) ** 2 <= 25]
        assert stats.get(q.sid) == ((len(d), min(d)) if d else None)
    assert all(m <= 15 for m, _ in seen)


def test_snapping_looks_far_only_where_it_must(spark, monkeypatch):
    points = places(spark, 30, ("id", "x", "y")).unionByName(spark.createDataFrame([(99, 70, 20)], "id long, x long, y long"))
    segments = places(spark, 300, ("ax", "ax0", "ay"), seed=7).select(F.col("ax0").alias("ax"), "ay", (F.col("ax0") + 1).alias("bx"), (F.col("ay") + 1).alias("by"))
    reaches, pairs = [], joins.box_pairs
    monkeypatch.setattr(joins, "box_pairs", lambda *o: reaches.append(pairs(*o).count()) or pairs(*o))
    got = {r.id: r.snap_distance for r in joins.snap(points, segments, "id", 40.0).collect()}
    for p in points.collect():
        best = 1e9
        for s in segments.collect():
            t = min(1.0, max(0.0, ((p.x - s.ax) + (p.y - s.ay)) / 2))
            best = min(best, ((p.x - s.ax - t) ** 2 + (p.y - s.ay - t) ** 2) ** 0.5)
        assert (got[p.id] or 0) == best if best <= 40 else got[p.id] is None
    assert sum(reaches) < 31 * 300 / 4


def test_parallel_edges_do_not_count_against_the_bound(spark, monkeypatch):
    r = random.Random(3)
    rows = [(n, s, (s + step) % 6, float(r.randrange(1, 9))) for n, (s, step) in enumerate((s, step) for s in range(6) for step in (0, 1, 2) for _ in range(9))]
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, weight double")
    pairs = spark.createDataFrame([(o, d) for o in range(3) for d in range(6)], "origin long, destination long")
    want = {directed: sorted(map(tuple, network.get_k_routes(edges, pairs, 3, 50, directed=directed).collect())) for directed in (True, False)}
    whole = network.Graph(rows, True)
    assert {(o, d): sum(w for *_, w in (rows[e] for a, b, k_, _, e in want[True] if (a, b, k_) == (o, d, 1))) for o in range(3) for d in range(6) if o != d} == {(o, d): c for o in range(3) for d, c in whole.costs(o)[0].items() if d != o}
    monkeypatch.setattr(network, "BROADCAST_EDGES", 36)
    monkeypatch.setattr(network, "routes_by_joins", None)
    for directed in (True, False):
        assert sorted(map(tuple, network.get_k_routes(edges, pairs, 3, 50, directed=directed).collect())) == want[directed]


def test_edges_of_a_service_area_are_not_gathered(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 1, 2, 5.0)], "edge_id long, source long, target long, weight double")
    out = network.service_area(edges, spark.createDataFrame([(0,), (7,)], "origin long"), [2])
    assert sorted(map(tuple, out.collect())) == [(0, 2.0, 1), (7, 2.0, None)]
    assert "LeftOuter" not in plan(out) and "BroadcastHashJoin" in plan(out)


def test_random_points_need_no_window(spark):
    shapes = spark.createDataFrame([(1, "POLYGON ((0 0, 9 0, 0 9, 0 0))"), (2, "POLYGON ((0 0, 9 0, 9 1, 0 9, 0 0))")], "id long, t string").select("id", k.from_wkt(F.col("t")).alias("geometry"))
    out = grid.random_points_in_polygons(shapes, "id", 6, seed=2)
    assert "Window" not in plan(out)
    u = lambda salt: F.pmod(F.xxhash64(F.lit(2), F.lit(salt), "id", "i"), F.lit(1 << 40)) / float(1 << 40) * 9
    trial = shapes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(240)))).select("id", "i", u(1).alias("x"), u(2).alias("y"), "geometry").where(g.contains_vertex("geometry", g.vertex("x", "y")))
    want = {}
    for row in trial.orderBy("i").collect():
        want.setdefault(row.id, []).append((row.x, row.y))
    got = {n: sorted((r.x, r.y) for r in out.collect() if r.id == n) for n in (1, 2)}
    assert got == {n: sorted(v[:6]) for n, v in want.items()}


def boxes(spark, n, seed, name="id"):
    r = random.Random(seed)
    rows = [(i, x := r.randrange(30), y := r.randrange(30), x + r.randrange(1, 9), y + r.randrange(1, 9)) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, a long, b long, c long, d long").select(name, g.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry")), rows


def corners(row):
    x0, y0, x1, y1 = row[1:]
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


def test_rectangles_are_told_from_other_shapes(spark):
    texts = ["POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((0 0, 0 2, 1 2, 1 0, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 0.5, 0 0))", "POLYGON ((0 0, 0 0, 1 1, 0 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "POINT (1 1)", "POLYGON EMPTY", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)))"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", k.from_wkt(F.col("t")).alias("geometry"))
    assert [r.b for r in df.orderBy("id").select(g.is_box("geometry").alias("b")).collect()] == [True, True] + [False] * 6


def test_rectangles_are_paired_without_a_kernel(spark):
    (a, left), (b, right) = boxes(spark, 25, 1), boxes(spark, 25, 2, "other")
    for name in ("intersects", "within", "contains"):
        pairs = overlay.geometry_pairs(a, b, "id", "other", name, size=8.0)
        assert "ArrowEvalPython" not in plan(pairs)
        want = {(p[0], q[0]) for p in left for q in right if k.k.predicate(name, ("Polygon", corners(p)), ("Polygon", corners(q)))}
        assert {(r.id, r.other) for r in pairs.collect()} == want
    found = overlay.get_intersections(a, "id", 8.0)
    assert "ArrowEvalPython" not in plan(found)
    assert found.count() == sum(bool(k.k.intersection(corners(p), corners(q))) for p in left for q in left if p[0] != q[0])


def test_rectangles_are_erased_without_pairs(spark, monkeypatch):
    (a, left), (b, right) = boxes(spark, 25, 3), boxes(spark, 12, 4, "other")
    monkeypatch.setattr(overlay, "box_pairs", None)
    for rows, before in ((overlay.clean_overlay(a, b, "difference", size=8.0), None), (overlay.update_geometries(a, "id", size=8.0), True)):
        got = {r.id: r.area for r in rows.groupBy("id").agg(F.sum(g.area("geometry")).alias("area")).collect()}
        for p in left:
            others = [corners(q) for q in (right if before is None else left[: p[0]])]
            want = k.k.area(k.k.difference(corners(p), others))
            assert abs(got.get(p[0], 0) - want) < 1e-6


def test_large_lattices_are_quartered(monkeypatch):
    r = random.Random(8)
    b = np.array([(x := r.randrange(30), y := r.randrange(30), x + r.randrange(1, 9), y + r.randrange(1, 9)) for _ in range(30)]) * 1_000_000
    yes, sizes = np.ones(30, bool), []
    for fields in (1 << 24, 9):
        monkeypatch.setattr(k.k, "FIELDS", fields)
        left = dict.fromkeys(range(30), 0.0)
        for n, state, parts in k.k.unpainted(b, yes, yes):
            left[n] += k.k.area(parts) if state == 2 else (b[n, 2] - b[n, 0]) * (b[n, 3] - b[n, 1]) / 1e12 * state
        sizes.append({n: round(v, 6) for n, v in left.items()})
    assert sizes[0] == sizes[1] and sizes[0][0] > 0


def test_rectangles_unite_and_cluster(spark, monkeypatch):
    a, rows = boxes(spark, 40, 5)
    shapes = [corners(r) for r in rows]
    whole = k.k.arrange(shapes, lambda c: c.any(axis=1))
    assert abs(k.k.area(k.k.union(shapes)) - k.k.area(whole)) < 1e-6 and len(k.k.union(shapes)) == len(whole)
    monkeypatch.setattr(overlay, "geometry_pairs", None)
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for p in rows:
            root[p[0]] = min(root[q[0]] for q in rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert {r.id: r.cluster for r in overlay.get_polygon_clusters(a, "id").collect()} == root
