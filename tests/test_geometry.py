import math
import random

import pytest
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.functions import overlay_kernel as ok
from geoengine.functions import projection


def box(a, b, c, d):
    return [[[(a, b), (c, b), (c, d), (a, d), (a, b)]]]


def test_boolean_operations_conserve_area():
    rng = random.Random(1)

    def star():
        cx, cy = rng.uniform(0, 10), rng.uniform(0, 10)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 9)))
        ring = [(cx + rng.uniform(1, 6) * math.cos(t), cy + rng.uniform(1, 6) * math.sin(t)) for t in turns]
        return ok.make_valid([[[*ring, ring[0]]]])

    for _ in range(60):
        a, b = star(), star()
        both, either = ok.area(ok.intersection(a, b)), ok.area(ok.union([a, b]))
        left, right = ok.area(ok.difference(a, [b])), ok.area(ok.difference(b, [a]))
        assert ok.area(a) == pytest.approx(both + left, abs=1e-3)
        assert either == pytest.approx(both + left + right, abs=1e-3)
        assert ok.area(ok.symmetric_difference(a, b)) == pytest.approx(left + right, abs=1e-3)


def test_holes_and_parts():
    donut = ok.difference(box(0, 0, 10, 10), [box(3, 3, 5, 5)])
    assert len(donut) == 1 and len(donut[0]) == 2 and ok.area(donut) == pytest.approx(96)
    assert len(ok.difference(box(0, 0, 9, 2), [box(3, -1, 6, 3)])) == 2
    assert ok.union([box(0, 0, 1, 1), box(5, 5, 6, 6)]).__len__() == 2
    assert ok.intersection(box(0, 0, 1, 1), box(5, 5, 6, 6)) == []
    assert ok.area(ok.union([box(0, 0, 2, 2), box(2, 0, 4, 2)])) == pytest.approx(8) and len(ok.union([box(0, 0, 2, 2), box(2, 0, 4, 2)])) == 1


def test_buffers():
    assert ok.area(ok.buffer("Point", [[[(0, 0)]]], 2, 30)) == pytest.approx(4 * math.pi, rel=1e-3)
    assert ok.area(ok.buffer("Polygon", box(0, 0, 10, 10), 1)) == pytest.approx(140 + math.pi, rel=1e-3)
    assert ok.area(ok.buffer("Polygon", box(0, 0, 10, 10), -1)) == pytest.approx(64, rel=1e-6)
    assert ok.buffer("Polygon", box(0, 0, 1, 10), -0.6) == []
    assert ok.area(ok.buffer("Polygon", box(0, 0, 10, 10), 1, join_style="mitre")) == pytest.approx(144)
    assert ok.area(ok.buffer("LineString", [[[(0, 0), (10, 0)]]], 1)) == pytest.approx(20 + math.pi, rel=1e-3)


@pytest.mark.parametrize(
    "name, a, b, want",
    [
        ("intersects", ("Point", [[[(0, 0)]]]), ("Polygon", box(0, 0, 4, 4)), True),
        ("within", ("Point", [[[(0, 0)]]]), ("Polygon", box(0, 0, 4, 4)), False),
        ("within", ("Point", [[[(1, 1)]]]), ("Polygon", box(0, 0, 4, 4)), True),
        ("touches", ("Polygon", box(0, 0, 4, 4)), ("Polygon", box(4, 0, 8, 4)), True),
        ("overlaps", ("Polygon", box(0, 0, 4, 4)), ("Polygon", box(2, 2, 6, 6)), True),
        ("contains", ("Polygon", box(0, 0, 9, 9)), ("Polygon", box(0, 0, 4, 4)), True),
        ("contains_properly", ("Polygon", box(0, 0, 9, 9)), ("Polygon", box(0, 0, 4, 4)), False),
        ("contains_properly", ("Polygon", box(-1, -1, 9, 9)), ("Polygon", box(0, 0, 4, 4)), True),
        ("covers", ("Polygon", box(0, 0, 4, 4)), ("Polygon", box(0, 0, 4, 4)), True),
        ("covered_by", ("Polygon", box(1, 1, 2, 2)), ("Polygon", box(0, 0, 4, 4)), True),
        ("crosses", ("LineString", [[[(-1, 1), (5, 1)]]]), ("Polygon", box(0, 0, 4, 4)), True),
        ("crosses", ("LineString", [[[(0, 0), (2, 2)]]]), ("LineString", [[[(0, 2), (2, 0)]]]), True),
        ("overlaps", ("LineString", [[[(0, 0), (2, 0)]]]), ("LineString", [[[(1, 0), (3, 0)]]]), True),
        ("touches", ("LineString", [[[(0, 0), (2, 0)]]]), ("LineString", [[[(2, 0), (3, 3)]]]), True),
        ("intersects", ("Polygon", box(0, 0, 4, 4)), ("Polygon", box(5, 5, 6, 6)), False),
        ("intersects", ("Polygon", []), ("Polygon", box(5, 5, 6, 6)), False),
    ],
)
def test_predicates(name, a, b, want):
    assert ok.predicate(name, a, b) is want


def test_distances_within():
    a, b = ("Point", [[[(7, 4)]]]), ("Polygon", box(0, 0, 4, 4))
    assert ok.separation(a, b) == 3 and ok.predicate("dwithin", a, b, 3) and not ok.predicate("dwithin", a, b, 2.9)


def test_measures(spark):
    df = spark.range(1).select(
        g.box(F.lit(0), F.lit(0), F.lit(4), F.lit(3)).alias("p"),
        g.line(F.array(g.vertex(0.0, 0.0), g.vertex(3.0, 4.0), g.vertex(3.0, 10.0))).alias("l"),
        k.from_wkt(F.lit("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((10 0, 12 0, 12 2, 10 2, 10 0)))")).alias("m"),
    )
    r = df.select(g.area("p").alias("a"), g.length("p").alias("b"), g.length("l").alias("c"), g.centroid("p").alias("d"), g.area("m").alias("e"), F.size(g.get_holes("m")).alias("h"), g.area(g.close_all_holes("m")).alias("f"), g.to_wkt("l").alias("w"), g.bounds("m").alias("x"), g.geom_family("m").alias("k"), F.size(g.segments("l")).alias("n"), g.contains_vertex("m", g.vertex(1.5, 1.5)).alias("in_hole"), g.contains_vertex("m", g.vertex(11.0, 1.0)).alias("inside"), F.size(g.explode_parts("m")).alias("parts"), g.centroid("l").alias("lc")).first()
    assert (r.a, r.b, r.c, r.e, r.h, r.f, r.k, r.n, r.in_hole, r.inside, r.parts) == (12, 14, 11, 19, 1, 20, "polygon", 2, False, True, 2)
    assert tuple(r.d) == (2, 1.5) and tuple(r.x) == (0, 0, 12, 4) and r.w == "LINESTRING (0 0, 3 4, 3 10)"
    assert r.lc.x == pytest.approx((1.5 * 5 + 3 * 6) / 11)


def test_texts_and_bytes(spark):
    texts = ["POINT (1 2)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("geometry", k.from_wkt(F.col("t")))
    rows = df.select("t", g.to_wkt("geometry").alias("w"), g.to_wkt(k.from_wkb(k.to_wkb(F.col("geometry")))).alias("b"), g.to_wkt(k.from_geojson(k.to_geojson(F.col("geometry")))).alias("j")).collect()
    assert all(r.t == r.w == r.b == r.j for r in rows)
    assert spark.range(1).select(g.to_wkt(k.from_wkt(F.lit("SRID=25833;POINT Z (1 2 3)")))).first()[0] == "POINT (1 2)"


def test_projection_against_a_known_place(spark):
    # the central meridian maps to 500 km east; a degree of latitude there is the meridian's arc
    r = spark.range(1).select(projection.from_4326(F.lit(15.0), F.lit(0.0)).alias("a"), projection.from_4326(F.lit(15.0), F.lit(60.0)).alias("b"), projection.from_4326(F.lit(10.75), F.lit(59.91)).alias("c")).first()
    assert tuple(r.a) == pytest.approx((500_000, 0), abs=1e-6)
    assert r.b.y == pytest.approx(6_651_411.190, abs=0.01)
    back = spark.range(1).select(projection.to_4326(F.lit(r.c.x), F.lit(r.c.y))).first()[0]
    assert (back.x, back.y) == pytest.approx((10.75, 59.91), abs=1e-9)
    with pytest.raises(ValueError):
        projection.meridian(4326)


def test_jenks_and_tours():
    assert k.jenks([1, 2, 3, 10, 11, 12, 30], [1] * 7, 3) == [3, 12, 30]
    points = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    rng = random.Random(3)
    shuffled = rng.sample(points, len(points))
    order = k.tour(shuffled)
    tour = [shuffled[i] for i in order]
    assert sorted(order) == list(range(8)) and sum(math.dist(a, b) for a, b in zip(tour, tour[1:] + tour[:1])) == pytest.approx(8)
    open_tour = [shuffled[i] for i in k.tour(shuffled, closed=False)]
    assert sum(math.dist(a, b) for a, b in zip(open_tour, open_tour[1:])) == pytest.approx(7)


def test_cutting():
    assert k.cut([(0, 0), (10, 0)], [4, 4, 20, -1]) == [[(0, 0), (4.0, 0.0)], [(4.0, 0.0), (10, 0)]]
    assert k.cut([(0, 0), (1, 0), (2, 0)], [1]) == [[(0, 0), (1, 0)], [(1.0, 0.0), (2, 0)]]
    assert ok.simplify([(0, 0), (1, 0.01), (2, 0), (3, 2)], 0.1) == [(0, 0), (2, 0), (3, 2)]


def test_rectangles_take_the_short_way_to_the_same_result():
    rng = random.Random(7)
    for _ in range(60):
        a, b = (box(x, y, x + rng.randint(1, 6), y + rng.randint(1, 6)) for x, y in ((rng.randint(0, 6), rng.randint(0, 6)) for _ in range(2)))
        both = ok.arrange([a, b], lambda c: c.all(axis=1))
        assert ok.area(ok.intersection(a, b)) == pytest.approx(ok.area(both))
        assert ok.predicate("intersects", ("Polygon", a), ("Polygon", b)) == (ok.separation(("Polygon", a), ("MultiPolygon", b)) == 0)
    assert ok.as_box([[[(0, 0), (2, 0), (1, 1), (0, 1), (0, 0)]]]) is None and ok.as_box([[[(0, 0), (1, 1), (0, 1), (1, 0), (0, 0)]]]) is None
