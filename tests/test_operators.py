import math
import random

import pytest
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.operators import classify, components, grid, joins, lines, network, overlay, raster, sorts
from geoengine.sources import constructors, vector


def boxes(spark, rows, names="id long, a double, b double, c double, d double"):
    df = spark.createDataFrame([(r[0], *map(float, r[1:5])) for r in rows], names)
    return df.select("id", g.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))


def areas(df, key="id"):
    return {r[0]: round(r[1], 6) for r in df.groupBy(key).agg(F.sum(g.area("geometry"))).collect()}


# joins -------------------------------------------------------------------


def test_semi_join_points(spark):
    left = spark.createDataFrame([(3, 0, 0), (1, 0, 1), (2, 1, 1)], "id int, x int, y int")
    right = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "rx int, ry int")
    for d, want in ((1, {1, 2, 3}), (0.5, {2, 3}), (0, {2, 3})):
        inside, outside = joins.sfilter_split(left, joins.point_pairs(left, right, d), "id")
        assert {r.id for r in inside.collect()} == want and {r.id for r in outside.collect()} == {1, 2, 3} - want
        assert inside.count() == len(want)


def test_neighbours_include_self(spark):
    p = [(0, 0.0, 0.0), (1, 0.5, 0.5), (2, 2.0, 2.0)]
    a, b = spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(p, "neighbor_id long, rx double, ry double")
    for d, want in ((0, {0}), (1, {0, 1}), (3, {0, 1, 2})):
        assert {r.neighbor_id for r in joins.get_neighbor_indices(a, b, d).where("id = 0").collect()} == want


def test_nearest_against_all_distances(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)] + [(99, 5000.0, -3000.0)]
    b = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(30)] + [(77, a[0][1], a[0][2]), (78, a[0][1], a[0][2])]
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "nid long, rx double, ry double")
    for n in (1, 4, 50):
        got = sorted((r.id, r["rank"], r.nid) for r in joins.k_nearest(left, right, n, "id", "nid").collect())
        want = []
        for i, x, y in a:
            near = sorted((math.hypot(x - p, y - q), j) for j, p, q in b)[:n]
            want += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
        assert got == sorted(want)
    with pytest.raises(ValueError):
        joins.k_nearest(left, right, 50, "id", "nid", strict=True)
    assert joins.k_nearest(left, right.where("false"), 2, "id", "nid").count() == 0


def test_snapping(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 0.0), (3, 50.0, 50.0)], "id long, x double, y double")
    segs = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0)], "ax double, ay double, bx double, by double")
    got = {r.id: (r.snap_x, r.snap_y, r.snap_distance) for r in joins.snap(points, segs, "id", 2.0).collect()}
    assert got == {1: (1.0, 0.0, 1.0), 2: (5.0, 0.0, None), 3: (None, None, None)}


def test_box_pairs_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 10.0, 10.0, 11.0, 11.0)], "id long, a double, b double, c double, d double")
    b = a.toDF("oid", "e", "f", "g", "h")
    got = sorted((r.id, r.oid) for r in joins.box_pairs(a, b, ("a", "b", "c", "d"), ("e", "f", "g", "h"), 3.0).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]


# overlay -----------------------------------------------------------------


@pytest.mark.parametrize("how, columns", [("intersection", ["id_1", "z", "id_2", "w"]), ("difference", ["id", "z"]), ("union", ["id_1", "z", "id_2", "w"]), ("identity", ["id_1", "z", "id_2", "w"]), ("symmetric_difference", ["id_1", "z", "id_2", "w"]), ("update", ["id", "z", "w"])])
def test_overlay_columns_and_areas(spark, how, columns):
    a = boxes(spark, [(1, 0, 0, 4, 4), (2, 20, 0, 22, 2)]).withColumn("z", F.lit("a"))
    b = boxes(spark, [(1, 2, 2, 6, 6), (7, 50, 50, 51, 51)]).withColumn("w", F.lit("b"))
    out = overlay.clean_overlay(a, b, how)
    assert set(out.columns) == {*columns, "geometry"} and out.columns[-1] == "geometry"
    total = out.agg(F.sum(g.area("geometry"))).first()[0]
    want = {"intersection": 4, "difference": 16, "union": 33, "identity": 20, "symmetric_difference": 29, "update": 16 + 17}
    assert total == pytest.approx(want[how])
    with pytest.raises(ValueError):
        overlay.clean_overlay(a, b, "nearest")


def test_update_gives_the_first_row_its_area(spark):
    out = overlay.update_geometries(boxes(spark, [(1, 0, 0, 4, 4), (2, 2, 2, 6, 6), (3, 1, 1, 3, 3)]), "id")
    assert areas(out) == {1: 16, 2: 12}


def test_dissolve_singletons_keep_their_values(spark):
    df = boxes(spark, [(1, 0, 0, 1, 1), (2, 1, 0, 2, 1), (3, 9, 9, 10, 10)]).withColumn("k", F.when(F.col("id") < 3, "a").otherwise("b")).withColumn("v", F.col("id") * 10)
    out = {r.k: (r.v, r.area) for r in overlay.diss(df.select("k", "v", "geometry"), "k", {"v": F.count("v")}).withColumn("area", g.area("geometry")).collect()}
    assert out == {"a": (2, 2.0), "b": (30, 1.0)}
    assert overlay.diss(df.select("v", "geometry")).count() == 1
    assert overlay.dissexp(df.select("v", "geometry")).count() == 2
    nulls = df.withColumn("k", F.when(F.col("id") != 3, F.col("k"))).select("k", "geometry")
    assert overlay.diss(nulls, "k").count() == 1 and overlay.diss(nulls, "k", dropna=False).count() == 2


def test_clusters_by_buffer(spark):
    points = [(0, 0), (0, 1), (1, 0), (1, 1), (9, 9), (9, 10), (20, 20)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double").select("id", g.point_buffer(g.vertex("x", "y"), 2.0, 8).alias("geometry"))
    sizes = sorted(r["count"] for r in overlay.get_polygon_clusters(df, "id").groupBy("cluster").count().collect())
    assert sizes == [1, 2, 4]
    wide = overlay.buff(df, 10.0, 4)
    assert overlay.get_polygon_clusters(wide, "id").select("cluster").distinct().count() == 1
    assert overlay.dissexp_by_cluster(df, "id").count() == 3
    # boxes of the rows meet although the rows don't
    corners = boxes(spark, [(1, 0, 0, 4, 4)]).unionByName(spark.range(1).select(F.lit(2).cast("long").alias("id"), g.polygon(F.array(g.vertex(3.9, 8.0), g.vertex(8.0, 3.9), g.vertex(8.0, 8.0), g.vertex(3.9, 8.0))).alias("geometry")))
    assert overlay.diss_by_cluster(corners, "id").count() == 1 and overlay.dissexp_by_cluster(corners, "id").count() == 2


def test_eliminate_and_isolated(spark):
    hosts = boxes(spark, [(1, 0, 0, 10, 5), (2, 11, 0, 30, 9)])
    small = boxes(spark, [(3, 10, 0, 11, 8), (4, 10, 8, 11, 9), (5, 100, 100, 101, 101)])
    out, isolated = overlay.eliminate_by_longest(hosts, small, "id")
    assert areas(out) == {1: 50, 2: 171 + 8 + 1} and [r.id for r in isolated.collect()] == [5]
    out, _ = overlay.eliminate_by_smallest(hosts, small.where("id = 3"), "id")
    assert areas(out) == {1: 58, 2: 171}


def test_gaps_and_interiors(spark):
    ring = [(1, 0, 0, 3, 1), (2, 0, 2, 3, 3), (3, 0, 1, 1, 2), (4, 2, 1, 3, 2)]
    df = boxes(spark, ring)
    assert [round(r[0], 6) for r in overlay.get_gaps(df, "id").select(g.area("geometry")).collect()] == [1.0]
    donut = spark.range(1).select(F.lit(9).cast("long").alias("id"), k.from_wkt(F.lit("POLYGON ((50 50, 60 50, 60 60, 50 60, 50 50), (52 52, 53 52, 53 53, 52 53, 52 52))")).alias("geometry"))
    both = df.unionByName(donut)
    assert overlay.get_gaps(both, "id").count() == 1 and overlay.get_gaps(both, "id", include_interiors=True).count() == 2


def test_slivers_simplify_and_duplicates(spark):
    df = boxes(spark, [(1, 0, 0, 10, 10), (2, 20, 0, 20.5, 10), (3, 0, 0, 10, 10)])
    thick, thin = overlay.split_out_slivers(df, 1.0)
    assert sorted(r.id for r in thick.collect()) == [1, 3] and [r.id for r in thin.collect()] == [2]
    assert sorted(r.id for r in overlay.drop_duplicate_geometries(df, "id").collect()) == [1, 2]
    rough = spark.range(1).select(F.col("id"), k.from_wkt(F.lit("POLYGON ((0 0, 5 0.01, 10 0, 10 10, 0 10, 0 0))")).alias("geometry"))
    assert len(overlay.safe_simplify(rough, 0.5).first().geometry.parts[0][0]) == 5
    assert overlay.clean_geoms(df.unionByName(spark.range(1).select("id", F.lit(None).cast(g.GEOMETRY).alias("geometry")))).count() == 3


def test_polygons_split_by_lines(spark):
    df = boxes(spark, [(1, 0, 0, 4, 4), (2, 10, 10, 12, 12)])
    cut = spark.createDataFrame([("LINESTRING (-1 1, 5 1)",), ("LINESTRING (2 -1, 2 5)",)], "t string").select(k.from_wkt(F.col("t")).alias("geometry"))
    out = overlay.split_polygons_by_lines(df, cut, "id").select("id", g.area("geometry").alias("a")).collect()
    assert sorted((r.id, round(r.a, 6)) for r in out) == [(1, 2.0), (1, 2.0), (1, 6.0), (1, 6.0), (2, 4.0)]


# lines -------------------------------------------------------------------


def lines_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", k.from_wkt(F.col("t")).alias("geometry"))


def test_lines(spark):
    df = lines_of(spark, ["LINESTRING (0 0, 10 0)", "LINESTRING (5 -5, 5 5)", "LINESTRING (0 0, 1 0, 1 1, 0 0)"])
    assert [(r.id, r.n) for r in lines.cut_lines(df, 4.0).groupBy("id").agg(F.count("*").alias("n")).orderBy("id").collect()] == [(0, 3), (1, 3), (2, 1)]
    open_, closed = lines.split_out_circles(df)
    assert open_.count() == 2 and closed.count() == 1
    assert lines.get_line_segments(df).count() == 5 and lines.get_line_segments(df.where("id = 0"), cycle=True).count() == 2
    pieces = lines.to_lines(df.where("id < 2"), "id")
    assert sorted(round(r[0], 6) for r in pieces.select(g.length("geometry")).collect()) == [5, 5, 5, 5]
    points = spark.createDataFrame([(3.0, 0.5), (100.0, 100.0)], "x double, y double")
    split = lines.split_lines_by_nearest_point(df.where("id < 2"), points, "id", 1.0).collect()
    assert sorted((r.id, r.splitted) for r in split) == [(0, 1), (0, 1), (1, 0)]
    assert lines.make_edge_wkt_cols(df).first().target_wkt == "POINT (10 0)"
    moved = lines.change_line_endpoint(df, spark.createDataFrame([(0, -1.0, -1.0)], "id long, x double, y double"), "id")
    assert moved.where("id = 0").select(g.to_wkt("geometry")).first()[0] == "LINESTRING (-1 -1, 10 0)"
    assert lines.cut_lines_once(df.where("id = 0"), 40.0).count() == 1


# network -----------------------------------------------------------------


def test_directed_line(spark):
    e = spark.createDataFrame([(0, 0, 1, "B", 1.0, 1.0), (1, 1, 2, "FT", 1.0, -1.0), (2, 2, 3, "TF", -1.0, 1.0)], "edge_id long, source long, target long, oneway string, drivetime_fw double, drivetime_bw double")
    d = network.make_directed_network_norway(e, dropnegative=True)
    assert d.count() == 4
    every = spark.range(4)
    got = {(r.origin, r.destination): r.cost for r in network.od_cost_matrix(d, every.toDF("origin"), every.toDF("destination"), "minutes").collect()}
    assert (got[0, 1], got[1, 0], got[0, 2], got[3, 2], got[0, 0]) == (1, 1, 2, 1, 0)
    assert got[0, 3] is None and got[3, 0] is None and got[3, 1] is None
    with pytest.raises(ValueError):
        network.make_directed_network_norway(e.withColumn("drivetime_fw", F.lit(None).cast("double")))
    with pytest.raises(ValueError):
        network.costs(e.withColumnRenamed("drivetime_fw", "minutes"), every.toDF("origin"), "minutes").collect()


def random_graph(spark, nodes=30, n=80, seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(nodes), rng.randrange(nodes), float(rng.randint(1, 20))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "edge_id long, source long, target long, weight double")


@pytest.mark.parametrize("directed", [True, False])
def test_spreading_costs_equal_the_kernel(spark, directed):
    _, e = random_graph(spark)
    o = spark.range(3).toDF("origin")
    for cutoff in (None, 15.0):
        a = sorted(map(tuple, network.costs(e, o, directed=directed, cutoff=cutoff).select("origin", "node", "cost").collect()))
        b = sorted(map(tuple, network.spread(e, o, directed=directed, cutoff=cutoff).select("origin", "node", "cost").collect()))
        assert a == b


def test_routes_cost_what_the_matrix_says(spark):
    rows, e = random_graph(spark)
    pairs = spark.range(4).toDF("origin").crossJoin(spark.range(30).toDF("destination"))
    w = {r[0]: r for r in rows}
    cost = {(r.origin, r.destination): r.cost for r in network.od_cost_matrix(e, pairs, pairs).collect()}
    ways = {}
    for r in sorted(network.get_route(e, pairs).collect(), key=lambda r: (r.origin, r.destination, r.seq)):
        ways.setdefault((r.origin, r.destination), []).append(r.edge_id)
    assert set(ways) == {p for p, c in cost.items() if c}
    for (o, d), way in ways.items():
        assert w[way[0]][1] == o and w[way[-1]][2] == d and all(w[a][2] == w[b][1] for a, b in zip(way, way[1:]))
        assert sum(w[x][3] for x in way) == cost[o, d]
    use = {r.edge_id: r.frequency for r in network.get_route_frequencies(e, pairs).collect()}
    assert sum(use.values()) == sum(map(len, ways.values()))
    several = network.get_k_routes(e, pairs, 3, 50).groupBy("origin", "destination").agg(F.max("k").alias("k")).collect()
    assert {r.k for r in several} <= {1, 2, 3} and len(several) == len(ways)
    weights = pairs.withColumn("weight", F.lit(2.0)).where("origin = 0")
    assert sum(r.frequency for r in network.get_route_frequencies(e, pairs, weight_df=weights, default_weight=0).collect()) == 2 * sum(len(x) for (o, _), x in ways.items() if o == 0)
    with pytest.raises(ValueError):
        network.get_route_frequencies(e, pairs, weight_df=weights, strict=True)


def test_rank_ties_and_cutoffs(spark):
    od = spark.createDataFrame([(0, 1, 5.0), (0, 2, 5.0), (0, 3, 9.0), (0, 4, None)], "origin int, destination int, cost double")
    assert network.limited(od, destination_count=1).count() == 0
    assert network.limited(od, destination_count=2).count() == 2
    assert network.limited(od, cutoff=5).count() == 2


def test_service_areas(spark):
    e = spark.createDataFrame([(0, 0, 1, 4.0), (1, 1, 2, 4.0)], "edge_id long, source long, target long, weight double")
    o = spark.createDataFrame([(0,), (9,)], "origin long")
    got = sorted(((r.origin, r["break"], r.edge_id) for r in network.service_area(e, o, [3, 5, 9]).collect()), key=str)
    assert got == [(0, 3.0, None), (0, 5.0, 0), (0, 9.0, 0), (0, 9.0, 1), (9, 3.0, None), (9, 5.0, None), (9, 9.0, None)]
    exact = {(r["break"], r.edge_id): r.share for r in network.precise_service_area(e, o.where("origin = 0"), [3, 5]).collect()}
    assert exact == {(3.0, 0): 0.75, (5.0, 0): 1.0, (5.0, 1): 0.25}


def test_components_and_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 20), (12, 11), (13, 12), (14, 13)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 20: 20}
    flagged = network.get_connected_components(e.toDF("source", "target")).collect()
    assert {(r.source, r.connected) for r in flagged} == {(1, 0), (2, 0), (20, 0), (10, 1), (12, 1), (13, 1), (14, 1)}
    rows, nodes = network.make_node_ids(spark.createDataFrame([(0, 0, 1, 0, 1), (1, 0, 2, 0, 1), (0, 0, 1, 0, 1)], "ax int, ay int, bx int, by int, length int"))
    assert sorted((r.node_id, r.x, r.n) for r in nodes.collect()) == [("0", 0, 1), ("1", 1, 2), ("2", 2, 1)]
    assert sorted((r.source, r.target) for r in rows.collect()) == [("0", "1"), ("0", "1"), ("1", "2")]
    assert network.percent_bidirectional(spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 4, 1)], "source int, target int, length int")) == 50


def test_rules_and_connectors(spark):
    with pytest.raises(ValueError):
        network.NetworkAnalysisRules(True, "min", nodedist_multiplier=1, nodedist_kmh=5)
    assert network.NetworkAnalysisRules(True, "min").weight == "minutes"
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    nodes = spark.createDataFrame([("a", 100.0, 0.0), ("b", 119.0, 0.0), ("c", 121.0, 0.0)], "node_id string, x double, y double")
    got = network.connect_points(p, nodes, network.NetworkAnalysisRules(True, "minutes", 250, 10, nodedist_kmh=6), "id").collect()
    assert sorted((r.node_id, r.weight) for r in got) == [("a", 1.0), ("b", pytest.approx(1.19))]


def test_holes(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0, 1), ("b", 10.0, 0.0, 1), ("c", 100.0, 0.0, 1), ("d", 5.0, 1.0, 3)], "node_id string, x double, y double, n long")
    got = sorted((r.source, r.target) for r in network.close_network_holes_to_deadends(nodes, 20).collect())
    assert got == [("a", "b"), ("b", "a")]
    ends = spark.createDataFrame([("a", 0.0, 0.0, -5.0, 0.0), ("b", 10.0, 0.0, 15.0, 0.0)], "source string, x double, y double, px double, py double")
    got = sorted((r.source, r.target) for r in network.close_network_holes(nodes, ends, 20, 5).collect())
    assert got == [("a", "b"), ("b", "a")]
    assert sorted((r.source, r.target) for r in network.close_network_holes(nodes, ends, 20, 30).collect()) == [("a", "d"), ("b", "d")]


# grids, sorts, classes ---------------------------------------------------


def test_grids(spark):
    assert grid.make_grid_from_bbox(spark, 0, 0, 1, 1, 0.1).count() == 121
    df = boxes(spark, [(1, 0.5, 0.5, 3.5, 2.5)])
    assert grid.make_grid(df, 1.0).count() == 5 * 4
    clipped = grid.make_grid(df, 1.0, clip_to_bounds=True)
    assert clipped.agg(F.sum(g.area("geometry"))).first()[0] == pytest.approx(6)
    p = spark.createDataFrame([(261106.0, 6649101.0)], "x double, y double")
    assert grid.add_grid_id(p, 1000).first().grid_id == "22610006649000"
    assert grid.make_official_grid(p, 1000).count() == 1
    inside = grid.random_points_in_polygons(df, "id", 7, seed=1)
    assert inside.count() == 7 and inside.where("x between 0.5 and 3.5 and y between 0.5 and 2.5").count() == 7
    assert grid.points_in_bounds(df, 1.0).count() == 3 * 2
    assert grid.random_points(spark, 50, 2.0, 1).where("x between 0 and 4 and y between 0 and 4").count() == 50


def test_orders(spark):
    df = boxes(spark, [(1, 0, 0, 1, 1), (2, 0, 0, 2, 2), (3, 0, 0, 2, 2)])
    assert [r.id for r in sorts.sort_large_first(df, "id").collect()] == [3, 2, 1]
    assert [r.id for r in sorts.sort_small_first(df, "id").collect()] == [1, 2, 3]
    nulls = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 1, 1)], "id int, a int, b int")
    assert [r.id for r in sorts.sort_nans_last(nulls, "id").collect()] == [3, 2, 1]


def test_classes(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "v double")
    assert classify.create_bins(df, "v", 4) == [25.75, 50.5, 75.25, 100.0]
    assert classify.create_bins(df.where("v < 4"), "v", 5) == [1, 2, 3]
    assert len(classify.create_bins(df, "v", 3, "jenks")) == 3
    got = df.select(classify.classify_from_bins("v", [25.0, 50.0]).alias("c")).groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {0: 25, 1: 25, 2: 50, None: 1}
    assert classify.get_rounding(df, "v") == 0
    assert df.select(classify.nodata_share("v")).first()[0] == pytest.approx(1 / 101)


# rasters -----------------------------------------------------------------


def pixel_table(spark, values):
    return spark.createDataFrame([("i", "b", r, c, float(v) if v is not None else None) for r, row in enumerate(values) for c, v in enumerate(row)], "image_id string, band_id string, row long, col long, value double")


def test_dilation_and_erosion(spark):
    ones = {(10, 10), (20, 20), (20, 10), (10, 20)}
    p = pixel_table(spark, [[int((r, c) in ones) for c in range(50)] for r in range(50)])
    wide = raster.buffer(p, 10)
    got = {(r.row, r.col) for r in wide.where("value = 1").collect()}
    assert got == {(r, c) for r in range(31) for c in range(31)}
    back = {(r.row, r.col) for r in raster.buffer(wide, -10).where("value = 1").collect()}
    assert back == {(r, c) for r in range(10, 21) for c in range(10, 21)}


def test_gradient_of_a_pyramid(spark):
    v = [[100] * 5, [100, 110, 110, 110, 100], [100, 110, 120, 110, 100], [100, 110, 110, 110, 100], [100] * 5]
    p = pixel_table(spark, v)
    assert raster.gradient(p, 10.0).agg(F.max("value")).first()[0] == 1
    assert raster.gradient(p, 10.0, degrees=True).agg(F.max("value")).first()[0] == 45


def test_mosaics_and_masks(spark):
    a, b = pixel_table(spark, [[1, None], [3, 4]]), pixel_table(spark, [[5, 6], [None, 9]]).withColumn("image_id", F.lit("j"))
    both = a.unionByName(b)
    value = lambda m, **o: {(r.row, r.col): r.value for r in raster.merge(both, m, **o).collect()}
    assert value("mean", as_int=False) == {(0, 0): 3, (0, 1): 3, (1, 0): 1.5, (1, 1): 6.5}
    assert value("mean")[1, 1] == 6 and value("pixel_mean")[0, 1] == 6
    assert value("first") == {(0, 0): 1, (0, 1): 6, (1, 0): 3, (1, 1): 4} and value("last")[0, 0] == 5
    mask = pixel_table(spark, [[3, 4], [4, 4]]).withColumn("band_id", F.lit("SCL"))
    shown = raster.apply_scl_mask(a.unionByName(mask)).collect()
    assert {(r.row, r.col): r.value for r in shown} == {(0, 0): None, (0, 1): None, (1, 0): 3, (1, 1): 4}
    assert raster.value_counts(both).where("value is null").count() == 0


def test_indices_and_zones(spark):
    red, nir = pixel_table(spark, [[1, 0]]).withColumn("band_id", F.lit("B04")), pixel_table(spark, [[3, 0]]).withColumn("band_id", F.lit("B08"))
    assert {r.col: r.value for r in raster.ndvi(red.unionByName(nir)).collect()} == {0: 0.5, 1: 0.0}
    p = pixel_table(spark, [[1, 2], [3, None]])
    zones = boxes(spark, [(1, 0, -2, 2, 0), (2, 50, 50, 51, 51)])
    out = raster.zonal(p, zones, "id", {"n": F.count("*"), "s": F.sum("value")}).collect()
    assert [(r.id, r.n, r.s) for r in out] == [(1, 3, 6)]
    assert raster.zonal(p, zones, "id", {"n": F.count("*")}, dropna=False).count() == 2
    burned = raster.from_geopandas(boxes(spark, [(1, 0, -1, 1, 0), (2, 0, -2, 2, 0)]), "id", "id", 1.0, (0.0, 0.0), (2, 3))
    assert {(r.row, r.col): r.value for r in burned.collect()} == {(0, 0): 2, (0, 1): 2, (0, 2): 0, (1, 0): 2, (1, 1): 2, (1, 2): 0}


def test_regions_and_polygons(spark):
    p = pixel_table(spark, [[1, 1, 2], [2, 1, 2], [2, 2, 1]])
    out = raster.to_geopandas(p).select("value", g.area("geometry").alias("a")).collect()
    assert sorted((r.value, round(r.a, 6)) for r in out) == [(1, 1), (1, 3), (2, 2), (2, 3)]


def test_image_tables(spark):
    images = spark.createDataFrame([("a", "20200101", ["B02", "B03"], 10.0), ("b", "20200301", ["B02"], 10.0), ("c", None, ["B02", "B03"], 10.0), ("d", "20210101", ["B02", "B03"], 90.0)], "image_id string, date string, bands array<string>, cloud_cover double")
    ids = lambda df: sorted(r.image_id for r in df.collect())
    assert ids(raster.filter_images(images, bands=["B02", "B03"])) == ["a", "c", "d"]
    assert ids(raster.filter_images(images, date_ranges=[(None, "20200301")])) == ["a", "b"]
    assert ids(raster.filter_images(images, date_ranges=[("20200102", "20200401"), ("20210101", None)], max_cloud_cover=50)) == ["b"]
    assert len(ids(raster.sample_images(images, 2))) == 2
    with pytest.raises(ValueError):
        raster.sample_images(images, 9)
    xml = spark.createDataFrame([("<Cloud_Coverage_Assessment>25.7</Cloud_Coverage_Assessment><BOA_QUANTIFICATION_VALUE unit='none'>10000</BOA_QUANTIFICATION_VALUE>",)], "x string")
    assert tuple(xml.select(raster.cloud_cover(F.col("x")), raster.boa_quantification(F.col("x"))).first()) == (25.7, 10000)


# sources -----------------------------------------------------------------


def test_write_and_read(spark, tmp_path):
    df = boxes(spark, [(1, 0, 0, 1, 1), (2, 50, 50, 60, 60), (3, 0, 0, 2, 2)]).withColumn("k", F.when(F.col("id") < 3, "a"))
    path = str(tmp_path / "t")
    vector.write_geopandas(df, path)
    assert vector.read_geopandas(spark, path).columns == df.columns
    read = vector.read_geopandas(spark, path, mask=(40, 40, 55, 55))
    assert [r.id for r in read.collect()] == [2]
    assert "PushedFilters: [IsNotNull(__xmin)" in read._jdf.queryExecution().toString()
    assert [r.id for r in vector.read_geopandas(spark, path, filters="id = 3").collect()] == [3]
    with pytest.raises(Exception):
        vector.write_geopandas(df, path, overwrite=False)
    parts = str(tmp_path / "p")
    vector.write_geopandas(df, parts, partition_cols=["k"])
    vector.write_geopandas(df.where("id = 3"), parts, partition_cols=["k"], existing_data_behavior="delete_matching")
    assert sorted(r.id for r in vector.read_geopandas(spark, parts).collect()) == [1, 2, 3]
    vector.write_geopandas(df.where("id = 1"), parts, partition_cols=["k"], existing_data_behavior="append")
    assert vector.read_geopandas(spark, parts, filters="k = 'a'").count() == 3
    bounds = vector.get_bounds_series(spark, [path]).agg(F.min("xmin"), F.max("xmax")).first()
    assert tuple(bounds) == (0, 60)
    assert vector.check_files(spark, path, contains=".parquet", within_minutes=60).count() >= 1
    vector.write_geojson(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("geometry.type = 'Polygon'").count() == 3
    vector.write_municipality_data(df.withColumn("region", F.col("id")), str(tmp_path / "m"), "region", spark.createDataFrame([(1, 2)], "region long, neighbor long"))
    assert spark.read.parquet(str(tmp_path / "m")).where("region = 1").count() == 2


def test_constructors(spark):
    df = spark.createDataFrame([(1.0, 2.0, "POINT (3 4)")], "x double, y double, t string")
    assert constructors.to_gdf(df, x="x", y="y").select(g.to_wkt("geometry")).first()[0] == "POINT (1 2)"
    assert constructors.get_geom_type(constructors.to_gdf(df, wkt="t")) == "point"
    with pytest.raises(ValueError):
        constructors.to_gdf(df, x="x", y="y", wkt="t")
    both = boxes(spark, [(1, 0, 0, 1, 1), (2, 1, 0, 2, 1)])
    assert constructors.to_shapely(both).select(g.area("geometry")).first()[0] == pytest.approx(2)
    assert tuple(constructors.to_bbox(both).first()) == (0, 0, 2, 1)
    assert constructors.coordinate_array(both).count() == 10


def test_natural_breaks_of_many_skewed_values(spark):
    import itertools

    low, high = F.col("id") / 150, 900 + (F.col("id") - 15_000) / 150
    df = spark.range(30_000).select(F.when(F.col("id") < 15_000, low).otherwise(high).alias("v")).unionByName(spark.createDataFrame([(1e9,)], "v double"))
    assert classify.create_bins(df, "v", 3, "jenks") == [14_999 / 150, 900 + 14_999 / 150, 1e9]
    rng = random.Random(3)
    for _ in range(20):
        v = sorted(rng.sample(range(1000), 11))
        n = [rng.randint(1, 9) for _ in v]

        def loss(a, b):
            mean = sum(x * y for x, y in zip(v[a:b], n[a:b])) / sum(n[a:b])
            return sum(y * (x - mean) ** 2 for x, y in zip(v[a:b], n[a:b]))

        cuts = min(itertools.combinations(range(1, 11), 3), key=lambda c: sum(loss(a, b) for a, b in zip((0, *c), (*c, 11))))
        assert k.jenks(v, n, 4) == [v[c - 1] for c in cuts] + [v[-1]]
