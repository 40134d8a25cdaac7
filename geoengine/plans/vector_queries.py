"""Queries over the vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.functions import projection
from geoengine.operators import grid, joins, lines, overlay, sorts
from geoengine.plans import fixtures as fx
from geoengine.plans.catalogue import query

C, S, B, B2 = fx.CUSTOMERS, fx.SUPPLIERS, fx.boxes_sql(), fx.boxes_sql(37)
OVERLAP = "greatest(a.x0, b.x0) < least(a.x1, b.x1) and greatest(a.y0, b.y0) < least(a.y1, b.y1)"


def other_boxes(spark, sf):
    return fx.boxes(spark, sf, 37).select(*[F.col(c).alias("o_" + c) for c in ("pid", "brand", "x0", "y0", "x1", "y1")], "geometry")


def overlaps(spark, sf):
    """Pairs of boxes of the two tables with a common area, and that area."""
    a, b = fx.boxes(spark, sf).drop("geometry"), other_boxes(spark, sf).drop("geometry")
    w = F.least("x1", "o_x1") - F.greatest("x0", "o_x0")
    h = F.least("y1", "o_y1") - F.greatest("y0", "o_y0")
    pairs = joins.box_pairs(a, b, ("x0", "y0", "x1", "y1"), ("o_x0", "o_y0", "o_x1", "o_y1"), 128.0)
    return pairs.withColumn("area", w * h).where((w > 0) & (h > 0))


@query("within_distance_agg", f"""select sid, count(*) as n, round(min(sqrt(d2)), 6) as nearest, round(avg(sqrt(d2)), 6) as mean_distance
from (select sid, cast((x - rx) * (x - rx) + (y - ry) * (y - ry) as double) as d2 from {C} c, {S} s)
where d2 <= 250000 group by sid""")
def within_distance_agg(spark, sf):
    found = joins.within_distance_stats(fx.customers(spark, sf), fx.suppliers(spark, sf), 500)
    return found.select("sid", "n", F.round("nearest", 6).alias("nearest"), F.round("mean_distance", 6).alias("mean_distance"))


def hits(spark, sf):
    """x, y, pid: the places of customers in boxes."""
    places = fx.customers(spark, sf).select("x", "y").distinct().withColumn("x2", F.col("x")).withColumn("y2", F.col("y"))
    return joins.box_pairs(places, fx.boxes(spark, sf).select("pid", "x0", "y0", "x1", "y1"), ("x", "y", "x2", "y2"), ("x0", "y0", "x1", "y1"), 128.0).select("x", "y", "pid")


IN_BOX = f"exists (select 1 from {B} b where x between x0 and x1 and y between y0 and y1)"


@query("semi_points_in_boxes", f"select id, x, y from {C} c where {IN_BOX}")
def semi_points_in_boxes(spark, sf):
    return joins.sfilter(fx.customers(spark, sf), hits(spark, sf), ["x", "y"]).select("id", "x", "y")


@query("anti_points_in_boxes", f"select id, x, y from {C} c where not {IN_BOX}")
def anti_points_in_boxes(spark, sf):
    return joins.sfilter_inverse(fx.customers(spark, sf), hits(spark, sf), ["x", "y"]).select("id", "x", "y")


@query("split_points_by_boxes", f"select {IN_BOX} as inside, count(*) as n, cast(sum(x) as bigint) as sum_x from {C} c group by 1")
def split_points_by_boxes(spark, sf):
    inside, outside = joins.sfilter_split(fx.customers(spark, sf), hits(spark, sf), ["x", "y"])
    both = inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))
    return both.groupBy("inside").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


@query("sjoin_points_in_boxes", f"select id, pid from {C} c join {B} b on x between x0 and x1 and y between y0 and y1")
def sjoin_points_in_boxes(spark, sf):
    return fx.customers(spark, sf).select("id", "x", "y").join(hits(spark, sf).hint("merge"), ["x", "y"]).select("id", "pid")


@query("knn_3", f"""select id, sid, cast(rank as integer) as rank, round(sqrt(d2), 6) as distance from (
select id, sid, d2, row_number() over (partition by id order by d2, sid) as rank
from (select id, sid, cast((x - rx) * (x - rx) + (y - ry) * (y - ry) as double) as d2 from {C} c, {S} s)) where rank <= 3""")
def knn_3(spark, sf):
    found = joins.k_nearest(fx.customers(spark, sf), fx.suppliers(spark, sf), 3, "id", "sid")
    return found.select("id", "sid", "rank", F.round("distance", 6).alias("distance"))


@query("all_distances_agg", f"select sid, count(*) as n, round(max(sqrt(d2)), 6) as farthest from (select a.sid, cast((a.rx - b.rx) * (a.rx - b.rx) + (a.ry - b.ry) * (a.ry - b.ry) as double) as d2 from {S} a, {S} b) group by sid")
def all_distances_agg(spark, sf):
    a = fx.suppliers(spark, sf).toDF("sid", "x", "y")
    b = fx.suppliers(spark, sf).select("rx", "ry")
    return joins.get_all_distances(a, b).groupBy("sid").agg(F.count("*").alias("n"), F.round(F.max("distance"), 6).alias("farthest"))


@query("neighbor_indices", f"select a.id, b.id as neighbor_id from {C} a join {C} b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600")
def neighbor_indices(spark, sf):
    c = fx.customers(spark, sf)
    other = c.select(F.col("id").alias("neighbor_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return joins.get_neighbor_indices(c.select("id", "x", "y"), other, 60)


SEGS = f"(select oid, 0 as seg, ax, ay, bx, by_ from {fx.ORDER_LINES} union all select oid, 1, bx, by_, cx, cy from {fx.ORDER_LINES})"


@query("nearest_snap", f"""with t as (select id, x, y, ax, ay, bx, by_, cast((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as double) as size from {C} c, {fx.SHORT_SEGMENTS} s where x between least(ax, bx) - 60 and greatest(ax, bx) + 60 and y between least(ay, by_) - 60 and greatest(ay, by_) + 60),
u as (select *, case when size = 0 then 0.0 else least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / size)) end as f from t),
d as (select id, sqrt(pow(x - (ax + f * (bx - ax)), 2) + pow(y - (ay + f * (by_ - ay)), 2)) as d from u)
select c.id, case when m.d > 0 then round(m.d, 4) end as snap_distance from {C} c left join (select id, min(d) as d from d where d <= 60 group by id) m on m.id = c.id""")
def nearest_snap(spark, sf):
    snapped = joins.snap(fx.customers(spark, sf).select("id", "x", "y"), fx.short_segments(spark, sf), "id", 60.0, 128.0)
    return snapped.select("id", F.round("snap_distance", 4).alias("snap_distance"))


@query("grid_id_counts", f"select concat(cast(cast(floor((x + 2000000) / 1000.0) * 1000 as bigint) as varchar), cast(cast(floor(y / 1000.0) * 1000 as bigint) as varchar)) as grid_id, count(*) as n from {C} c group by 1")
def grid_id_counts(spark, sf):
    return grid.add_grid_id(fx.customers(spark, sf), 1000).groupBy("grid_id").agg(F.count("*").alias("n"))


@query("official_grid", f"""with b as (select cast(floor(min(x) / 1000.0) as bigint) as a, cast(floor(max(x) / 1000.0) as bigint) as c, cast(floor(min(y) / 1000.0) as bigint) as d, cast(floor(max(y) / 1000.0) as bigint) as e from {C} t)
select concat(cast(2000000 + 1000 * i as varchar), cast(1000 * j as varchar)) as grid_id, 1000000.0 as area
from (select unnest(generate_series(a, c)) as i from b), (select unnest(generate_series(d, e)) as j from b)""")
def official_grid(spark, sf):
    return grid.make_official_grid(fx.customers(spark, sf), 1000).select("grid_id", F.round(g.area("geometry"), 3).alias("area"))


@query("make_grid", f"""with b as (select min(x0) as a, max(x1) as c, min(y0) as d, max(y1) as e from {B} t)
select cast(a + 500 * i as double) as x0, cast(d + 500 * j as double) as y0 from b,
(select unnest(generate_series(0, 30)) as i), (select unnest(generate_series(0, 30)) as j) where a + 500 * i < c + 500 and d + 500 * j < e + 500""")
def make_grid(spark, sf):
    return grid.make_grid(fx.boxes(spark, sf), 500.0).select("x0", "y0")


@query("gridloop_counts", f"select cx, cy, count(*) as n from (select cast(floor(x / 2000.0) as bigint) as cx, cast(floor(y / 2000.0) as bigint) as cy from {C} c) group by 1, 2")
def gridloop_counts(spark, sf):
    count = lambda pdf: pdf[["cx", "cy"]].head(1).assign(n=len(pdf))
    return grid.gridloop(fx.customers(spark, sf).select("x", "y"), 2000.0, count, "cx long, cy long, n long")


@query("total_bounds", f"select cast(min(least(ax, bx, cx)) as double) as xmin, cast(min(least(ay, by_, cy)) as double) as ymin, cast(max(greatest(ax, bx, cx)) as double) as xmax, cast(max(greatest(ay, by_, cy)) as double) as ymax from {fx.ORDER_LINES}")
def total_bounds(spark, sf):
    return grid.get_total_bounds(fx.order_lines(spark, sf))


@query("bounds_polygons", f"select oid, cast((greatest(ax, bx, cx) - least(ax, bx, cx)) * (greatest(ay, by_, cy) - least(ay, by_, cy)) as double) as area from {fx.ORDER_LINES}")
def bounds_polygons(spark, sf):
    return fx.order_lines(spark, sf).select("oid", g.area(g.bounds_to_polygon("geometry")).alias("area"))


@query("segment_lengths", f"select oid, count(*) as n, round(sum(sqrt(cast((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) as double))), 5) as length from {SEGS} group by oid")
def segment_lengths(spark, sf):
    segs = lines.get_line_segments(fx.order_lines(spark, sf))
    return segs.groupBy("oid").agg(F.count("*").alias("n"), F.round(F.sum(g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))), 5).alias("length"))


LENGTH = "sqrt(cast((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) as double)) + sqrt(cast((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy) as double))"


@query("long_first_top10", f"select oid, round({LENGTH}, 5) as length from {fx.ORDER_LINES} order by {LENGTH} desc, oid desc limit 10")
def long_first_top10(spark, sf):
    return sorts.sort_long_first(fx.order_lines(spark, sf), "oid").limit(10).select("oid", F.round(g.length("geometry"), 5).alias("length"))


@query("large_first_top10", f"select pid, cast((x1 - x0) * (y1 - y0) as double) as area from {B} order by (x1 - x0) * (y1 - y0) desc, pid desc limit 10")
def large_first_top10(spark, sf):
    return sorts.sort_large_first(fx.boxes(spark, sf), "pid").limit(10).select("pid", g.area("geometry").alias("area"))


@query("small_first_top10", f"select pid, cast((x1 - x0) * (y1 - y0) as double) as area from {B} order by (x1 - x0) * (y1 - y0), pid limit 10")
def small_first_top10(spark, sf):
    return sorts.sort_small_first(fx.boxes(spark, sf), "pid").limit(10).select("pid", g.area("geometry").alias("area"))


@query("short_first_top10", f"select oid, round({LENGTH}, 5) as length from {fx.ORDER_LINES} order by {LENGTH}, oid limit 10")
def short_first_top10(spark, sf):
    return sorts.sort_short_first(fx.order_lines(spark, sf), "oid").limit(10).select("oid", F.round(g.length("geometry"), 5).alias("length"))


@query("triangle_areas", f"select pid, cast((x1 - x0) * (y1 - y0) as double) / 2 as area, round(x0 + (x1 - x0) / 3.0, 6) as cx, round(y0 + (y1 - y0) / 3.0, 6) as cy from {B}")
def triangle_areas(spark, sf):
    b = fx.boxes(spark, sf)
    v = lambda x, y: g.vertex(F.col(x), F.col(y))
    t = b.withColumn("geometry", g.polygon(F.array(v("x0", "y0"), v("x1", "y0"), v("x0", "y1"), v("x0", "y0"))))
    c = g.centroid("geometry")
    return t.select("pid", g.area("geometry").alias("area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query("point_in_triangles", f"select pid, count(*) as n from {B} join {C} c on x > x0 and y > y0 and (x - x0) * (y1 - y0) + (y - y0) * (x1 - x0) < (x1 - x0) * (y1 - y0) group by pid")
def point_in_triangles(spark, sf):
    v = lambda x, y: g.vertex(F.col(x), F.col(y))
    t = fx.boxes(spark, sf).select("pid", "x0", "y0", "x1", "y1").withColumn("geometry", g.polygon(F.array(v("x0", "y0"), v("x1", "y0"), v("x0", "y1"), v("x0", "y0"))))
    # points on an edge are left out, as in the SQL
    inside = F.expr("x > x0 and y > y0 and (x - x0) * (y1 - y0) + (y - y0) * (x1 - x0) <> (x1 - x0) * (y1 - y0)") & g.contains_vertex("geometry", v("x", "y"))
    places = fx.customers(spark, sf).groupBy("x", "y").agg(F.count("*").alias("m")).withColumn("x2", F.col("x")).withColumn("y2", F.col("y"))
    return joins.box_pairs(places, t, ("x", "y", "x2", "y2"), ("x0", "y0", "x1", "y1"), 128.0, inside).groupBy("pid").agg(F.sum("m").alias("n"))


@query("grouped_centroids", f"select brand, cast(avg(cx) as bigint) as x, round(avg(cy), 4) as y, sum(n) as n from (select brand, (x0 + x1) / 2.0 as cx, (y0 + y1) / 2.0 as cy, count(*) as n from {B} group by 1, 2, 3) group by brand".replace("cast(avg(cx) as bigint)", "round(avg(cx), 4)").replace("sum(n)", "cast(sum(n) as bigint)"))
def grouped_centroids(spark, sf):
    rows = overlay.get_grouped_centroids(fx.boxes(spark, sf).select("brand", "geometry"), "brand", as_string=False)
    v = g.first_vertex("centroid")
    return rows.groupBy("brand").agg(F.round(F.first(v["x"]), 4).alias("x"), F.round(F.first(v["y"]), 4).alias("y"), F.count("*").alias("n"))


@query("dissolve_attributes", f"select size, case when count(*) = 1 then any_value(pid) else min(pid) end as pid, cast(case when count(*) = 1 then any_value(x0) else max(x0) end as bigint) as x0 from {B} group by size")
def dissolve_attributes(spark, sf):
    """The attribute side of dissolve; the shapes have a query of their own."""
    out = overlay.diss(fx.boxes(spark, sf).select("size", "pid", "x0", "geometry"), "size", {"pid": F.min("pid"), "x0": F.max("x0")})
    return out.select("size", "pid", "x0")


# unit cells by coordinate compression: the area that a set of boxes covers
def covered_sql(rows: str, by: str) -> str:
    return f"""(with r as ({rows}),
xs as (select {by} as k, x, lead(x) over (partition by {by} order by x) as nx from (select {by}, x0 as x from r union select {by}, x1 from r)),
slabs as (select xs.k, xs.x, xs.nx, r.y0, r.y1 from xs join r on r.{by} = xs.k and r.x0 <= xs.x and r.x1 >= xs.nx where nx is not null),
merged as (select k, x, nx, y0, y1, max(y1) over (partition by k, x order by y0, y1 rows between unbounded preceding and 1 preceding) as top from slabs)
select k, sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) as area from merged group by k)"""


@query("dissolve_areas", f"select k as brand, cast(round(area) as bigint) as area from {covered_sql(f'select brand, x0, y0, x1, y1 from {B}', 'brand')}")
def dissolve_areas(spark, sf):
    return overlay.diss(fx.boxes(spark, sf).select("brand", "geometry"), "brand").select("brand", F.round(g.area("geometry")).cast("long").alias("area"))


@query("overlay_intersection", f"select a.pid, b.pid as o_pid, cast((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as bigint) as area from {B} a join {B2} b on {OVERLAP}")
def overlay_intersection(spark, sf):
    out = overlay.clean_overlay(fx.boxes(spark, sf).select("pid", "geometry"), other_boxes(spark, sf).select("o_pid", "geometry"), "intersection", size=128.0)
    return out.groupBy("pid", "o_pid").agg(F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))


CLIPPED = f"select a.pid, greatest(a.x0, b.x0) as x0, greatest(a.y0, b.y0) as y0, least(a.x1, b.x1) as x1, least(a.y1, b.y1) as y1 from {B} a join {B2} b on {OVERLAP}"
CLIPPED_RIGHT = f"select b.pid, greatest(a.x0, b.x0) as x0, greatest(a.y0, b.y0) as y0, least(a.x1, b.x1) as x1, least(a.y1, b.y1) as y1 from {B} a join {B2} b on {OVERLAP}"
LOST = f"(select pid, cast((x1 - x0) * (y1 - y0) - coalesce(area, 0) as bigint) as area from {B} left join {covered_sql(CLIPPED, 'pid')} c on c.k = pid)"
LOST_RIGHT = f"(select pid, cast((x1 - x0) * (y1 - y0) - coalesce(area, 0) as bigint) as area from {B2} left join {covered_sql(CLIPPED_RIGHT, 'pid')} c on c.k = pid)"
BOTH = f"(select cast(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) as bigint) as area from {B} a join {B2} b on {OVERLAP})"


def _how(how: str):
    def run(spark, sf):
        out = overlay.clean_overlay(fx.boxes(spark, sf).select("pid", "geometry"), other_boxes(spark, sf).select("o_pid", "geometry"), how, size=128.0)
        kind = F.when(F.col("pid").isNotNull() & F.col("o_pid").isNotNull(), "both").when(F.col("pid").isNotNull(), "left").otherwise("right")
        return out.groupBy(kind.alias("side")).agg(F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))

    return run


LEFT_SUM, RIGHT_SUM, BOTH_SUM = f"select 'left' as side, cast(sum(area) as bigint) as area from {LOST}", f"select 'right' as side, cast(sum(area) as bigint) as area from {LOST_RIGHT}", f"select 'both' as side, area from {BOTH}"
for _name, _sql in {"identity": f"{LEFT_SUM} union all {BOTH_SUM}", "union": f"{LEFT_SUM} union all {RIGHT_SUM} union all {BOTH_SUM}", "symmetric_difference": f"{LEFT_SUM} union all {RIGHT_SUM}", "update": f"{LEFT_SUM} union all select 'right', cast(sum((x1 - x0) * (y1 - y0)) as bigint) from {B2}"}.items():
    query(f"overlay_{_name}_area", _sql)(_how(_name))


@query("overlay_difference", f"select pid, area from {LOST} where area > 0")
def overlay_difference(spark, sf):
    out = overlay.clean_overlay(fx.boxes(spark, sf).select("pid", "geometry"), other_boxes(spark, sf).select("o_pid", "geometry"), "difference", size=128.0)
    return out.groupBy("pid").agg(F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))


@query("overlay_pairs_agg", f"select a.brand, count(*) as n, cast(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) as bigint) as area from {B} a join {B2} b on {OVERLAP} group by 1")
def overlay_pairs_agg(spark, sf):
    """The box overlay in Column expressions alone."""
    return overlaps(spark, sf).groupBy("brand").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


EARLIER = f"select a.pid, greatest(a.x0, b.x0) as x0, greatest(a.y0, b.y0) as y0, least(a.x1, b.x1) as x1, least(a.y1, b.y1) as y1 from {B} a join {B} b on b.pid < a.pid and {OVERLAP}"


@query("update_geometries_area", f"select pid, area from (select pid, cast((x1 - x0) * (y1 - y0) - coalesce(area, 0) as bigint) as area from {B} left join {covered_sql(EARLIER, 'pid')} c on c.k = pid) where area > 0")
def update_geometries_area(spark, sf):
    out = overlay.update_geometries(fx.boxes(spark, sf).select("pid", "geometry"), "pid", size=128.0)
    return out.groupBy("pid").agg(F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))


@query("self_intersections", f"select a.pid, count(*) as n, cast(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) as bigint) as area from {B} a join {B} b on a.pid <> b.pid and {OVERLAP} group by 1")
def self_intersections(spark, sf):
    out = overlay.get_intersections(fx.boxes(spark, sf).select("pid", "geometry"), "pid", size=128.0)
    return out.groupBy("pid").agg(F.count("*").alias("n"), F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))


MEETS = "a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1"


@query("clusters", f"""with recursive e as (select a.pid as u, b.pid as v from {B} a join {B} b on {MEETS}),
c(n, r) using key (n) as (select pid, pid from {B} union all
  select e.v, min(c.r) from c join e on e.u = c.n left join recurring.c k on k.n = e.v where c.r < k.r group by 1)
select n as pid, r as cluster from c""")
def clusters(spark, sf):
    return overlay.get_polygon_clusters(fx.boxes(spark, sf).select("pid", "geometry"), "pid").select("pid", "cluster")


@query("cut_lines_lengths", f"select oid, cast(greatest(1, ceil(({LENGTH}) / 3000)) as bigint) as n, round(({LENGTH}) / greatest(1, ceil(({LENGTH}) / 3000)), 4) as piece from {fx.ORDER_LINES} where {LENGTH} > 0")
def cut_lines_lengths(spark, sf):
    cut = lines.cut_lines(fx.order_lines(spark, sf), 3000.0).withColumn("size", g.length("geometry")).where("size > 0")
    return cut.groupBy("oid").agg(F.count("*").alias("n"), F.round(F.avg("size"), 4).alias("piece"))


@query("cut_lines_once", f"select oid, case when {LENGTH} > 1000 then 2 else 1 end as n from {fx.ORDER_LINES} where {LENGTH} > 0".replace("then 2 else 1 end", "then cast(2 as bigint) else 1 end"))
def cut_lines_once(spark, sf):
    some = fx.order_lines(spark, sf).where(g.length("geometry") > 0)
    return lines.cut_lines_once(some, 1000.0).groupBy("oid").agg(F.count("*").alias("n"))


@query("line_bearings", f"select oid, seg, round(degrees(atan2(cast(bx - ax as double), cast(by_ - ay as double))), 6) as bearing from {SEGS}")
def line_bearings(spark, sf):
    segs = lines.get_line_segments(fx.order_lines(spark, sf))
    return segs.select("oid", "seg", F.round(g.angle(g.vertex("ax", "ay"), g.vertex("bx", "by")), 6).alias("bearing"))


@query("extended_lines", f"select oid, seg, round(bx + (bx - ax) / s * 10, 4) as ex, round(by_ + (by_ - ay) / s * 10, 4) as ey from (select *, sqrt(cast((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as double)) as s from {SEGS}) where s > 0")
def extended_lines(spark, sf):
    segs = lines.get_line_segments(fx.order_lines(spark, sf))
    e = segs.withColumn("e", g.last_vertex(g.extend_lines(g.vertex("ax", "ay"), g.vertex("bx", "by"), 10.0))).where("e is not null")
    return e.select("oid", "seg", F.round("e.x", 4).alias("ex"), F.round("e.y", 4).alias("ey"))


@query("segment_crossings", f"""with s as (select * from {fx.SHORT_SEGMENTS})
select count(*) as n from s a join s b on a.oid < b.oid and b.ax between a.ax - 120 and a.ax + 120
where sign((a.bx - a.ax) * (b.ay - a.ay) - (a.by_ - a.ay) * (b.ax - a.ax)) * sign((a.bx - a.ax) * (b.by_ - a.ay) - (a.by_ - a.ay) * (b.bx - a.ax)) < 0
and sign((b.bx - b.ax) * (a.ay - b.ay) - (b.by_ - b.ay) * (a.ax - b.ax)) * sign((b.bx - b.ax) * (a.by_ - b.ay) - (b.by_ - b.ay) * (a.bx - b.ax)) < 0""")
def segment_crossings(spark, sf):
    segs = fx.short_segments(spark, sf)
    other = segs.select(F.col("oid").alias("roid"), *[F.col(c).alias("r" + c) for c in ("ax", "ay", "bx", "by")])
    return lines.segment_crossings(segs, other, 128.0).where("oid < roid").agg(F.count("*").alias("n"))


@query("box_buffers", f"select pid, cast(round((x1 - x0) * (y1 - y0) + 2 * 3 * ((x1 - x0) + (y1 - y0)) + 4 * 9) as bigint) as area from {B}")
def box_buffers(spark, sf):
    return overlay.buff(fx.boxes(spark, sf), 3.0, join_style="mitre").select("pid", F.round(g.area("geometry")).cast("long").alias("area"))


@query("point_buffers", f"select id, round(0.5 * 120 * sin(2 * pi() / 120) * 2500, 3) as area from {C}")
def point_buffers(spark, sf):
    return fx.customers(spark, sf).select("id", F.round(g.area(g.point_buffer(g.vertex("x", "y"), 50.0, 30)), 3).alias("area"))


@query("holes_closed", f"select pid, cast((x1 - x0) * (y1 - y0) as double) as closed, cast(1 as bigint) as holes from {B} where x1 - x0 > 4 and y1 - y0 > 4")
def holes_closed(spark, sf):
    v = lambda x, y: g.vertex(x, y)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    outer = F.array(v(x0, y0), v(x1, y0), v(x1, y1), v(x0, y1), v(x0, y0))
    inner = F.array(v(x0 + 1, y0 + 1), v(x0 + 1, y0 + 2), v(x0 + 2, y0 + 2), v(x0 + 2, y0 + 1), v(x0 + 1, y0 + 1))
    donuts = fx.boxes(spark, sf).where("x1 - x0 > 4 and y1 - y0 > 4").withColumn("geometry", g.polygon(outer, inner))
    return donuts.select("pid", g.area(g.close_small_holes("geometry", 2.0)).alias("closed"), F.size(g.get_holes("geometry")).cast("long").alias("holes"))


@query("wkt_round_trip", f"select pid, concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))') as wkt, cast((x1 - x0) * (y1 - y0) as double) as area from {B}")
def wkt_round_trip(spark, sf):
    text = fx.boxes(spark, sf).select("pid", g.to_wkt("geometry").alias("wkt"))
    return text.select("pid", "wkt", g.area(k.from_wkt(F.col("wkt"))).alias("area"))


@query("wkb_round_trip", f"select pid, cast((x1 - x0) * (y1 - y0) as double) as area, cast(93 as bigint) as n_bytes from {B}")
def wkb_round_trip(spark, sf):
    data = fx.boxes(spark, sf).select("pid", k.to_wkb(F.col("geometry")).alias("b"))
    return data.select("pid", g.area(k.from_wkb(F.col("b"))).alias("area"), F.octet_length("b").cast("long").alias("n_bytes"))


# the first-order series of a transverse Mercator projection at longitude 15 give the northing of the central meridian
@query("projection_round_trip", f"select id, true as same, cast(500000 as bigint) as easting, cast(round(0.9996 * (6367449.1458 * radians(57 + y / 1000.0) - 16038.5086 * sin(2 * radians(57 + y / 1000.0)) + 16.8326 * sin(4 * radians(57 + y / 1000.0)) - 0.0220 * sin(6 * radians(57 + y / 1000.0)))) as bigint) as northing from {C}")
def projection_round_trip(spark, sf):
    lon, lat = 5 + F.col("x") / 1000, 57 + F.col("y") / 1000
    p = projection.from_4326(lon, lat)
    back = projection.to_4326(p["x"], p["y"])
    centre = projection.from_4326(F.lit(15.0), lat)
    return fx.customers(spark, sf).select("id", ((F.abs(back["x"] - lon) < 1e-6) & (F.abs(back["y"] - lat) < 1e-6)).alias("same"), F.round(centre["x"]).cast("long").alias("easting"), F.round(centre["y"]).cast("long").alias("northing"))


@query("sort_nans_last", "select o_orderkey from orders")
def sort_nans_last(spark, sf):
    from geoengine.session import table

    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("p"))
    return sorts.sort_nans_last(rows, "o_orderkey").select("o_orderkey")


@query("random_points_in_boxes", f"select pid, cast(5 as bigint) as n, cast(5 as bigint) as inside from {B}")
def random_points_in_boxes(spark, sf):
    """How many points each box gets, and how many of them lie in it."""
    b = fx.boxes(spark, sf)
    points = grid.random_points_in_polygons(b, "pid", 5, seed=3).select("pid", "x", "y")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return points.join(b.select("pid", "x0", "y0", "x1", "y1"), "pid").groupBy("pid").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


def framed(spark, sf):
    """Four boxes around a gap for each part, far from the others: id, pid and geometry."""
    p = fx.boxes(spark, sf).select("pid", (F.col("pid") * 1000).alias("o"), (1 + F.col("size") % 9).alias("w"), (1 + F.col("pid") % 7).alias("h"))
    o, w, h = F.col("o"), F.col("w"), F.col("h")
    corners = [(o, 0, o + 10, 20 + h), (o + 10 + w, 0, o + 20 + w, 20 + h), (o + 10, 0, o + 10 + w, 10), (o + 10, 10 + h, o + 10 + w, 20 + h)]
    whole = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("long")
    sides = F.array(*[F.struct(F.lit(n).alias("n"), *[whole(v).alias(c) for c, v in zip("abcd", corner)]) for n, corner in enumerate(corners)])
    s = p.select("pid", F.explode(sides).alias("s")).select((F.col("pid") * 4 + F.col("s.n")).alias("id"), "pid", "s.*")
    return s.select("id", "pid", g.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))


FRAMES = f"(select pid, 1 + size % 9 as w, 1 + pid % 7 as h from {B})"


@query("gaps_by_cluster", f"select pid, cast(w * h as double) as area from {FRAMES}")
def gaps_by_cluster(spark, sf):
    gaps = overlay.get_gaps(framed(spark, sf).select("id", "geometry"), "id")
    x = g.bounds("geometry")["xmin"]
    return gaps.select(F.floor(x / 1000).cast("long").alias("pid"), F.round(g.area("geometry"), 4).alias("area"))


@query("dissolved_clusters", f"select cast(count(*) as bigint) as n, cast(sum(400 + 20 * w + 20 * h + 0 * w * h) as bigint) as area from {FRAMES}")
def dissolved_clusters(spark, sf):
    out = overlay.dissexp_by_cluster(framed(spark, sf).select("id", "geometry"), "id")
    return out.agg(F.count("*").alias("n"), F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))


def slivers(spark, sf):
    """(hosts, slivers): for each part two hosts with a thin box between them."""
    p = fx.boxes(spark, sf).select("pid", (F.col("pid") * 1000).alias("o"), (1 + F.col("pid") % 6).alias("ha"), (1 + F.col("pid") % 9).alias("hb"), (2 + F.col("pid") % 8).alias("hs"))
    a = p.select((F.col("pid") * 10).alias("id"), g.box(F.col("o"), F.lit(0), F.col("o") + 10, F.col("ha")).alias("geometry"))
    b = p.select((F.col("pid") * 10 + 1).alias("id"), g.box(F.col("o") + 11, F.lit(0), F.col("o") + 30, F.col("hb")).alias("geometry"))
    s = p.select((F.col("pid") * 10 + 2).alias("id"), g.box(F.col("o") + 10, F.lit(0), F.col("o") + 11, F.col("hs")).alias("geometry"))
    return a.unionByName(b), s


HEIGHTS = f"(select pid, 1 + pid % 6 as ha, 1 + pid % 9 as hb, 2 + pid % 8 as hs from {B})"


def eliminated(how: str, to_a: str):
    def run(spark, sf):
        hosts, small = slivers(spark, sf)
        out, isolated = overlay.eliminate(hosts, small, "id", how)
        return out.select("id", F.round(g.area("geometry")).cast("long").alias("area"))

    sql = f"select pid * 10 as id, cast(10 * ha + case when {to_a} then hs else 0 end as bigint) as area from {HEIGHTS} union all select pid * 10 + 1, cast(19 * hb + case when {to_a} then 0 else hs end as bigint) from {HEIGHTS}"
    query(f"eliminate_by_{how}", sql)(run)


eliminated("longest", "least(ha, hs) >= least(hb, hs)")
eliminated("largest", "10 * ha >= 19 * hb")
eliminated("smallest", "10 * ha <= 19 * hb")


@query("split_polygons", f"select pid, cast(2 as bigint) as n, cast((x1 - x0) * (y1 - y0) as bigint) as area from {B}")
def split_polygons(spark, sf):
    """Each box cut by its own diagonal, extended beyond its corners."""
    b = fx.boxes(spark, sf)
    x0, x1 = F.col("x0") + F.col("pid") * 100_000, F.col("x1") + F.col("pid") * 100_000
    boxes = b.select("pid", g.box(x0, F.col("y0"), x1, F.col("y1")).alias("geometry"))
    cuts = b.select(g.line(F.array(g.vertex(x0 - (x1 - x0), F.col("y0") - (F.col("y1") - F.col("y0"))), g.vertex(x1 + (x1 - x0), F.col("y1") + (F.col("y1") - F.col("y0"))))).alias("geometry"))
    out = overlay.split_polygons_by_lines(boxes, cuts, "pid")
    return out.groupBy("pid").agg(F.count("*").alias("n"), F.round(F.sum(g.area("geometry")), 2).cast("long").alias("area"))


@query("cleaned_coverage", f"select pid, cast(400 + 20 * w + 20 * h + case when least(w, h) < 3 then w * h else 0 end as bigint) as area from {FRAMES}")
def cleaned_coverage(spark, sf):
    """Gaps narrower than 3 are filled, others stay."""
    rows = framed(spark, sf)
    out = overlay.coverage_clean(rows, "id", 2.999)
    return out.groupBy("pid").agg(F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))
