"""Queries over the remaining operators: repair, lines, rings, images, sources, chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.operators import classify, grid, images, joins, lines, maps, overlay, parallel, raster, rings
from geoengine.plans import fixtures as fx
from geoengine.plans.catalogue import query
from geoengine.session import shared_folder, table
from geoengine.sources import constructors, vector

B, C, L, P = fx.boxes_sql(), fx.CUSTOMERS, fx.ORDER_LINES, fx.PIXELS
LENGTH = "sqrt(cast((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) as double)) + sqrt(cast((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy) as double))"


def donuts(spark, sf):
    """Boxes with a hole of one by two in their corner."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    v = lambda x, y: g.vertex(x, y)
    outer = F.array(v(x0, y0), v(x1, y0), v(x1, y1), v(x0, y1), v(x0, y0))
    inner = F.array(v(x0 + 1, y0 + 1), v(x0 + 1, y0 + 3), v(x0 + 2, y0 + 3), v(x0 + 2, y0 + 1), v(x0 + 1, y0 + 1))
    return fx.boxes(spark, sf).withColumn("geometry", g.polygon(outer, inner))


AREA = "cast((x1 - x0) * (y1 - y0) as double)"


@query("holes", f"select pid, cast(2 as double) as area from {B}")
def holes(spark, sf):
    return donuts(spark, sf).select("pid", F.explode(g.get_holes("geometry")).alias("h")).select("pid", g.area("h").alias("area"))


@query("all_holes_closed", f"select pid, {AREA} as area from {B}")
def all_holes_closed(spark, sf):
    return donuts(spark, sf).select("pid", g.area(g.close_all_holes("geometry")).alias("area"))


@query("thin_holes_closed", f"select pid, {AREA} as area from {B}")
def thin_holes_closed(spark, sf):
    return overlay.close_thin_holes(donuts(spark, sf), 1.5).select("pid", F.round(g.area("geometry"), 3).alias("area"))


@query("ring_rows", f"select pid, 0 as ring, cast(2 * (x1 - x0 + y1 - y0) as double) as length from {B} union all select pid, 1, 6.0 from {B}")
def ring_rows(spark, sf):
    return rings.get_rings(donuts(spark, sf), "pid").select("pid", "ring", g.length("geometry").alias("length"))


@query("rings_rebuilt", f"select pid, {AREA} - 2 as area from {B}")
def rings_rebuilt(spark, sf):
    return rings.to_gdf(rings.get_rings(donuts(spark, sf), "pid"), "pid").select("pid", g.area("geometry").alias("area"))


@query("rings_scaled", f"select pid, 4 * ({AREA}) - 2 as area from {B}".replace("- 2 as", "- 8 as"))
def rings_scaled(spark, sf):
    doubled = rings.apply_to_rings(donuts(spark, sf).select("pid", "geometry"), "pid", lambda r: F.transform(r, lambda v: g.vertex(v["x"] * 2, v["y"] * 2)))
    return doubled.select("pid", g.area("geometry").alias("area"))


@query("boundary_lines", f"select pid, cast(2 * (x1 - x0 + y1 - y0) + 6 as double) as length, 2 as parts from {B}")
def boundary_lines(spark, sf):
    out = donuts(spark, sf).withColumn("geometry", g.polygons_to_lines("geometry"))
    return out.select("pid", g.length("geometry").alias("length"), F.size(F.col("geometry")["parts"]).alias("parts"))


@query("single_parts", f"select pid, count(*) as n from (select pid from {B} union all select pid from {B}) group by 1")
def single_parts(spark, sf):
    b = fx.boxes(spark, sf)
    other = g.box(F.col("x0") + 1000, F.col("y0"), F.col("x1") + 1000, F.col("y1"))
    multi = b.withColumn("geometry", g.geometry("MultiPolygon", F.concat(F.col("geometry")["parts"], other["parts"])))
    return constructors.make_all_singlepart(multi).groupBy("pid").agg(F.count("*").alias("n"))


@query("geometry_types", f"select 'line' as kind, count(*) as n from {L} union all select 'point', count(*) from {C} union all select 'polygon', count(*) from {B}")
def geometry_types(spark, sf):
    points = fx.customers(spark, sf).select(g.point("x", "y").alias("geometry"))
    every = points.unionByName(fx.boxes(spark, sf).select("geometry")).unionByName(fx.order_lines(spark, sf).select("geometry"))
    return every.groupBy(g.geom_family("geometry").alias("kind")).agg(F.count("*").alias("n"))


@query("single_geometry_type", f"select count(*) as n from {B}")
def single_geometry_type(spark, sf):
    every = fx.boxes(spark, sf).select("geometry").unionByName(fx.order_lines(spark, sf).select("geometry"))
    return constructors.to_single_geom_type(every, "polygon").agg(F.count("*").alias("n"))


@query("rows_by_geometry_type", f"select 'LineString' as kind, count(*) as n, cast(max(oid) as bigint) as last from {L} union all select 'Point', count(*), max(id) from {C} union all select 'Polygon', count(*), max(pid) from {B}")
def rows_by_geometry_type(spark, sf):
    points = fx.customers(spark, sf).select("id", g.point("x", "y").alias("geometry"))
    every = points.unionByName(fx.boxes(spark, sf).select(F.col("pid").alias("id"), "geometry")).unionByName(fx.order_lines(spark, sf).select(F.col("oid").alias("id"), "geometry"))
    parts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.max("id").alias("last")) for kind, df in constructors.split_geom_types(every).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filled_values", "select c_custkey, case when c_custkey % 3 = 2 then c_acctbal else -1 end as filled from customer")
def filled_values(spark, sf):
    k = F.col("c_custkey") % 3
    gaps = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", classify.proper_fillna(gaps, -1.0).alias("filled"))


@query("duplicate_geometries", f"select min(pid) as pid from {B} t group by x0, y0, x1, y1")
def duplicate_geometries(spark, sf):
    b = fx.boxes(spark, sf).select("pid", "geometry")
    twice = b.unionByName(b.withColumn("pid", F.col("pid") + 1_000_000))
    return overlay.drop_duplicate_geometries(twice, "pid").select("pid")


@query("thick_polygons", f"select pid from {B} where x1 - x0 > 30 and y1 - y0 > 30")
def thick_polygons(spark, sf):
    return overlay.split_out_slivers(fx.boxes(spark, sf), 30.0)[0].select("pid")


@query("clean_rows", f"select pid, {AREA} as area from {B} where pid % 3 = 0")
def clean_rows(spark, sf):
    b = fx.boxes(spark, sf)
    some = F.when(F.col("pid") % 3 == 0, F.col("geometry")).when(F.col("pid") % 3 == 1, g.geometry("Polygon", F.array()))
    return overlay.clean_geoms(b.withColumn("geometry", some)).select("pid", F.round(g.area("geometry"), 3).alias("area"))


@query("clipped_to_mask", f"select pid, cast((least(x1, 5000) - x0) * (least(y1, 5000) - y0) as double) as area from {B} where x0 < 5000 and y0 < 5000")
def clipped_to_mask(spark, sf):
    spark_mask = spark.range(1).select(g.box(F.lit(-10), F.lit(-10), F.lit(5000), F.lit(5000)).alias("geometry"))
    out = overlay.clean_clip(fx.boxes(spark, sf).select("pid", "geometry"), spark_mask, 512.0)
    return out.select("pid", F.round(g.area("geometry"), 3).alias("area"))


@query("buffered_and_dissolved", f"select size, cast(sum((x1 - x0 + 10) * (y1 - y0 + 10)) as bigint) as area from {B} t group by 1")
def buffered_and_dissolved(spark, sf):
    """Boxes far from each other, so that a group's area is the sum of its grown boxes."""
    far = F.col("pid") * 10_000
    b = fx.boxes(spark, sf).select("size", g.box(F.col("x0") + far, F.col("y0"), F.col("x1") + far, F.col("y1")).alias("geometry"))
    out = overlay.buffdiss(b, 5.0, by="size", join_style="mitre")
    return out.select("size", F.round(g.area("geometry")).cast("long").alias("area"))


@query("edge_texts", f"select oid, concat('POINT (', ax, ' ', ay, ')') as source_wkt, concat('POINT (', cx, ' ', cy, ')') as target_wkt from {L}")
def edge_texts(spark, sf):
    return lines.make_edge_wkt_cols(fx.order_lines(spark, sf)).select("oid", "source_wkt", "target_wkt")


@query("edge_coordinates", f"select oid, cast(ax as double) as sx, cast(cy as double) as ty from {L}")
def edge_coordinates(spark, sf):
    out = lines.make_edge_coords_cols(fx.order_lines(spark, sf))
    return out.select("oid", F.col("source_coords.x").alias("sx"), F.col("target_coords.y").alias("ty"))


@query("closed_lines", f"select ax = cx and ay = cy as closed, count(*) as n from {L} group by 1")
def closed_lines(spark, sf):
    open_, closed = lines.split_out_circles(fx.order_lines(spark, sf))
    both = open_.withColumn("closed", F.lit(False)).unionByName(closed.withColumn("closed", F.lit(True)))
    return both.groupBy("closed").agg(F.count("*").alias("n"))


@query("moved_line_ends", f"select oid, round(sqrt(cast((bx + 5) * (bx + 5) + (by_ + 5) * (by_ + 5) as double)), 5) as first_part from {L}")
def moved_line_ends(spark, sf):
    some = fx.order_lines(spark, sf)
    mapper = some.select("oid", F.lit(-5.0).alias("x"), F.lit(-5.0).alias("y"))
    moved = lines.change_line_endpoint(some, mapper, "oid")
    s = g.segments("geometry")[0]
    return moved.select("oid", F.round(g.distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]), 5).alias("first_part"))


def cross_lines(spark, sf):
    """A level and an upright line for each part, crossing in the middle, far from the others."""
    o = F.col("pid") * 1000
    p = fx.boxes(spark, sf)
    level = p.select((F.col("pid") * 2).alias("id"), g.line(F.array(g.vertex(o, F.lit(50.0)), g.vertex(o + 100, F.lit(50.0)))).alias("geometry"))
    upright = p.select((F.col("pid") * 2 + 1).alias("id"), g.line(F.array(g.vertex(o + 10 + F.col("size"), F.lit(0.0)), g.vertex(o + 10 + F.col("size"), F.lit(100.0)))).alias("geometry"))
    return level.unionByName(upright)


@query("lines_split_at_crossings", f"select pid * 2 as id, cast(10 + size as double) as length from {B} union all select pid * 2, cast(90 - size as double) from {B} union all select pid * 2 + 1, 50.0 from {B} union all select pid * 2 + 1, 50.0 from {B}")
def lines_split_at_crossings(spark, sf):
    return lines.to_lines(cross_lines(spark, sf), "id").select("id", F.round(g.length("geometry"), 4).alias("length"))


@query("lines_split_at_points", f"select pid * 2 as id, 1 as splitted, cast(10 + size as double) as length from {B} union all select pid * 2, 1, cast(90 - size as double) from {B}")
def lines_split_at_points(spark, sf):
    level = cross_lines(spark, sf).where("id % 2 = 0")
    points = fx.boxes(spark, sf).select((F.col("pid") * 1000 + 10 + F.col("size")).cast("double").alias("x"), F.lit(52.0).alias("y"))
    out = lines.split_lines_by_nearest_point(level, points, "id", 5.0)
    return out.select("id", "splitted", F.round(g.length("geometry"), 4).alias("length"))


@query("lattice_points", f"""with b as (select min(x0) as a, max(x1) as c, min(y0) as d, max(y1) as e from {B} t)
select cast(trunc((c - a) / 700.0) * trunc((e - d) / 700.0) as bigint) as n, cast(a as double) as x_low, cast(c as double) as x_high from b""")
def lattice_points(spark, sf):
    p = grid.points_in_bounds(fx.boxes(spark, sf), 700.0)
    return p.agg(F.count("*").alias("n"), F.min("x").alias("x_low"), F.round(F.max("x"), 6).alias("x_high"))


@query("grid_clipped", f"select cast((max(x1) - min(x0)) * (max(y1) - min(y0)) as bigint) as area from {B} t")
def grid_clipped(spark, sf):
    cells = grid.make_grid(fx.boxes(spark, sf), 900.0, clip_to_bounds=True)
    return cells.agg(F.round(F.sum(g.area("geometry"))).cast("long").alias("area"))


@query("random_points_count", "select cast(1000 as bigint) as n, true as inside")
def random_points_count(spark, sf):
    p = grid.random_points(spark, 1000, 5.0, 1)
    return p.agg(F.count("*").alias("n"), F.bool_and((F.col("x") >= 0) & (F.col("x") < 10) & (F.col("y") >= 0) & (F.col("y") < 10)).alias("inside"))


@query("written_and_masked", f"select pid, brand from {B} where x0 <= 4000 and x1 >= 1000 and y0 <= 6000 and y1 >= 2000 and brand <> 'x'")
def written_and_masked(spark, sf):
    """Partitioned by brand, read back with a mask."""
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    vector.write_geopandas(fx.boxes(spark, sf).select("pid", "brand", "geometry"), path, partition_cols=["brand"])
    return vector.read_geopandas(spark, path, mask=(1000, 2000, 4000, 6000), filters="brand <> 'x'").select("pid", "brand")


@query("bounds_of_files", f"select cast(min(x0) as double) as xmin, cast(min(y0) as double) as ymin, cast(max(x1) as double) as xmax, cast(max(y1) as double) as ymax from {B} t")
def bounds_of_files(spark, sf):
    path = f"{shared_folder(spark)}/bounds-{uuid.uuid4().hex}"
    vector.write_geopandas(fx.boxes(spark, sf).select("pid", "geometry"), path)
    found = vector.get_bounds_series(spark, [path])
    return found.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query("geojson_round_trip", f"select pid, {AREA} as area from {B}")
def geojson_round_trip(spark, sf):
    text = maps.geojson_layers(fx.boxes(spark, sf)).select("pid", F.col("geometry").alias("t"))
    return constructors.to_gdf(text, geojson="t").select("pid", g.area("geometry").alias("area"))


@query("coordinates", f"select cast(sum(x) as double) as x, cast(sum(y) as double) as y, count(*) as n from (select ax as x, ay as y from {L} union all select bx, by_ from {L} union all select cx, cy from {L})")
def coordinates(spark, sf):
    return constructors.coordinate_array(fx.order_lines(spark, sf)).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"))


@query("chunked_function", "select c_custkey, round(c_acctbal * 2, 4) as doubled from customer")
def chunked_function(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("doubled"))
    out = parallel.chunkwise(rows, lambda f: f.assign(doubled=f.doubled * 2), "c_custkey long, doubled double", 500)
    return out.select("c_custkey", F.round("doubled", 4).alias("doubled"))


@query("tiles_in_mask", f"select concat('tile ', pid, ' ', 2000 + size) as name from {B} where x0 <= 5000 and y0 <= 5000 and x1 >= 0 and y1 >= 0 and size between 10 and 14".replace("size between 10 and 14", "2000 + size between 2010 and 2014"))
def tiles_in_mask(spark, sf):
    tiles = fx.boxes(spark, sf).select(F.concat(F.lit("tile "), F.col("pid").cast("string"), F.lit(" "), (2000 + F.col("size")).cast("string")).alias("name"), "geometry")
    mask = spark.range(1).select(g.box(F.lit(0), F.lit(0), F.lit(5000), F.lit(5000)).alias("geometry"))
    return maps.filter_tiles(tiles, mask, years=[2010, 2011, 2012, 2013, 2014]).select("name")


@query("masked_pixels", f"""select "row", col, case when value % 12 not in (2, 3, 8, 9, 10, 11) then value end as value from {P}""")
def masked_pixels(spark, sf):
    p = fx.one_image(spark, sf)
    scl = p.withColumn("band_id", F.lit("SCL")).withColumn("value", F.col("value") % 12)
    return raster.apply_scl_mask(p.unionByName(scl)).select("row", "col", "value")


@query("image_bands", "select strftime(ts, '%Y%m%d') as date, event_type as band_id from events group by 1, 2")
def image_bands(spark, sf):
    from geoengine.plans.raster_queries import images as image_table

    return images.explode_bands(image_table(spark, sf)).select("date", "band_id")


@query("image_days", "select date, cast(date[1:4] as integer) as year, cast(date[5:6] as integer) as month, cast(date[7:8] as integer) as day from (select distinct strftime(ts, '%Y%m%d') as date from events)")
def image_days(spark, sf):
    from geoengine.plans.raster_queries import images as image_table

    return images.date_parts(image_table(spark, sf)).select("date", "year", "month", "day")


@query("images_in_order", "select date from (select distinct strftime(ts, '%Y%m%d') as date from events) order by date limit 5")
def images_in_order(spark, sf):
    from geoengine.plans.raster_queries import images as image_table

    return images.select_images(image_table(spark, sf).withColumn("path", F.col("date")), 0, 5).select("date")


@query("cloud_metadata", "select p_partkey, case when p_partkey % 3 < 2 then cast(p_partkey % 100 as double) + 0.5 end as cover from part")
def cloud_metadata(spark, sf):
    tag = F.when(F.col("p_partkey") % 3 == 0, "CLOUDY_PIXEL_OVER_LAND_PERCENTAGE").when(F.col("p_partkey") % 3 == 1, "Cloud_Coverage_Assessment").otherwise("Other")
    xml = F.concat(F.lit("<a><"), tag, F.lit(">"), (F.col("p_partkey") % 100).cast("string"), F.lit(".5</"), tag, F.lit("></a>"))
    return table(spark, sf, "part").select("p_partkey", raster.cloud_cover(xml).alias("cover"))


@query("categories_as_text", "select p_partkey, cast(p_size as varchar) as label from part")
def categories_as_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", classify.to_categorical("p_size").alias("label"))


@query("nodata_shares", "select n_regionkey, avg(case when n_nationkey % 2 = 0 then 1.0 else 0.0 end) as share from nation group by 1")
def nodata_shares(spark, sf):
    n = table(spark, sf, "nation").withColumn("v", F.when(F.col("n_nationkey") % 2 == 1, F.col("n_nationkey")))
    return n.groupBy("n_regionkey").agg(classify.nodata_share("v").alias("share"))


@query("polygon_predicates", f"select a.pid, b.pid as other from {B} a join {B} b on a.pid <> b.pid and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1")
def polygon_predicates(spark, sf):
    """Boxes that meet, by the kernel's predicate on their shapes."""
    b = fx.boxes(spark, sf).select("pid", "geometry")
    out = overlay.geometry_pairs(b, b.withColumnRenamed("pid", "other"), "pid", "other", "intersects", size=128.0)
    return out.where("pid <> other").select("pid", "other")


@query("polygons_within", f"select a.pid, b.pid as other from {B} a join {B} b on a.x0 + 2 >= b.x0 and a.x1 - 2 <= b.x1 and a.y0 + 2 >= b.y0 and a.y1 - 2 <= b.y1")
def polygons_within(spark, sf):
    """Boxes shrunk by two units, and the boxes that hold them."""
    b = fx.boxes(spark, sf)
    small = b.select("pid", g.box(F.col("x0") + 2, F.col("y0") + 2, F.col("x1") - 2, F.col("y1") - 2).alias("geometry"))
    out = overlay.geometry_pairs(small, b.select(F.col("pid").alias("other"), "geometry"), "pid", "other", "within", size=128.0)
    return out.select("pid", "other")


@query("snapped_everywhere", f"""with t as (select id, x, y, ax, ay, bx, by_, cast((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as double) as size from {C} c, {fx.SHORT_SEGMENTS} s where x between least(ax, bx) - 300 and greatest(ax, bx) + 300 and y between least(ay, by_) - 300 and greatest(ay, by_) + 300),
u as (select *, case when size = 0 then 0.0 else least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / size)) end as f from t),
d as (select id, sqrt(pow(x - (ax + f * (bx - ax)), 2) + pow(y - (ay + f * (by_ - ay)), 2)) as d from u)
select c.id, case when m.d > 0 then round(m.d, 4) end as snap_distance from {C} c left join (select id, min(d) as d from d where d <= 300 group by id) m on m.id = c.id""")
def snapped_everywhere(spark, sf):
    """Snapping with a reach of several segments."""
    out = joins.snap(fx.customers(spark, sf).select("id", "x", "y"), fx.short_segments(spark, sf), "id", 300.0)
    return out.select("id", F.round("snap_distance", 4).alias("snap_distance"))


SIMPLIFIED = "sqrt(cast((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) as double))"


@query("simplified_lines", f"select oid, cast(case when ax = cx and ay = cy then 3 when abs(cast((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax) as double)) / {SIMPLIFIED} > 800 then 3 when (bx - ax) * (cx - ax) + (by_ - ay) * (cy - ay) < 0 or (bx - cx) * (ax - cx) + (by_ - cy) * (ay - cy) < 0 then -1 else 2 end as bigint) as n from {L}")
def simplified_lines(spark, sf):
    """The middle vertex stays where it lies over 800 units from the line between the ends (-1: beside that line, not judged)."""
    s0, s1 = g.segments("geometry")[0], g.segments("geometry")[1]
    ux, uy, vx, vy = s0["b"]["x"] - s0["a"]["x"], s0["b"]["y"] - s0["a"]["y"], s1["b"]["x"] - s0["a"]["x"], s1["b"]["y"] - s0["a"]["y"]
    wx, wy = s0["b"]["x"] - s1["b"]["x"], s0["b"]["y"] - s1["b"]["y"]
    rows = fx.order_lines(spark, sf).withColumn("n", F.size(g.vertices(k.simplify(F.col("geometry"), 800.0))))
    far = F.abs(vx * uy - vy * ux) > 800.0 * F.sqrt(vx * vx + vy * vy)
    beside = (ux * vx + uy * vy < 0) | (wx * -vx + wy * -vy < 0)
    return rows.select("oid", F.when(~far & beside, -1).otherwise(F.col("n")).cast("long").alias("n"))
