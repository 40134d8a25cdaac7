"""Queries over the raster operators and map classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.operators import classify, raster
from geoengine.plans import fixtures as fx
from geoengine.plans.catalogue import query
from geoengine.session import table

P, E = fx.PIXELS, fx.EMBEDDING_PIXELS
AXIS = '(select *, lag(value) over (partition by "col" order by "row") as up, lead(value) over (partition by "col" order by "row") as down, lag(value) over (partition by "row" order by "col") as "left", lead(value) over (partition by "row" order by "col") as "right" from ' + P + ")"


def pairs(spark, sf):
    """Two bands for each pixel: the red one from the value, the near infrared one from the event."""
    e = table(spark, sf, "events")
    base = e.select(F.lit("i").alias("image_id"), F.floor(F.col("event_id") / 100).cast("long").alias("row"), (F.col("event_id") % 100).alias("col"), F.round(F.col("value") * 100).cast("long").alias("red"), (F.col("user_id") % 500).cast("long").alias("nir"))
    return base.select("image_id", "row", "col", F.explode(F.array(F.struct(F.lit("B04").alias("b"), F.col("red").alias("v")), F.struct(F.lit("B08").alias("b"), F.col("nir").alias("v")))).alias("s")).select("image_id", F.col("s.b").alias("band_id"), "row", "col", F.col("s.v").alias("value"))


PAIRS = "(select cast(floor(event_id / 100.0) as bigint) as \"row\", event_id % 100 as col, cast(round(value * 100) as bigint) as red, cast(user_id % 500 as bigint) as nir from events)"


@query("ndvi", f'select "row", col, round(case when red + nir = 0 then 0.0 else (nir - red) / cast(nir + red as double) end, 9) as ndvi from {PAIRS}')
def ndvi(spark, sf):
    return raster.ndvi(pairs(spark, sf)).select("row", "col", F.round("value", 9).alias("ndvi"))


@query("brightness", f'select "row", col, cast(trunc(red * 0.299::double + nir * 0.587::double + red * 0.114::double) as integer) as brightness from {PAIRS}')
def brightness(spark, sf):
    return raster.get_brightness(pairs(spark, sf), "B04", "B04", "B08").select("row", "col", "brightness")


SLOPE = 'abs(coalesce((down - up) / 20.0, (down - value) / 10.0, (value - up) / 10.0, 0)) + abs(coalesce(("right" - "left") / 20.0, ("right" - value) / 10.0, (value - "left") / 10.0, 0))'


@query("slope", f'select "row", col, round({SLOPE}, 6) as slope from {AXIS}')
def slope(spark, sf):
    return raster.gradient(fx.one_image(spark, sf), 10.0).select("row", "col", F.round("value", 6).alias("slope"))


@query("slope_degrees", f'select "row", col, round(degrees(atan({SLOPE})), 5) as slope from {AXIS}')
def slope_degrees(spark, sf):
    return raster.gradient(fx.one_image(spark, sf), 10.0, degrees=True).select("row", "col", F.round("value", 5).alias("slope"))


def binary(spark, sf, share):
    return fx.one_image(spark, sf).withColumn("value", (F.col("value") % 10 < share).cast("long"))


WINDOW = 'from (select *, case when value % 10 < {s} then 1 else 0 end as v from {p}) t'


@query("dilation", f"""with t as (select "row", col, cast(value % 10 < 1 as bigint) as v from {P}), r as (select "row", col, max(v) over (partition by col order by "row" rows between 2 preceding and 2 following) as v from t)
select "row", col, max(v) over (partition by "row" order by col rows between 2 preceding and 2 following) as value from r""")
def dilation(spark, sf):
    return raster.buffer(binary(spark, sf, 1), 2).select("row", "col", "value")


@query("erosion", f"""with t as (select "row", col, cast(value % 10 < 9 as bigint) as v from {P}), r as (select "row", col, case when count(*) over w < 3 then 0 else min(v) over w end as v from t window w as (partition by col order by "row" rows between 1 preceding and 1 following))
select "row", col, case when count(*) over w < 3 then 0 else min(v) over w end as value from r window w as (partition by "row" order by col rows between 1 preceding and 1 following)""")
def erosion(spark, sf):
    return raster.buffer(binary(spark, sf, 9), -1).select("row", "col", "value")


def series(spark, sf):
    return fx.embedding_pixels(spark, sf)


for _method, _sql in {"sum": "cast(sum(value) as bigint)", "min": "min(value)", "max": "max(value)", "count": "count(value)", "first": "arg_min(value, image_id)", "last": "arg_max(value, image_id)", "mean": "cast(floor(sum(value) / 64.0) as bigint)"}.items():
    query(f"mosaic_{_method}", f'select "row", col, {_sql} as value from {E} group by 1, 2')(lambda spark, sf, m=_method: raster.merge(series(spark, sf), m))


@query("mosaic_by_band", f'select band_id, "row" % 10 as "row", col, cast(sum(value) as bigint) as value from {P} group by 1, 2, 3')
def mosaic_by_band(spark, sf):
    p = fx.pixels(spark, sf).withColumn("row", F.col("row") % 10)
    return raster.merge_by_band(p, "sum").select("band_id", "row", "col", "value")


@query("pixelwise_slope", f'select "row", col, round(regr_slope(cast(value as double), cast(image_id as double)), 7) as slope, round(regr_intercept(cast(value as double), cast(image_id as double)), 6) as intercept, count(*) as n from {E} group by 1, 2')
def pixelwise_slope(spark, sf):
    out = raster.plot_pixels(series(spark, sf), "image_id")
    return out.select("row", "col", F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query("pixelwise_range", f'select "row", col, max(value) - min(value) as value from {E} where value >= 0 group by 1, 2')
def pixelwise_range(spark, sf):
    masked = series(spark, sf).withColumn("value", F.when(F.col("value") >= 0, F.col("value")))
    return raster.pixelwise(masked, lambda s: F.array_max(F.transform(s, lambda x: x["value"])) - F.array_min(F.transform(s, lambda x: x["value"])))


@query("value_counts", f"select value % 100 as value, count(*) as count from {P} group by 1")
def value_counts(spark, sf):
    return raster.value_counts(fx.one_image(spark, sf).withColumn("value", F.col("value") % 100))


@query("n_largest", f'select "row", col, value from {P} where value >= (select min(value) from (select value from {P} order by value desc limit 25))')
def n_largest(spark, sf):
    return raster.get_n_largest(fx.one_image(spark, sf), 25).select("row", "col", "value")


@query("n_smallest", f'select "row", col, value from {P} where value <= (select max(value) from (select value from {P} order by value limit 25))')
def n_smallest(spark, sf):
    return raster.get_n_smallest(fx.one_image(spark, sf), 25).select("row", "col", "value")


def zones(spark, sf):
    z = fx.boxes(spark, sf)
    x0, y0 = F.col("x0") % 90, F.col("y0") % 80
    return z.select("pid", g.box(x0, -(y0 + 1 + F.col("size") % 9), x0 + 1 + F.col("pid") % 7, -y0).alias("geometry"))


ZONES = f"(select pid, x0 % 90 as a, y0 % 80 as b, x0 % 90 + 1 + pid % 7 as c, y0 % 80 + 1 + size % 9 as d from {fx.boxes_sql()})"


@query("zonal_boxes", f"""select pid, count(*) as n, cast(sum(value) as bigint) as total, min(value) as low, max(value) as high, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 3) as median
from {ZONES} z join {P} p on col >= a and col < c and "row" >= b and "row" < d group by 1""")
def zonal_boxes(spark, sf):
    v = F.col("value")
    aggs = {"n": F.count("*"), "total": F.sum(v), "low": F.min(v), "high": F.max(v), "mean": F.round(F.avg(v), 6), "median": F.round(F.percentile(v, F.lit(0.5)), 3)}
    return raster.zonal(fx.one_image(spark, sf), zones(spark, sf), "pid", aggs, size=16.0)


@query("clip_raster", f'select "row", col, case when exists (select 1 from {ZONES} z where col >= a and col < c and "row" >= b and "row" < d) then value end as value from {P}')
def clip_raster(spark, sf):
    return raster.clip(fx.one_image(spark, sf), zones(spark, sf), size=16.0).select("row", "col", "value")


@query("rasterize_boxes", f"""select r as "row", q as col, cast(coalesce(max(pid), 0) as bigint) as value from (select unnest(generate_series(0, 99)) as r), (select unnest(generate_series(0, 99)) as q)
left join {ZONES} z on q >= a and q < c and r >= b and r < d group by 1, 2""".replace("from (select unnest(generate_series(0, 99)) as r), (select unnest(generate_series(0, 99)) as q)", "from (select unnest(generate_series(0, 99)) as r) cross join (select unnest(generate_series(0, 99)) as q)"))
def rasterize_boxes(spark, sf):
    out = raster.from_geopandas(zones(spark, sf), "pid", "pid", 1.0, (0.0, 0.0), (100, 100))
    return out.select("row", "col", F.col("value").cast("long").alias("value"))


@query("rasterize_boxes_add", f"""select r as "row", q as col, cast(count(pid) as bigint) as value from (select unnest(generate_series(0, 99)) as r) cross join (select unnest(generate_series(0, 99)) as q)
left join {ZONES} z on q >= a and q < c and r >= b and r < d group by 1, 2""")
def rasterize_boxes_add(spark, sf):
    out = raster.from_geopandas(zones(spark, sf).withColumn("one", F.lit(1)), "one", "pid", 1.0, (0.0, 0.0), (100, 100), merge_alg="add")
    return out.select("row", "col", F.col("value").cast("long").alias("value"))


@query("pixel_regions", f"""with recursive t as (select "row" * 2147483648 + col as id, "row" as y, col as x, value % 3 as v from {P}),
e as (select a.id as u, b.id as w from t a join t b on a.v = b.v and ((a.y = b.y and abs(a.x - b.x) = 1) or (a.x = b.x and abs(a.y - b.y) = 1))),
c(n, r) using key (n) as (select id, id from t union all select e.w, min(c.r) from c join e on e.u = c.n left join recurring.c k on k.n = e.w where c.r < k.r group by 1)
select v as value, count(*) as n_regions, cast(sum(n) as bigint) as n_pixels from (select r, t.v, count(*) as n from c join t on t.id = c.n group by 1, 2) group by 1""")
def pixel_regions(spark, sf):
    p = raster.regions(fx.one_image(spark, sf).withColumn("value", F.col("value") % 3))
    sizes = p.groupBy("region", "value").agg(F.count("*").alias("n"))
    return sizes.groupBy("value").agg(F.count("*").alias("n_regions"), F.sum("n").alias("n_pixels"))


@query("polygonized_area", f"select value % 2 as value, cast(count(*) as double) as area from {P} group by 1")
def polygonized_area(spark, sf):
    p = fx.one_image(spark, sf).withColumn("value", F.col("value") % 2)
    return raster.to_geopandas(p).groupBy("value").agg(F.round(F.sum(g.area("geometry")), 3).alias("area"))


def images(spark, sf):
    e = table(spark, sf, "events")
    day = F.date_format("ts", "yyyyMMdd")
    return e.groupBy(day.alias("date")).agg(F.array_sort(F.collect_set("event_type")).alias("bands"), (F.sum(F.col("user_id") % 100) / F.count("*")).alias("cloud_cover"), F.count("*").alias("n"))


@query("filter_images", "select date, n from (select strftime(ts, '%Y%m%d') as date, list(distinct event_type) as bands, sum(user_id % 100) / count(*) as cc, count(*) as n from events group by 1) where list_contains(bands, 'click') and cc < 50 and (date <= '20240110' or date >= '20240120')")
def filter_images(spark, sf):
    return raster.filter_images(images(spark, sf), bands=["click"], date_ranges=[(None, "20240110"), ("20240120", None)], max_cloud_cover=50).select("date", "n")


@query("file_names", "select p_partkey, concat('T', 30 + p_partkey % 5, 'VNM') as tile, strftime(date '2020-01-01' + cast(p_partkey % 900 as integer), '%Y%m%d') as date, concat('B0', 1 + p_partkey % 8) as band from part where p_partkey % 4 > 0")
def file_names(spark, sf):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")), "yyyyMMdd")
    name = F.concat(F.lit("x/T"), (30 + F.col("p_partkey") % 5).cast("string"), F.lit("VNM_"), day, F.when(F.col("p_partkey") % 4 > 0, "T104019_B0").otherwise("_b"), (1 + F.col("p_partkey") % 8).cast("string"), F.lit("_10m.tif"))
    files = table(spark, sf, "part").select("p_partkey", name.alias("path"))
    return raster.parse_file_names(files, r"^(?P<tile>T\d{2}[A-Z]{3})_(?P<date>\d{8})T\d{6}_(?P<band>B[01][\dA])_(?P<resolution>\d{2})m").select("p_partkey", "tile", "date", "band")


@query("quantile_bins", "select quantile_cont(c_acctbal, 0.2) as b1, quantile_cont(c_acctbal, 0.4) as b2, quantile_cont(c_acctbal, 0.6) as b3, quantile_cont(c_acctbal, 0.8) as b4, max(c_acctbal) as b5 from customer")
def quantile_bins(spark, sf):
    bins = classify.create_bins(table(spark, sf, "customer"), "c_acctbal", 5)
    return spark.createDataFrame([tuple(bins)], "b1 double, b2 double, b3 double, b4 double, b5 double")


@query("classes_from_bins", "select case when c_acctbal > 9000 then 4 when c_acctbal > 6000 then 3 when c_acctbal > 3000 then 2 when c_acctbal > 0 then 1 else 0 end as class, count(*) as n from customer group by 1")
def classes_from_bins(spark, sf):
    c = table(spark, sf, "customer").withColumn("class", classify.classify_from_bins("c_acctbal", [0, 3000, 6000, 9000]))
    return c.groupBy("class").agg(F.count("*").alias("n"))


@query("classes_without_gaps", "select dense_rank() over (order by s) - 1 as class, n from (select p_size // 7 as s, count(*) as n from part where p_size // 7 <> 3 group by 1)".replace("p_size // 7", "cast(floor(p_size / 7.0) as bigint)").replace("dense_rank() over (order by s) - 1", "cast(dense_rank() over (order by s) - 1 as bigint)"))
def classes_without_gaps(spark, sf):
    p = table(spark, sf, "part").select(F.floor(F.col("p_size") / 7).cast("long").alias("class")).where("class <> 3")
    return classify.push_classification(p, "class").groupBy(F.col("class").cast("long").alias("class")).agg(F.count("*").alias("n"))


@query("jenks_bins")
def jenks_bins(spark, sf):
    bins = classify.create_bins(table(spark, sf, "part"), "p_size", 4, "jenks")
    return spark.createDataFrame([(b,) for b in bins], "upper double")


@query("pretty_labels", "select n_nationkey, concat(upper(n_name[1]), lower(replace(n_name[2:], '_', ' '))) as label from nation")
def pretty_labels(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", classify.prettify_label("n_name").alias("label"))
