"""Rasters as pixel tables: a row for each (image_id, band_id, row, col) with its value; null is masked.

Everything per pixel is a grouped aggregation or a window along rows or columns,
so an image may be as large as the cluster; a window sees one line of pixels.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.operators.components import connected_components
from geoengine.operators.joins import box_pairs

IMAGE = ["image_id", "band_id"]
#: Classes of the scene mask that hide a pixel.
SCL_CLASSES = (2, 3, 8, 9, 10, 11)


def ndvi_value(red: Column, nir: Column, padding: float = 0) -> Column:
    """(nir - red + padding) / (nir + red + padding); 0 where both are 0."""
    total = red + nir
    return F.when(total == 0, F.lit(0.0)).otherwise((nir - red + padding) / F.nullif(total + padding, F.lit(0.0)))


def with_bands(pixels: DataFrame, bands: dict[str, str]) -> DataFrame:
    """image_id, row, col and a column for each named band: one pass, no join."""
    value = [F.max(F.when(F.col("band_id") == b, F.col("value"))).alias(name) for name, b in bands.items()]
    return pixels.where(F.col("band_id").isin(*bands.values())).groupBy("image_id", "row", "col").agg(*value)


def ndvi(pixels: DataFrame, red_band: str = "B04", nir_band: str = "B08", padding: float = 0) -> DataFrame:
    """The index of each image as a band of its own."""
    both = with_bands(pixels, {"__red": red_band, "__nir": nir_band}).where("__red is not null and __nir is not null")
    return both.select("image_id", F.lit("ndvi").alias("band_id"), "row", "col", ndvi_value(F.col("__red").cast("double"), F.col("__nir").cast("double"), padding).alias("value"))


def get_brightness(pixels: DataFrame, red: str, blue: str, green: str) -> DataFrame:
    """0.299 red + 0.587 green + 0.114 blue, cut to whole numbers."""
    rgb = with_bands(pixels, {"__r": red, "__g": green, "__b": blue})
    return rgb.select("image_id", "row", "col", (F.col("__r") * 0.299 + F.col("__g") * 0.587 + F.col("__b") * 0.114).cast("int").alias("brightness"))


def _along(axis: str) -> Window:
    other = "col" if axis == "row" else "row"
    return Window.partitionBy(*IMAGE, other).orderBy(axis)


def gradient(pixels: DataFrame, resolution: float = 1.0, degrees: bool = False) -> DataFrame:
    """The sum of the absolute central differences along rows and columns, one-sided at the edges; in degrees its arctangent."""

    def slope(axis: str) -> Column:
        w = _along(axis)
        before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value").cast("double")
        return F.abs(F.coalesce((after - before) / (2 * resolution), (after - v) / resolution, (v - before) / resolution, F.lit(0.0)))

    total = slope("row") + slope("col")
    return pixels.withColumn("value", F.degrees(F.atan(total)) if degrees else total)


def buffer(pixels: DataFrame, distance: int) -> DataFrame:
    """Dilation of ones by a square of 2 d + 1 pixels, or erosion for a negative distance; what lies outside counts as 0."""
    d, f = abs(distance), F.max if distance > 0 else F.min
    if not d:
        return pixels
    out = pixels
    for axis in ("row", "col"):
        w = _along(axis).rowsBetween(-d, d)
        near = f("value").over(w)
        if distance < 0:
            # fewer neighbours than a whole window: the outside is 0
            near = F.when(F.count("*").over(w) < 2 * d + 1, F.lit(0)).otherwise(near)
        out = out.withColumn("value", near)
    return out


def clip(pixels: DataFrame, mask: DataFrame, origin: tuple[float, float] = (0.0, 0.0), resolution: float = 1.0, size: float = 256.0) -> DataFrame:
    """Values of pixels whose centre is in no polygon of the mask become null; the shape stays."""
    x, y = centre(origin, resolution)
    places = pixels.select("row", "col").distinct().withColumn("__x", x).withColumn("__y", y)
    inside = _in_polygons(places, mask.select(F.monotonically_increasing_id().alias("__p"), "geometry"), size * resolution).select(F.col("row").alias("__r"), F.col("col").alias("__c")).distinct()
    joined = pixels.join(inside, (F.col("row") == F.col("__r")) & (F.col("col") == F.col("__c")), "left")
    return joined.withColumn("value", F.when(F.col("__r").isNotNull(), F.col("value"))).drop("__r", "__c")


def centre(origin: tuple[float, float], resolution: float) -> tuple[Column, Column]:
    """x and y of a pixel's centre; rows run down from the upper left origin."""
    return origin[0] + (F.col("col") + 0.5) * resolution, origin[1] - (F.col("row") + 0.5) * resolution


def _in_polygons(places: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    boxed = polygons.withColumn("__b", g.bounds("geometry")).select("*", *[F.col(f"__b.{c}").alias(f"__{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).drop("__b")
    here = places.withColumn("__x2", F.col("__x")).withColumn("__y2", F.col("__y"))
    return box_pairs(here, boxed, ("__x", "__y", "__x2", "__y2"), ("__xmin", "__ymin", "__xmax", "__ymax"), size, g.contains_vertex("geometry", g.vertex("__x", "__y")))


def zonal(pixels: DataFrame, polygons: DataFrame, key: str, aggs: dict[str, Column], origin: tuple[float, float] = (0.0, 0.0), resolution: float = 1.0, size: float = 256.0, dropna: bool = True) -> DataFrame:
    """Aggregates of the pixels with their centre in each polygon; null values take no part. Without dropna, polygons without pixels have nulls."""
    x, y = centre(origin, resolution)
    places = pixels.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).withColumn("__x", x).withColumn("__y", y)
    found = _in_polygons(places, polygons.select(F.col(key).alias("__key"), "geometry"), size * resolution)
    out = found.groupBy("__key").agg(*[e.alias(n) for n, e in aggs.items()])
    return polygons.select(key).join(out, F.col(key) == F.col("__key"), "inner" if dropna else "left").drop("__key")


def value_counts(pixels: DataFrame) -> DataFrame:
    """value, count: masked pixels left out."""
    return pixels.where("value is not null").groupBy("value").count()


def get_n_largest(pixels: DataFrame, n: int, precision: float = 1e-6) -> DataFrame:
    """Pixels of a value at least the n-th largest, less the precision."""
    last = pixels.where("value is not null").orderBy(F.desc("value")).limit(n).agg(F.min("value").alias("__t"))
    return pixels.join(F.broadcast(last), F.col("value") >= F.col("__t") - precision).drop("__t")


def get_n_smallest(pixels: DataFrame, n: int, precision: float = 1e-6) -> DataFrame:
    """Pixels of a value at most the n-th smallest, plus the precision."""
    last = pixels.where("value is not null").orderBy("value").limit(n).agg(F.max("value").alias("__t"))
    return pixels.join(F.broadcast(last), F.col("value") <= F.col("__t") + precision).drop("__t")


def merge(pixels: DataFrame, method: str = "mean", as_int: bool = True, by: list[str] | None = None, order: str = "image_id") -> DataFrame:
    """One mosaic of all images (in each group of ``by``): mean, sum, min, max, count, first or last by ``order``, or any Spark aggregate's name.

    The mean divides by the number of images in the group, not by the number of
    values that a pixel has; ``pixel_mean`` divides by the latter.
    """
    by = by or []
    v = F.col("value")
    some = F.when(v.isNotNull(), F.col(order))
    aggs = {"sum": F.sum(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "first": F.min_by(v, some), "last": F.max_by(v, some), "mean": F.sum(v), "pixel_mean": F.avg(v)}
    out = pixels.groupBy(*by, "row", "col").agg((aggs[method] if method in aggs else F.call_function(method, v)).alias("value"))
    if method != "mean":
        return out
    images = pixels.groupBy(*by).agg(F.countDistinct("image_id", "band_id").alias("__n"))
    joined = out.crossJoin(F.broadcast(images)) if not by else out.join(images, by)
    mean = F.floor(F.col("value") / F.col("__n")).cast("long") if as_int else F.col("value") / F.col("__n")
    return joined.withColumn("value", mean).drop("__n")


def merge_by_band(pixels: DataFrame, method: str = "mean", as_int: bool = True, by: list[str] | None = None, order: str = "image_id") -> DataFrame:
    return merge(pixels, method, as_int, [*(by or []), "band_id"], order)


def pixelwise(pixels: DataFrame, function: Callable[[Column], Column], order: str = "image_id", name: str = "value") -> DataFrame:
    """row, col and a function of the pixel's values in order (an array of structs o, value); masked values are left out, as are pixels without any."""
    series = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col(order).alias("o"), F.col("value").alias("value")))))
    grouped = pixels.groupBy("row", "col").agg(series.alias("__s")).where(F.size("__s") > 0)
    return grouped.select("row", "col", function(F.col("__s")).alias(name))


def plot_pixels(pixels: DataFrame, x: str) -> DataFrame:
    """row, col, slope, intercept and n of the least squares line of each pixel's values over ``x``."""
    rows = pixels.where(F.col("value").isNotNull() & F.col(x).isNotNull())
    v, t = F.col("value").cast("double"), F.col(x).cast("double")
    return rows.groupBy("row", "col").agg(F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"), F.count("*").alias("n"))


def from_geopandas(polygons: DataFrame, value: str, order: str, resolution: float, origin: tuple[float, float], shape: tuple[int, int], fill: float = 0, merge_alg: str = "replace") -> DataFrame:
    """row, col, value: polygons burned into a raster by pixel centres; of several, the last by ``order`` (replace) or their sum (add)."""
    rows, cols = shape
    b = g.bounds("geometry")
    span = lambda low, high, n: F.sequence(F.greatest(F.lit(0), F.floor(low)).cast("long"), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(high))).cast("long"))
    dealt = polygons.withColumn("col", F.explode(span((b["xmin"] - origin[0]) / resolution, (b["xmax"] - origin[0]) / resolution, cols)))
    dealt = dealt.withColumn("row", F.explode(span((origin[1] - b["ymax"]) / resolution, (origin[1] - b["ymin"]) / resolution, rows)))
    x, y = centre(origin, resolution)
    hit = dealt.withColumn("__x", x).withColumn("__y", y).where(g.contains_vertex("geometry", g.vertex("__x", "__y")))
    burned = hit.groupBy("row", "col").agg((F.sum(value) if merge_alg == "add" else F.max_by(value, order)).alias("value"))
    spark = polygons.sparkSession
    whole = spark.range(rows).withColumnRenamed("id", "__r").crossJoin(spark.range(cols).withColumnRenamed("id", "__c"))
    return whole.join(burned, (F.col("__r") == F.col("row")) & (F.col("__c") == F.col("col")), "left").select(F.col("__r").alias("row"), F.col("__c").alias("col"), F.coalesce("value", F.lit(fill)).alias("value"))


def pixel_boxes(pixels: DataFrame, origin: tuple[float, float] = (0.0, 0.0), resolution: float = 1.0) -> DataFrame:
    """Each pixel as a box."""
    x0, y1 = origin[0] + F.col("col") * resolution, origin[1] - F.col("row") * resolution
    return pixels.withColumn("geometry", g.box(x0, y1 - resolution, x0 + resolution, y1))


def regions(pixels: DataFrame) -> DataFrame:
    """Pixels of one image with region: the smallest (row, col) code that is reached over equal neighbours up, down, left and right. Masked pixels have none."""
    rows = pixels.where("value is not null").withColumn("__id", F.col("row") * (1 << 31) + F.col("col"))
    right = F.lead(F.struct("col", "value", "__id")).over(Window.partitionBy("row").orderBy("col"))
    down = F.lead(F.struct("row", "value", "__id")).over(Window.partitionBy("col").orderBy("row"))
    near = rows.withColumn("__right", right).withColumn("__down", down)
    a = near.where((F.col("__right.col") == F.col("col") + 1) & (F.col("__right.value") == F.col("value"))).select(F.col("__id").alias("u"), F.col("__right.__id").alias("v"))
    b = near.where((F.col("__down.row") == F.col("row") + 1) & (F.col("__down.value") == F.col("value"))).select(F.col("__id").alias("u"), F.col("__down.__id").alias("v"))
    found = connected_components(a.unionByName(b)).toDF("__n", "__root")
    return rows.join(found, F.col("__id") == F.col("__n"), "left").withColumn("region", F.coalesce("__root", "__id")).drop("__id", "__n", "__root")


def to_geopandas(pixels: DataFrame, origin: tuple[float, float] = (0.0, 0.0), resolution: float = 1.0) -> DataFrame:
    """value, geometry: the regions of equal value as polygons."""
    from geoengine.operators.overlay import union_by

    boxed = pixel_boxes(regions(pixels), origin, resolution)
    return union_by(boxed.select("region", "value", "geometry"), ["region", "value"], 64 * resolution).select("value", "geometry")


def filter_images(images: DataFrame, bands: list[str] | None = None, date_ranges: list[tuple[str | None, str | None]] | None = None, bbox: tuple[float, float, float, float] | None = None, max_cloud_cover: float | None = None) -> DataFrame:
    """Images (image_id, date as 8 digits, bands, cloud_cover, xmin, ymin, xmax, ymax) that have all bands, lie in one of the closed ranges, meet the box, and are less cloudy. Undated images are in no range."""
    out = images
    if bands:
        out = out.where(F.forall(F.array(*[F.lit(b) for b in bands]), lambda b: F.array_contains("bands", b)))
    if date_ranges:
        day, any_range = F.to_date("date", "yyyyMMdd"), F.lit(False)
        for low, high in date_ranges:
            fits = day.isNotNull()
            fits = fits & (day >= F.to_date(F.lit(low), "yyyyMMdd")) if low else fits
            fits = fits & (day <= F.to_date(F.lit(high), "yyyyMMdd")) if high else fits
            any_range = any_range | fits
        out = out.where(any_range)
    if bbox:
        out = out.where((F.col("xmin") <= bbox[2]) & (F.col("xmax") >= bbox[0]) & (F.col("ymin") <= bbox[3]) & (F.col("ymax") >= bbox[1]))
    if max_cloud_cover is not None:
        out = out.where(F.col("cloud_cover") < max_cloud_cover)
    return out


def sort_images(images: DataFrame, ascending: bool = True) -> DataFrame:
    """By date, undated ones after by path."""
    keys = ["date", "path"]
    return images.orderBy(*[F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c) for c in keys])


def sample_images(images: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n images without replacement, by a keyed hash; fewer than n is an error."""
    if images.limit(n).count() < n:
        raise ValueError(f"there are fewer than {n} images")
    return images.orderBy(F.xxhash64(F.lit(seed), "image_id"), "image_id").limit(n)


def sample_window(pixels: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """A square window of each image at a place keyed by the seed and the image."""
    r = pixels.groupBy("image_id").agg(F.max("row").alias("__mr"), F.max("col").alias("__mc"))
    at = lambda salt, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "image_id"), F.greatest(F.lit(1), F.col(most) + 2 - size))
    r = r.select(F.col("image_id").alias("__i"), at(1, "__mr").alias("__r0"), at(2, "__mc").alias("__c0"))
    joined = pixels.join(r, F.col("image_id") == F.col("__i"))
    return joined.where((F.col("row") >= F.col("__r0")) & (F.col("row") < F.col("__r0") + size) & (F.col("col") >= F.col("__c0")) & (F.col("col") < F.col("__c0") + size)).drop("__i", "__r0", "__c0")


def parse_file_names(files: DataFrame, pattern: str, column: str = "path") -> DataFrame:
    """Files whose name matches, with a column for each named group of the pattern (Python syntax)."""
    names = [n for n, _ in sorted(re.compile(pattern).groupindex.items(), key=lambda x: x[1])]
    numbers = re.compile(pattern).groupindex
    java = re.sub(r"\(\?P<", "(?<", pattern)
    name = F.element_at(F.split(column, "/"), -1)
    out = files.where(name.rlike(java))
    return out.select("*", *[F.nullif(F.regexp_extract(name, java, numbers[n]), F.lit("")).alias(n) for n in names])


def apply_scl_mask(pixels: DataFrame, mask_band: str = "SCL", classes: tuple[int, ...] = SCL_CLASSES) -> DataFrame:
    """The other bands with null where the mask band says so: one pass over the pixels of a place."""
    hidden = F.max(F.when(F.col("band_id") == mask_band, F.col("value").isin(*classes))).over(Window.partitionBy("image_id", "row", "col"))
    return pixels.withColumn("__m", hidden).where(F.col("band_id") != mask_band).withColumn("value", F.when(~F.coalesce("__m", F.lit(False)), F.col("value"))).drop("__m")


def cloud_cover(xml: Column) -> Column:
    """The first of the two tags that name the cloud cover, as a number."""
    tags = ("CLOUDY_PIXEL_OVER_LAND_PERCENTAGE", "Cloud_Coverage_Assessment")
    return F.coalesce(*[F.nullif(F.regexp_extract(xml, f"<{t}>([\\d.]+)</{t}>", 1), F.lit("")).cast("double") for t in tags])


def boa_quantification(xml: Column) -> Column:
    return F.nullif(F.regexp_extract(xml, r"<BOA_QUANTIFICATION_VALUE[^>]*>-?(\d+)</BOA_QUANTIFICATION_VALUE>", 1), F.lit("")).cast("int")


def refined(xml: Column) -> Column:
    """Whether the image was refined; null if it doesn't say."""
    flag = F.regexp_extract(xml, r'<Image_Refining flag="(REFINED|NOT_REFINED)">', 1)
    return F.when(flag == "REFINED", True).when(flag == "NOT_REFINED", False)
