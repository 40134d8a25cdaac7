"""Grids, bounds, random points and loops over grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoengine.functions import geometry as g


def make_grid_from_bbox(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, gridsize: float) -> DataFrame:
    """Square cells (x0, y0 and geometry). The columns of cells start at minx, minx + g, ... and each reaches from x0 - g to x0."""
    # as many steps as an open range to max + g has
    nx, ny = (max(0, math.ceil((high + gridsize - low) / gridsize - 1e-9)) for low, high in ((minx, maxx), (miny, maxy)))
    x = spark.range(nx).select((F.lit(float(minx)) + F.col("id") * float(gridsize)).alias("x0"))
    y = spark.range(ny).select((F.lit(float(miny)) + F.col("id") * float(gridsize)).alias("y0"))
    cells = x.crossJoin(y)
    return cells.withColumn("geometry", g.box(F.col("x0") - gridsize, F.col("y0"), F.col("x0"), F.col("y0") + gridsize))


def make_grid(df: DataFrame, gridsize: float, clip_to_bounds: bool = False) -> DataFrame:
    """Cells over the bounds of a table with a geometry; lower bounds that are not whole are rounded down. Clipped, no cell reaches beyond the bounds."""
    b = get_total_bounds(df).first()
    if b.xmin is None:
        return make_grid_from_bbox(df.sparkSession, 0, 0, -2 * gridsize, -2 * gridsize, gridsize)
    grid = make_grid_from_bbox(df.sparkSession, math.floor(b.xmin), math.floor(b.ymin), b.xmax, b.ymax, gridsize)
    if not clip_to_bounds:
        return grid
    lit = lambda v: F.lit(float(v))
    x0, y0 = F.greatest(F.col("x0") - gridsize, lit(b.xmin)), F.greatest(F.col("y0"), lit(b.ymin))
    x1, y1 = F.least(F.col("x0"), lit(b.xmax)), F.least(F.col("y0") + gridsize, lit(b.ymax))
    return grid.where((x1 > x0) & (y1 > y0)).withColumn("geometry", g.box(x0, y0, x1, y1))


def add_grid_id(points: DataFrame, gridsize: int, out_column: str = "grid_id", x: str = "x", y: str = "y") -> DataFrame:
    """The id of the official grid's cell: east (shifted by two million) and north of its lower left corner, as one text."""
    east = (F.floor((F.col(x) + 2_000_000) / gridsize) * gridsize).cast("long")
    north = (F.floor(F.col(y) / gridsize) * gridsize).cast("long")
    return points.withColumn(out_column, F.concat(east.cast("string"), north.cast("string")))


def make_official_grid(points: DataFrame, gridsize: int = 1000, add: int = 1) -> DataFrame:
    """All cells of the official grid over the points' bounds, with their id."""
    r = points.agg(*[F.floor(f(c) / gridsize).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("a", F.min), ("b", F.max))]).first()
    spark = points.sparkSession
    if r.ax is None:
        return spark.range(0).select(F.lit("").alias("grid_id"), g.point(F.lit(0.0), F.lit(0.0)).alias("geometry"))
    xs = spark.range(r.ax, r.bx + add).select((F.col("id") * gridsize).alias("x"))
    ys = spark.range(r.ay, r.by + add).select((F.col("id") * gridsize).alias("y"))
    cells = add_grid_id(xs.crossJoin(ys), gridsize)
    return cells.select("grid_id", g.box(F.col("x"), F.col("y"), F.col("x") + gridsize, F.col("y") + gridsize).alias("geometry"))


def get_total_bounds(*dfs: DataFrame) -> DataFrame:
    """One row xmin, ymin, xmax, ymax over all tables."""
    names = ("xmin", "ymin", "xmax", "ymax")
    boxes = None
    for df in dfs:
        own = df.select(g.bounds("geometry").alias("b")).select("b.*")
        boxes = own if boxes is None else boxes.unionByName(own)
    return boxes.agg(*[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in names])


def points_in_bounds(df: DataFrame, gridsize: float) -> DataFrame:
    """A lattice of points over the bounds: as many along each side as whole cells fit, the ends included."""
    b = get_total_bounds(df).first()
    spark = df.sparkSession
    nx, ny = max(1, int((b.xmax - b.xmin) / gridsize)), max(1, int((b.ymax - b.ymin) / gridsize))
    step = lambda low, high, n: F.lit(float(low)) + F.col("id") * ((high - low) / max(1, n - 1))
    xs = spark.range(nx).select(step(b.xmin, b.xmax, nx).alias("x"))
    return xs.crossJoin(spark.range(ny).select(step(b.ymin, b.ymax, ny).alias("y")))


def points_in_polygons(df: DataFrame, key: str, gridsize: float) -> DataFrame:
    """key, x, y: the lattice points of the whole bounds that lie in each polygon."""
    b = get_total_bounds(df).first()
    nx, ny = max(1, int((b.xmax - b.xmin) / gridsize)), max(1, int((b.ymax - b.ymin) / gridsize))
    sx, sy = (b.xmax - b.xmin) / max(1, nx - 1) or 1.0, (b.ymax - b.ymin) / max(1, ny - 1) or 1.0
    box = g.bounds("geometry")
    # each polygon makes the lattice points of its own box: no join
    span = lambda low, high, origin, step, n: F.sequence(F.greatest(F.lit(0), F.ceil((low - origin) / step)).cast("long"), F.least(F.lit(n - 1), F.floor((high - origin) / step)).cast("long"))
    i = df.withColumn("__b", box).withColumn("__i", F.explode(span(F.col("__b.xmin"), F.col("__b.xmax"), b.xmin, sx, nx)))
    ij = i.withColumn("__j", F.explode(span(F.col("__b.ymin"), F.col("__b.ymax"), b.ymin, sy, ny)))
    at = ij.withColumn("x", b.xmin + F.col("__i") * sx).withColumn("y", b.ymin + F.col("__j") * sy)
    return at.where(g.contains_vertex("geometry", g.vertex("x", "y"))).select(key, "x", "y")


def random_points(spark: SparkSession, n: int, loc: float = 0.5, seed: int | None = None) -> DataFrame:
    """n points, x and y uniform below 2 * loc."""
    second = None if seed is None else seed + 1
    return spark.range(n).select((F.rand(seed) * 2 * loc).alias("x"), (F.rand(second) * 2 * loc).alias("y"))


def random_points_in_polygons(df: DataFrame, key: str, size: int, seed: int = 0, tries: int = 40) -> DataFrame:
    """key, x, y: ``size`` points in each polygon, by rejection from its bounds; the trial points are keyed by seed, row and number, so reruns agree."""
    u = lambda salt, i: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key, i), F.lit(1 << 40)) / float(1 << 40)
    at = lambda i: g.vertex(F.col("__b.xmin") + u(1, i) * (F.col("__b.xmax") - F.col("__b.xmin")), F.col("__b.ymin") + u(2, i) * (F.col("__b.ymax") - F.col("__b.ymin")))
    inside = lambda first, last: F.filter(F.transform(F.sequence(F.lit(first), F.lit(last)), at), lambda v: g.contains_vertex("geometry", v))
    # most shapes need few trials: further ones are made where those before do not do
    tried = min(size, size * tries)
    rows = df.select(key, "geometry").repartition(key).withColumn("__b", g.bounds("geometry")).withColumn("__v", inside(0, tried))
    while tried < size * tries:
        upto = min(size * tries, 3 * tried)
        rows = rows.withColumn("__v", F.when(F.size("__v") >= size, F.col("__v")).otherwise(F.concat("__v", inside(tried + 1, upto))))
        tried = upto
    return rows.select(key, F.explode(F.slice("__v", 1, size)).alias("__v")).select(key, "__v.x", "__v.y")


def gridloop(points: DataFrame, gridsize: float, function: Callable, schema: str, gridbuffer: float = 0.0) -> DataFrame:
    """Run ``function`` (pandas frame of a cell's points to a frame) on every grid cell; with a buffer, a cell also sees the points that far around it. cx and cy tell the cell."""
    reach = lambda c, s: F.floor((F.col(c) + s * gridbuffer) / gridsize)
    dealt = points.withColumn("cx", F.explode(F.sequence(reach("x", -1), reach("x", 1)))).withColumn("cy", F.explode(F.sequence(reach("y", -1), reach("y", 1))))
    return dealt.groupBy("cx", "cy").applyInPandas(function, schema)
