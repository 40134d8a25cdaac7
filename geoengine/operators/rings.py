"""Polygons as rows of rings: look at them, run a function over them, and put them together again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k


def get_rings(df: DataFrame, key: str) -> DataFrame:
    """key, part, ring (0: the exterior) and geometry (a closed line) for each ring."""
    parts = df.select(key, F.posexplode(F.col("geometry")["parts"]).alias("part", "__p"))
    return parts.select(key, "part", F.posexplode("__p").alias("ring", "__r")).select(key, "part", "ring", g.geometry("LinearRing", F.array(F.array("__r"))).alias("geometry"))


def to_gdf(rings: DataFrame, key: str) -> DataFrame:
    """key and geometry: polygons from rows of rings; null rings are gone, and with its exterior a part."""
    shape = F.struct("ring", g.rings("geometry")[0].alias("r"))
    whole = rings.where("geometry is not null").groupBy(key, "part").agg(F.array_sort(F.collect_list(shape)).alias("s")).where(F.col("s")[0]["ring"] == 0)
    parts = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", F.transform("s", lambda x: x["r"]).alias("rings")))).alias("p"))
    kind = F.when(F.size("p") == 1, "Polygon").otherwise("MultiPolygon")
    return parts.select(key, F.struct(kind.alias("type"), F.transform("p", lambda x: x["rings"]).alias("parts")).alias("geometry"))


def apply_to_rings(df: DataFrame, key: str, function: Callable[[Column], Column], interiors_only: bool = False) -> DataFrame:
    """Polygons whose rings (arrays of vertices) went through a Column function."""
    rings = get_rings(df, key)
    changed = g.geometry("LinearRing", F.array(F.array(function(g.rings("geometry")[0]))))
    if interiors_only:
        changed = F.when(F.col("ring") > 0, changed).otherwise(F.col("geometry"))
    return df.drop("geometry").join(to_gdf(rings.withColumn("geometry", changed), key), key)


def get_angle_between_indexed_points(points: DataFrame, ring: str, order: str) -> DataFrame:
    """Points (x, y) of rings with the bearing to the next point and its difference to the bearing before."""
    w = Window.partitionBy(ring).orderBy(order)
    bearing = F.degrees(F.atan2(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")))
    with_bearing = points.withColumn("next_angle", bearing)
    return with_bearing.withColumn("angle_diff", F.col("next_angle") - F.lag("next_angle").over(w))


def remove_spikes(df: DataFrame, tolerance: float) -> DataFrame:
    """Ring vertices stay only inside the ring shrunk by half the tolerance and grown back; a ring that would vanish stays."""

    def run(x):
        out = []
        for part in k.parts_of(x):
            rings = []
            for ring in part:
                core = k.k.buffer("Polygon", [[ring]], -tolerance / 2, 4, "mitre")
                back = k.k.buffer("Polygon", core, tolerance / 2 + 1e-6, 4, "mitre") if core else []
                keep = [v for v, where in zip(ring, k.k.locate(ring, "Polygon", back)) if where != "E"] if back else list(ring)
                if len(keep) > 2 and keep[0] != keep[-1]:
                    keep.append(keep[0])
                rings.append(keep if len(keep) > 3 else list(ring))
            out.append(rings)
        return k.polygon_struct(out)

    return df.withColumn("geometry", k.udf(g.GEOMETRY)(run)("geometry"))


def apply_gdf_func(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function over frames of rings with their attributes."""
    return df.mapInPandas(lambda frames: (function(f) for f in frames), schema)
