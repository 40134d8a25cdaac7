"""Tables with a geometry from coordinates, boxes, text, binary or GeoJSON, and bounds of anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k


def to_gdf(df: DataFrame, x: str | None = None, y: str | None = None, wkt: str | None = None, wkb: str | None = None, geojson: str | None = None, bbox: tuple[str, str, str, str] | None = None) -> DataFrame:
    """``df`` with a geometry made from the named columns; exactly one source is given."""
    given = [c for c in (x and y and (x, y), wkt, wkb, geojson, bbox) if c]
    if len(given) != 1:
        raise ValueError("give one of x and y, wkt, wkb, geojson or bbox")
    if x and y:
        made = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), g.point(x, y))
    elif wkt:
        made = k.from_wkt(F.col(wkt))
    elif wkb:
        made = k.from_wkb(F.col(wkb))
    elif geojson:
        made = k.from_geojson(F.col(geojson))
    else:
        made = g.box(*[F.col(c) for c in bbox])
    return df.withColumn("geometry", made)


def to_bbox(df: DataFrame) -> DataFrame:
    from geoengine.operators.grid import get_total_bounds

    return get_total_bounds(df)


def to_shapely(df: DataFrame) -> DataFrame:
    """One row: the union of all polygons."""
    from geoengine.operators.overlay import union_by

    return union_by(df.select(F.lit(0).alias("__all"), "geometry"), ["__all"]).select("geometry")


def coordinate_array(df: DataFrame) -> DataFrame:
    """x, y of every vertex."""
    return df.select(F.explode(g.vertices("geometry")).alias("v")).select("v.x", "v.y")


def get_geom_type(df: DataFrame) -> str | None:
    """polygon, line, point or mixed for the whole table; None without a geometry."""
    kinds = [r[0] for r in df.where("geometry is not null").select(g.geom_family("geometry")).distinct().limit(2).collect()]
    return None if not kinds else kinds[0] if len(kinds) == 1 else "mixed"


def to_single_geom_type(df: DataFrame, geom_type: str) -> DataFrame:
    return df.where(g.geom_family("geometry") == geom_type)


def split_geom_types(df: DataFrame) -> dict[str, DataFrame]:
    """A frame for each geometry type of the rows, by the type's name; rows without a geometry are in none."""
    kinds = df.where("geometry is not null").select(F.col("geometry")["type"].alias("t")).distinct()
    return {r.t: df.where(F.col("geometry")["type"] == r.t) for r in kinds.orderBy("t").collect()}


def make_all_singlepart(df: DataFrame) -> DataFrame:
    return df.withColumn("geometry", F.explode(g.explode_parts("geometry")))
