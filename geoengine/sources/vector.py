"""Vector tables in Parquet with a covering box for each row, so that a mask prunes row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoengine.functions import geometry as g

COVER = ("xmin", "ymin", "xmax", "ymax")


def write_geopandas(df: DataFrame, path: str, overwrite: bool = True, partition_cols: list[str] | None = None, existing_data_behavior: str = "error") -> None:
    """Write with bbox columns. Partitioned tables: error (if it exists), delete_matching (only the partitions that are written are replaced) or append."""
    out = df.withColumn("__bbox", g.bounds("geometry")).select("*", *[F.col(f"__bbox.{c}").alias(f"__{c}") for c in COVER]).drop("__bbox")
    writer = out.write
    if not partition_cols:
        writer.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        return
    modes = {"error": ("errorifexists", "static"), "delete_matching": ("overwrite", "dynamic"), "append": ("append", "static")}
    if existing_data_behavior not in modes:
        raise ValueError(f"no such behavior: {existing_data_behavior}")
    mode, replaced = modes[existing_data_behavior]
    writer.mode(mode).option("partitionOverwriteMode", replaced).partitionBy(*partition_cols).parquet(path)


def read_geopandas(spark: SparkSession, paths: str | list[str], mask: tuple[float, float, float, float] | None = None, filters: str | None = None) -> DataFrame:
    """Read rows that satisfy ``filters`` and whose box meets the mask. Both reach the scan, as partition and row group filters. A null partition value matches like any null: only if the filter says so."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if filters is not None:
        df = df.where(filters)
    if mask is not None and "__xmin" in df.columns:
        xmin, ymin, xmax, ymax = map(float, mask)
        df = df.where((F.col("__xmin") <= xmax) & (F.col("__xmax") >= xmin) & (F.col("__ymin") <= ymax) & (F.col("__ymax") >= ymin))
    return df.drop(*[f"__{c}" for c in COVER])


def get_bounds_series(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, xmin, ymin, xmax, ymax of each file, from the covering columns alone."""
    df = spark.read.parquet(*paths)
    return df.groupBy(F.input_file_name().alias("path")).agg(*[(F.min if c.endswith("min") else F.max)(f"__{c}").alias(c) for c in COVER])


def check_files(spark: SparkSession, folder: str, contains: str | None = None, within_minutes: int | None = None) -> DataFrame:
    """path, size, updated of the files below a folder, by name and age."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("updated"))
    if contains is not None:
        files = files.where(F.col("path").contains(contains))
    if within_minutes is not None:
        files = files.where(F.col("updated") > F.current_timestamp() - F.expr(f"interval {int(within_minutes)} minutes"))
    return files


def write_municipality_data(df: DataFrame, path: str, region_col: str, neighbors: DataFrame | None = None) -> None:
    """One partition for each region code; with ``neighbors`` (region, neighbor) a region also gets its neighbours' rows."""
    out = df
    if neighbors is not None:
        pairs = neighbors.toDF("__region", "__neighbor")
        own = df.select(F.col(region_col).alias("__region"), F.col(region_col).alias("__neighbor")).distinct()
        out = df.join(pairs.unionByName(own).distinct(), F.col(region_col) == F.col("__neighbor")).withColumn(region_col, F.col("__region")).drop("__region", "__neighbor")
    out.write.mode("overwrite").partitionBy(region_col).parquet(path)


def write_geojson(df: DataFrame, path: str) -> None:
    """One GeoJSON feature a line."""
    from geoengine.functions.kernels import to_geojson

    others = [c for c in df.columns if c != "geometry"]
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*others)) if others else F.lit("{}"), F.lit(',"geometry":'), F.coalesce(to_geojson(F.col("geometry")), F.lit("null")), F.lit("}"))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)
