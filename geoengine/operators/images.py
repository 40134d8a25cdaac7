"""Collections of images as tables: grouping, selection, sizes and per-image functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoengine.functions import geometry as g


def metadata_from_paths(files: DataFrame, column: str = "path") -> DataFrame:
    """image_path, image_name, file_paths and file_names: files grouped by their folder."""
    parts = F.split(column, "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    grouped = files.select(folder.alias("image_path"), F.col(column).alias("p")).groupBy("image_path").agg(F.array_sort(F.collect_list("p")).alias("file_paths"))
    return grouped.select("image_path", F.element_at(F.split("image_path", "/"), -1).alias("image_name"), "file_paths", F.transform("file_paths", lambda p: F.element_at(F.split(p, "/"), -1)).alias("file_names"))


def explode_bands(images: DataFrame) -> DataFrame:
    """An image for each band."""
    return images.withColumn("band_id", F.explode("bands")).withColumn("bands", F.array("band_id"))


def get_unique_band_ids(images: DataFrame) -> DataFrame:
    return images.select(F.explode("bands").alias("band_id")).distinct()


def concat_image_collections(*collections: DataFrame) -> DataFrame:
    """All images; collections of different resolutions are an error."""
    out = collections[0]
    for c in collections[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    if "res" in out.columns and len(out.select("res").where("res is not null").distinct().limit(2).collect()) > 1:
        raise ValueError("the collections have different resolutions")
    return out


def select_images(images: DataFrame, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """Images by their place in the order of date and path, as a slice takes them. The table has a row an image."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("date"), F.asc_nulls_last("path"))) - 1
    placed = images.withColumn("__n", place).where((F.col("__n") >= start) & ((F.col("__n") - start) % step == 0))
    return (placed if stop is None else placed.where(F.col("__n") < stop)).drop("__n")


def date_parts(images: DataFrame) -> DataFrame:
    """year, month and day of dates of 8 digits."""
    d = F.to_date("date", "yyyyMMdd")
    return images.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})


def image_metadata_json(bands: DataFrame) -> DataFrame:
    """image_id and metadata: a JSON object of each band's attributes."""
    others = [c for c in bands.columns if c not in ("image_id", "band_id")]
    return bands.groupBy("image_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band_id", F.struct(*others)))))).alias("metadata"))


def apply_per_image(pixels: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by_band: bool = True) -> DataFrame:
    """A function over the pixels of each image (and band)."""
    return pixels.groupBy(*["image_id", "band_id"][: 2 if by_band else 1]).applyInPandas(function, schema)


def image_bounds(images: DataFrame) -> DataFrame:
    return images.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def image_boxes(images: DataFrame) -> DataFrame:
    return images.withColumn("geometry", g.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def shape_from_bounds(images: DataFrame, resolution: float) -> DataFrame:
    """rows and cols of an image of the bounds, cut to whole pixels."""
    return images.withColumns({"rows": ((F.col("ymax") - F.col("ymin")) / resolution).cast("int"), "cols": ((F.col("xmax") - F.col("xmin")) / resolution).cast("int")})


def pixels_to_dict(results: DataFrame) -> DataFrame:
    """One row for each image line: row and a map from col to value."""
    return results.groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("values"))


def dense(results: DataFrame, rows: int, cols: int, fill: float | None = None) -> DataFrame:
    """Every pixel of the shape, with the fill where there is no result."""
    spark = results.sparkSession
    whole = spark.range(rows).withColumnRenamed("id", "__r").crossJoin(spark.range(cols).withColumnRenamed("id", "__c"))
    joined = whole.join(results, (F.col("__r") == F.col("row")) & (F.col("__c") == F.col("col")), "left")
    return joined.select(F.col("__r").alias("row"), F.col("__c").alias("col"), F.coalesce("value", F.lit(fill)).alias("value"))
