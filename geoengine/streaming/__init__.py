"""Geometry over streams: positions counted by grid cell and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_counts(stream: DataFrame, gridsize: int, window: str, delay: str, time: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """cx, cy, start, n: positions in each cell and window; rows later than ``delay`` are left out, which bounds the state."""
    cell = lambda c: F.floor(F.col(c) / gridsize)
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), cell(x).alias("cx"), cell(y).alias("cy")).agg(F.count("*").alias("n"))
    return counted.select("cx", "cy", F.col("w.start").alias("start"), "n")
