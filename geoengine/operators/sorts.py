"""Orders in which geometries win over others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.functions import geometry as g


def sort_large_first(df: DataFrame, order: str) -> DataFrame:
    """By falling area, equals in reverse order."""
    return df.orderBy(g.area("geometry").desc(), F.col(order).desc())


def sort_small_first(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(g.area("geometry").asc(), F.col(order).asc())


def sort_long_first(df: DataFrame, order: str) -> DataFrame:
    """By falling length, equals in reverse order."""
    return df.orderBy(g.length("geometry").desc(), F.col(order).desc())


def sort_short_first(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(g.length("geometry").asc(), F.col(order).asc())


def sort_nans_last(df: DataFrame, order: str) -> DataFrame:
    """By the number of nulls in the row."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.orderBy(nulls, F.col(order))
