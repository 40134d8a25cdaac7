"""Classes for thematic maps: breaks, classes by breaks, and legends' numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoengine.functions.kernels import jenks


def create_bins(df: DataFrame, column: str, k: int = 5, scheme: str = "quantiles") -> list[float]:
    """Upper class bounds, the maximum last: distinct quantiles, natural breaks, or the distinct values if there are no more than k.

    Natural breaks are exact over all distinct values, which the driver takes with their counts.
    """
    values = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("v"))
    few = [r.v for r in values.select("v").distinct().limit(k + 1).collect()]
    if len(few) <= k:
        return sorted(few)
    if scheme == "quantiles":
        p = values.agg(F.percentile("v", F.array(*[F.lit((i + 1) / k) for i in range(k)])).alias("p")).first().p
        return sorted(set(p))
    if scheme != "jenks":
        raise ValueError(f"no such scheme: {scheme}")
    rows = values.groupBy("v").count().toPandas().sort_values("v")
    return jenks(rows["v"].to_numpy(), rows["count"].to_numpy(), k)


def classify_from_bins(column: str | Column, bins: list[float]) -> Column:
    """The number of bounds below the value (null for null)."""
    c = F.col(column) if isinstance(column, str) else column
    below = sum((F.when(c > b, 1).otherwise(0) for b in bins), F.lit(0))
    return F.when(c.isNotNull(), below)


def push_classification(df: DataFrame, column: str) -> DataFrame:
    """Classes renumbered without gaps."""
    classes = df.select(F.col(column).alias("__c")).distinct().where("__c is not null")
    # as many rows as there are classes
    numbered = classes.withColumn("__n", F.row_number().over(Window.orderBy("__c")) - 1)
    return df.join(F.broadcast(numbered), F.col(column) == F.col("__c"), "left").withColumn(column, F.col("__n")).drop("__c", "__n")


def to_categorical(column: str) -> Column:
    """Numbers as text, whole ones without decimals."""
    c = F.col(column).cast("double")
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def get_rounding(df: DataFrame, column: str) -> int:
    """How many decimals a legend needs."""
    c = F.col(column).cast("double")
    r = df.agg(F.max(c).alias("m"), F.stddev_pop(c).alias("s"), F.max(F.abs(c - F.round(c))).alias("f")).first()
    if r.m is None or not r.f:
        return 0
    if r.m > 30 and r.s > 5:
        return 0
    if r.m > 5 and r.s > 1:
        return 1
    return 2 if r.m > 1 else 3 if r.m > 0.1 else 5


def prettify_label(label: str | Column) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.initcap(F.trim(F.regexp_replace(c, "_+", " ")))


def proper_fillna(column: str | Column, value) -> Column:
    """The column with ``value`` where it is null or not a number."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull() | (c.cast("string") == "NaN"), F.lit(value)).otherwise(c)


def nodata_share(column: str, nodata: float | None = None) -> Column:
    """Aggregate: the share of values that are missing."""
    c = F.col(column)
    none = c.isNull() | F.isnan(c.cast("double"))
    return F.avg((none | (c == nodata) if nodata is not None else none).cast("double"))
