"""User functions over chunks of rows, and over items."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from geoengine.operators.overlay import clean_overlay


def chunkwise(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_rows_per_chunk: int = 10_000) -> DataFrame:
    """``function`` over chunks of at most that many rows."""

    def run(frames):
        for f in frames:
            for k in range(0, len(f), max_rows_per_chunk):
                yield function(f.iloc[k : k + max_rows_per_chunk])

    return df.mapInPandas(run, schema)


def pmap(spark: SparkSession, function: Callable[..., Any], items: Iterable[Any], args: tuple = (), kwargs: dict | None = None, star: bool = False) -> list:
    """The function's results in the items' order; ``star`` unpacks tuples. The driver holds the items and the results, as a list does."""
    import pickle

    from pyspark import cloudpickle

    call = lambda x: function(*x, *args, **(kwargs or {})) if star else function(x, *args, **(kwargs or {}))
    rows = [(n, bytearray(cloudpickle.dumps(x))) for n, x in enumerate(items)]
    if not rows:
        return []

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"n": f.n, "v": [cloudpickle.dumps(call(pickle.loads(bytes(v)))) for v in f.v]})

    df = spark.createDataFrame(rows, "n long, v binary").repartition(len(rows), "n")
    return [pickle.loads(bytes(r.v)) for r in df.mapInPandas(run, "n long, v binary").orderBy("n").collect()]


def parallel_overlay(df1: DataFrame, df2: DataFrame, **options) -> DataFrame:
    """The overlay is distributed as it is."""
    return clean_overlay(df1, df2, "intersection", **options)
