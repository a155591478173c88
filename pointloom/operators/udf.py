"""User code inside a pipeline: by batch, by view, as an aggregate, and (only if allowed) as a command."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def python(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None, by_view: bool = False) -> DataFrame:
    """``function`` of each batch of rows, or of each whole view."""
    kind = schema or df.schema
    if by_view:
        keyed = df if "view" in df.columns else df.withColumn("view", F.lit(0))
        return keyed.groupBy("view").applyInPandas(function, kind if schema or "view" in df.columns else keyed.schema)

    def run(frames):
        for f in frames:
            yield function(f)

    return df.mapInPandas(run, kind)


def aggregate(df: DataFrame, by: list[str], function: Callable[[pd.Series], float], dimension: str, name: str = "value") -> DataFrame:
    """A user's aggregate of a dimension in each group."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> float:
        return float(function(v))

    return df.groupBy(*by).agg(run(F.col(dimension).cast("double")).alias(name))


def h3(df: DataFrame, resolution: int) -> DataFrame:
    """H3: the hexagon of each longitude and latitude, where the ``h3`` package is installed."""
    try:
        import h3 as library
    except ModuleNotFoundError as e:
        raise NotImplementedError("filters.h3 needs the h3 package") from e

    @F.pandas_udf("string")
    def cell(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series([library.latlng_to_cell(b, a, resolution) for a, b in zip(lon, lat, strict=True)])

    return df.withColumn("H3", F.conv(cell(F.col("X"), F.col("Y")), 16, 10).cast("decimal(20,0)"))


def shell(df: DataFrame, command: str, allow: bool = False) -> str:
    """The output of a command, run once by the driver; nothing runs unless it is allowed."""
    if not allow:
        raise PermissionError("filters.shell runs nothing unless allow is set")
    return subprocess.run(command, shell=True, capture_output=True, text=True, check=True, timeout=600).stdout
