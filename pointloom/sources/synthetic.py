"""Generated and in-memory points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import parse_bounds


def faux(spark: SparkSession, mode: str = "ramp", count: int = 100, bounds: str = "([0,1],[0,1],[0,1])", mean_x: float = 0.0, mean_y: float = 0.0, mean_z: float = 0.0, stdev_x: float = 1.0, stdev_y: float = 1.0, stdev_z: float = 1.0, number_of_returns: int = 0, seed: int = 0) -> DataFrame:
    """Constant, random (uniform), ramp, normal, grid or invalid (NaN) points; random ones depend on seed and pid alone."""
    box = parse_bounds(bounds)
    n = count
    if mode == "grid":
        sizes = [int(round(b - a)) or 1 for a, b in box]
        n = 1
        for s in sizes:
            n *= s
    df = spark.range(n).withColumnRenamed("id", "pid")
    i = F.col("pid").cast("double")

    def uniform(salt: int):
        return (F.xxhash64(F.lit(seed), F.lit(salt), "pid").bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)

    new = {}
    for k, (c, (a, b)) in enumerate(zip("XYZ", [*box, (0.0, 0.0)][:3], strict=True)):
        if mode == "constant":
            new[c] = F.lit(float(a))
        elif mode == "ramp":
            new[c] = F.lit(float(a)) + i * ((b - a) / (n - 1) if n > 1 else 0.0)
        elif mode in ("random", "uniform"):
            new[c] = F.lit(float(a)) + uniform(k) * (b - a)
        elif mode == "normal":
            m, s = ((mean_x, stdev_x), (mean_y, stdev_y), (mean_z, stdev_z))[k]
            new[c] = F.lit(m) + s * F.sqrt(-2 * F.log(uniform(k))) * F.cos(2 * 3.141592653589793 * uniform(k + 3))
        elif mode == "grid":
            step = 1
            for s in sizes[:k]:
                step *= s
            new[c] = F.lit(float(a)) + (F.floor(F.col("pid") / step) % sizes[k]) if k < len(sizes) else F.lit(0.0)
        elif mode == "invalid":
            new[c] = F.lit(float("nan"))
        else:
            raise ValueError(f"unknown mode {mode!r}")
    df = df.withColumns({c: v.cast("double") for c, v in new.items()}).withColumn("OffsetTime", F.col("pid"))
    if number_of_returns:
        df = df.withColumn("ReturnNumber", (F.col("pid") % number_of_returns + 1).cast("smallint")).withColumn("NumberOfReturns", F.lit(number_of_returns).cast("smallint"))
    return df


def buffer(spark: SparkSession, frame: DataFrame | pd.DataFrame) -> DataFrame:
    """A DataFrame, or a pandas one, as points."""
    df = frame if isinstance(frame, DataFrame) else spark.createDataFrame(frame.assign(pid=range(len(frame))) if "pid" not in frame else frame)
    return df if "pid" in df.columns else df.withColumn("pid", F.monotonically_increasing_id())


def memoryview_(spark: SparkSession, columns: dict) -> DataFrame:
    """Arrays by dimension name."""
    return buffer(spark, pd.DataFrame(columns))
