"""Sorting and reordering; the new order is in ``pid``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import with_rank


def sort(df: DataFrame, dimensions: str | list[str], order: str = "ASC") -> DataFrame:
    """Sort by dimensions, of which the LAST listed is the most significant; ties keep their order."""
    names = [d.strip() for d in dimensions.split(",")] if isinstance(dimensions, str) else list(dimensions)
    keys = [F.desc(d) if order.upper() == "DESC" else F.asc(d) for d in reversed(names)]
    return with_rank(df, *keys, F.asc("pid"), name="__pid").drop("pid").withColumnRenamed("__pid", "pid")


def _spread(c: Column, bits: int) -> Column:
    """The low bits of a number, a zero bit between each two."""
    c = c.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        if shift < bits:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton_code(x: Column, y: Column, bits: int = 31) -> Column:
    return _spread(x, bits).bitwiseOR(F.shiftleft(_spread(y, bits), 1))


def with_morton(df: DataFrame, reverse: bool = False, name: str = "morton") -> DataFrame:
    b = df.agg(F.min("X").alias("x0"), F.max("X").alias("x1"), F.min("Y").alias("y0"), F.max("Y").alias("y1"), F.count("*").alias("n")).first()
    if not b.n:
        return df.withColumn(name, F.lit(0).cast("long"))
    wx, wy = (b.x1 - b.x0) or 1.0, (b.y1 - b.y0) or 1.0
    if reverse:
        cells = max(1, int(math.sqrt(b.n)))
        cx, cy = (F.least(F.floor((F.col(c) - lo) / w * cells), F.lit(cells - 1)) for c, lo, w in (("X", b.x0, wx), ("Y", b.y0, wy)))
        code = morton_code(cx, cy, 16)
        bits = F.lit(0).cast("long")
        for i in range(32):
            bits = bits.bitwiseOR(F.shiftleft(F.shiftright(code, i).bitwiseAND(F.lit(1)), 31 - i))
        return df.withColumn(name, bits)
    top = float(2**31 - 1)
    scaled = [((F.col(c) - lo) / w * top).cast("long") for c, lo, w in (("X", b.x0, wx), ("Y", b.y0, wy))]
    return df.withColumn(name, morton_code(*scaled))


def mortonorder(df: DataFrame, reverse: bool = False) -> DataFrame:
    """Rows along a Z-shaped curve, or scattered by the reversed code."""
    coded = with_morton(df, reverse, "__m")
    return with_rank(coded, F.asc("__m"), F.asc("pid"), name="__pid").drop("pid", "__m").withColumnRenamed("__pid", "pid")


def randomize(df: DataFrame, seed: int = 0) -> DataFrame:
    """A shuffle that depends on the seed and ``pid`` alone, so it is the same on any cluster."""
    return with_rank(df, F.xxhash64(F.lit(seed), "pid"), F.asc("pid"), name="__pid").drop("pid").withColumnRenamed("__pid", "pid")


def label_duplicates(df: DataFrame, dimensions: str | list[str]) -> DataFrame:
    """Duplicate = 1 where all the dimensions equal those of the row before."""
    from ..plans.ordering import previous

    names = [d.strip() for d in dimensions.split(",")] if isinstance(dimensions, str) else list(dimensions)
    ranked = previous(with_rank(df), names)
    same = F.col("rank") > 0
    for n in names:
        same = same & F.col(f"`{n}`").eqNullSafe(F.col(f"`prev_{n}`"))
    old = F.col("Duplicate") if "Duplicate" in df.columns else F.lit(0)
    return ranked.withColumn("Duplicate", F.when(F.col("rank") == 0, old).otherwise(same.cast("int")).cast("smallint")).drop("rank", *[f"prev_{n}" for n in names])
