"""Voxels, sampling and thinning."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .neighbors import radius_pairs


def _origin(df: DataFrame, half: float = 0.0) -> tuple[float, float, float]:
    p = df.agg(F.min_by(F.struct("X", "Y", "Z"), "pid").alias("p")).select("p.*").first()
    return (p.X - half, p.Y - half, p.Z - half) if p and p.X is not None else (0.0, 0.0, 0.0)


def _keys(cell: float, origin) -> list[Column]:
    return [F.floor((F.col(c) - o) / cell).cast("long").alias(f"__k{c}") for c, o in zip("XYZ", origin, strict=True)]


_K = ["__kX", "__kY", "__kZ"]
#: Squared distances to a mean that differ by less, in squared cells, are equal but for rounding.
SAME = 1e-10
#: Rows of the first batch that darts are thrown at, and of the largest.
DARTS, MOST_DARTS = 1024, 65_536


def voxeldownsize(df: DataFrame, cell: float = 0.001, mode: str = "center") -> DataFrame:
    """The first row of each voxel, moved to its centre unless ``mode`` is first; the grid begins half a cell before the first row."""
    origin = _origin(df, cell / 2)
    keyed = df.select("*", *_keys(cell, origin))
    rows = keyed.groupBy(*_K).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "pid").alias("p")).select("p.*", *_K)
    if mode == "center":
        rows = rows.withColumns({c: (F.col(f"__k{c}") + 0.5) * cell + o for c, o in zip("XYZ", origin, strict=True)})
    return rows.drop(*_K)


def voxelcenternearestneighbor(df: DataFrame, cell: float = 1.0) -> DataFrame:
    """The row nearest to each voxel's centre; the grid begins at the least coordinates."""
    b = df.agg(*[F.min(c).alias(c) for c in "XYZ"]).first()
    origin = (b.X or 0.0, b.Y or 0.0, b.Z or 0.0)
    keyed = df.select("*", *_keys(cell, origin))
    d2 = sum((F.pow(F.col(c) - ((F.col(f"__k{c}") + 0.5) * cell + o), F.lit(2)) for c, o in zip("XYZ", origin, strict=True)), F.lit(0.0))
    return keyed.groupBy(*_K).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(d2, "pid")).alias("p")).select("p.*")


def voxelcentroidnearestneighbor(df: DataFrame, cell: float = 1.0) -> DataFrame:
    """Of one row itself, of two the nearer to the voxel's centre (the second on a tie), of more the nearest to their mean (the first on a tie).

    A mean's last digits depend on the order of its sum: rows within ``SAME`` of the least distance to it tie.
    """
    origin = _origin(df)
    keyed = df.select("*", *_keys(cell, origin))
    corner = [F.col(f"__k{c}") * cell + o for c, o in zip("XYZ", origin, strict=True)]
    sums = keyed.groupBy(*_K).agg(F.count("*").alias("__n"), *[F.avg(F.col(c) - at).alias(f"__m{c}") for c, at in zip("XYZ", corner, strict=True)])
    to_centre = sum((F.pow(F.col(c) - ((F.col(f"__k{c}") + 0.5) * cell + o), F.lit(2)) for c, o in zip("XYZ", origin, strict=True)), F.lit(0.0))
    to_mean = sum((F.pow(F.col(c) - at - F.col(f"__m{c}"), F.lit(2)) for c, at in zip("XYZ", corner, strict=True)), F.lit(0.0))
    joined = keyed.join(sums, _K).withColumn("__d2", F.when(F.col("__n") == 2, to_centre).otherwise(to_mean))
    least = joined.groupBy(*_K).agg(F.min("__d2").alias("__least"))
    slack = F.when(F.col("__n") == 2, 0.0).otherwise(SAME * cell * cell)
    near = joined.join(least, _K).where(F.col("__d2") <= F.col("__least") + slack)
    tie = F.when(F.col("__n") == 2, -F.col("pid")).otherwise(F.col("pid"))
    return near.groupBy(*_K).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), tie).alias("p")).select("p.*")


def greedy(points: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """The rows that a pass in ``order`` accepts, when an accepted row shuts out its neighbours.

    Rounds: a row with no undecided neighbour before it is accepted, its neighbours go. Every
    round decides at least the first of each open group, and gives what one sequential pass would.
    points: pid and the order column; pairs: pid, nid (both ways). Returns the accepted pid.
    """
    open_ = materialize(points.select("pid", F.col(order).alias("o")))
    edges = materialize(pairs.select("pid", "nid").where("pid != nid"))
    accepted = None
    while not open_.isEmpty():
        live = edges.join(open_.select("pid", "o"), "pid").join(open_.select(F.col("pid").alias("nid"), F.col("o").alias("no")), "nid")
        live = live.withColumn("before", F.struct("no", "nid") < F.struct("o", "pid"))
        shut = live.where("before").select("pid").distinct()
        first = materialize(open_.join(shut, "pid", "left_anti").select("pid"))
        gone = edges.join(first, "pid").select(F.col("nid").alias("pid")).unionByName(first).distinct()
        open_ = materialize(open_.join(gone, "pid", "left_anti"))
        accepted = first if accepted is None else accepted.unionByName(first)
    return accepted if accepted is not None else points.select("pid").limit(0)


def sample(df: DataFrame, radius: float | None = None, cell: float | None = None, dimension: str | None = None) -> DataFrame:
    """Poisson-disk thinning in row order: a row stays unless one that stays lies nearer than the radius."""
    if (radius is None) == (cell is None):
        raise ValueError("radius or cell")
    r = radius if radius is not None else cell * math.sqrt(3) / 2
    kept = greedy(df.select("pid", F.col("pid").alias("o")), radius_pairs(df, df, r, 3), "o")
    if dimension:
        return df.join(kept.withColumn("__kept", F.lit(1)), "pid", "left").withColumn(dimension, F.coalesce("__kept", F.lit(0))).drop("__kept")
    return df.join(kept, "pid", "left_semi")


def accepted(xyz: np.ndarray, radius: float) -> list[int]:
    """The rows that a pass in their order accepts: those not nearer than the radius to one accepted before."""
    out: list[int] = []
    held: dict[tuple[int, int, int], list[tuple[float, float, float]]] = {}
    around = list(itertools.product((-1, 0, 1), repeat=3))
    for i, (x, y, z) in enumerate(xyz.tolist()):
        if not (math.isfinite(x) and math.isfinite(y) and math.isfinite(z)):
            out.append(i)
            continue
        a, b, c = math.floor(x / radius), math.floor(y / radius), math.floor(z / radius)
        if not any((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w) < radius * radius for i0, i1, i2 in around for u, v, w in held.get((a + i0, b + i1, c + i2), ())):
            held.setdefault((a, b, c), []).append((x, y, z))
            out.append(i)
    return out


def _darts(rest: DataFrame, radius: float, want: int) -> list[int]:
    """The first ``want`` pid that a pass in the order of (__o, pid) accepts.

    The driver passes over one batch of the first rows after the other; only rows of no accepted one's neighbourhood stay for the next.
    """
    got: list[int] = []
    size = DARTS
    while True:
        batch = rest.orderBy("__o", "pid").limit(size).toPandas()
        new = batch.iloc[accepted(batch[["X", "Y", "Z"]].to_numpy(float), radius)[: want - len(got)]]
        got += new["pid"].tolist()
        if len(got) >= want or len(batch) < size:
            return got
        rest = rest.where(F.struct("__o", "pid") > F.struct(*[F.lit(int(batch[c].iloc[-1])).cast("long").alias(c) for c in ("__o", "pid")]))
        near = radius_pairs(rest, rest.sparkSession.createDataFrame(new, rest.schema), radius, 3).select("pid").distinct()
        rest = materialize(rest.join(near, "pid", "left_anti"))
        size = min(2 * size, MOST_DARTS)


def relaxationdartthrowing(df: DataFrame, count: int = 1000, radius: float = 1.0, decay: float = 0.9, terminal_radius: float = 0.001, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Poisson-disk thinning with ever smaller radii until ``count`` rows stay, in a (seeded) random order."""
    order = F.xxhash64(F.lit(seed), "pid") if shuffle else F.col("pid")
    points = materialize(df.select(F.col("pid").cast("long"), *[F.col(c).cast("double").alias(c) for c in "XYZ"], order.cast("long").alias("__o")))
    chosen, have, r = None, 0, radius
    while have < count and r >= terminal_radius:
        rest = points if chosen is None else points.join(chosen, "pid", "left_anti")
        if chosen is not None:
            near = radius_pairs(rest, points.join(chosen, "pid", "left_semi"), r, 3).select("pid").distinct()
            rest = materialize(rest.join(near, "pid", "left_anti"))
        new = _darts(rest, r, count - have)
        if new:
            more = materialize(df.sparkSession.createDataFrame(pd.DataFrame({"pid": new}), "pid long"))
            chosen = more if chosen is None else chosen.unionByName(more)
            have += len(new)
        r *= decay
    return df.join(chosen, "pid", "left_semi") if chosen is not None else df.limit(0)


def farthest_points(df: DataFrame, count: int, columns: list[str]) -> list:
    """Rows chosen one by one, each farthest from those before (the first is the first row). The distances stay distributed."""
    now = materialize(df.select("pid", *columns).withColumn("__d", F.lit(float("inf"))))
    picks = [now.orderBy("pid").limit(1).first()]
    if picks[0] is None:
        return []
    total, every = now.count(), 16
    d = F.col("__d")
    while len(picks) < min(count, total):
        d = F.least(d, sum((F.pow(F.col(c) - float(picks[-1][c]), F.lit(2)) for c in columns), F.lit(0.0)))
        now = now.withColumn("__d", d)
        d = F.col("__d")
        if len(picks) % every == 0:
            now = materialize(now)
        picks.append(now.orderBy(F.desc("__d"), "pid").limit(1).first())
    return picks


def fps(df: DataFrame, count: int = 1000) -> DataFrame:
    """Farthest-point sampling seeded by the first row; one job a pick."""
    ids = [p.pid for p in farthest_points(df, count, ["X", "Y", "Z"])]
    return df.where(F.col("pid").isin(ids)) if ids else df.limit(0)


__all__ = ["Window", "farthest_points", "fps", "greedy", "relaxationdartthrowing", "sample", "voxelcenternearestneighbor", "voxelcentroidnearestneighbor", "voxeldownsize"]
