"""Predicates, row selection, limits and top-k."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, mongo, ranges
from ..plans.ordering import views, with_rank
from . import geometry
from .pointwise import order_statistic


def range_filter(df: DataFrame, limits: str) -> DataFrame:
    return df.where(ranges.condition(limits))


def _views_of(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """A copy of each row for every condition it meets, numbered by ``view``."""
    matched = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]))
    return df.withColumn("view", F.explode(matched))


def expression(df: DataFrame, expression: str | list[str]) -> DataFrame:
    """Rows that meet one condition; several conditions give a view each."""
    if isinstance(expression, str):
        return df.where(expr.condition(df, expression))
    return _views_of(df, [expr.condition(df, e) for e in expression])


def mongo_filter(df: DataFrame, expression: str | dict) -> DataFrame:
    return df.where(mongo.condition(df, expression))


def region_conditions(bounds: str | list[str] = (), polygon: str | list[str] = (), point: list[tuple[float, ...]] = (), distance: float | None = None) -> list[Column]:
    """A condition for each closed box, polygon and open disc or ball."""
    x, y, z = F.col("X"), F.col("Y"), F.col("Z")
    out = []
    for b in [bounds] if isinstance(bounds, str) else bounds:
        pairs = geometry.parse_bounds(b)
        out.append(reduce(lambda p, q: p & q, (c.between(*r) for c, r in zip((x, y, z), pairs, strict=False))))
    for p in [polygon] if isinstance(polygon, str) else polygon:
        out += [geometry.inside(g, x, y) for g in geometry.parse_polygons(p)]
    for p in point:
        d2 = sum((F.pow(c - float(v), F.lit(2)) for c, v in zip((x, y, z), p, strict=False)), F.lit(0.0))
        out.append(d2 < float(distance) ** 2)
    return out


def crop(df: DataFrame, bounds=(), polygon=(), point=(), distance: float | None = None, outside: bool = False, stream: bool = False) -> DataFrame:
    """Rows inside (or outside) regions. One region filters; several give a view each, or in stream mode rows that any accepts."""
    conditions = [~c if outside else c for c in region_conditions(bounds, polygon, point, distance)]
    if not conditions:
        raise ValueError("crop needs bounds, a polygon, or a point and a distance")
    if len(conditions) == 1:
        return df.where(conditions[0])
    return df.where(reduce(lambda a, b: a | b, conditions)) if stream else _views_of(df, conditions)


def dem(df: DataFrame, raster: DataFrame, transform: tuple[float, float, float, float], limits: str = "Z[1:1]", band: int = 1) -> DataFrame:
    """Rows whose dimension lies from ``lower`` below the raster to ``upper`` above it; ``Z[lower:upper]``."""
    r = ranges.parse_one(limits)
    left, top, w, h = transform
    keyed = df.withColumn("__c", F.floor((F.col("X") - left) / w).cast("int")).withColumn("__r", F.floor((F.lit(top) - F.col("Y")) / h).cast("int"))
    joined = keyed.join(raster.select(F.col("col").alias("__c"), F.col("row").alias("__r"), F.col(f"band{band}").alias("__v")), ["__c", "__r"])
    v = F.col(r.dimension).cast("double")
    return joined.where((v >= F.col("__v") - (r.low or 0.0)) & (v <= F.col("__v") + (r.high or 0.0))).select(*df.columns)


def iqr(df: DataFrame, dimension: str, k: float = 1.5) -> DataFrame:
    """Rows strictly inside the quartiles (order statistics) widened by k of their distance."""
    c = F.col(dimension).cast("double")
    q1, q3 = order_statistic(df, c, 0.25, 0.75)
    return df.where((c > q1 - k * (q3 - q1)) & (c < q3 + k * (q3 - q1)))


def mad(df: DataFrame, dimension: str, k: float = 2.0, mad_multiplier: float = 1.4862) -> DataFrame:
    """Rows nearer than k scaled median deviations to the upper median; a deviation of zero drops all."""
    c = F.col(dimension).cast("double")
    (mid,) = order_statistic(df, c, 0.5)
    spread = order_statistic(df, F.abs(c - mid), 0.5)[0] * mad_multiplier
    return df.where(F.abs(c - mid) / spread < k) if spread and not math.isnan(spread) else df.limit(0)


def decimation(df: DataFrame, step: float = 1.0, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows at ``offset + round(i * step)``; none where the offset is behind the last row."""
    if step < 1:
        raise ValueError("step is at least 1")
    r = F.col("rank") - offset
    ranked = with_rank(df)
    inside = r >= 0
    if limit is not None:
        inside = inside & (F.col("rank") < limit)
    if float(step).is_integer():
        return ranked.where(inside & (r % int(step) == 0)).drop("rank")
    i = F.round(r / step)
    # the count is rounded too: round((n - offset) / step) rows at most
    sizes = df.groupBy(*views(df)).agg(F.count("*").alias("__n"))
    n = F.least(F.col("__n"), F.lit(limit)) if limit is not None else F.col("__n")
    joined = ranked.join(F.broadcast(sizes), views(df)) if views(df) else ranked.crossJoin(F.broadcast(sizes))  # one row
    return joined.where(inside & (F.round(i * step) == r) & (i < F.round((n - offset) / step))).drop("rank", "__n")


def head(df: DataFrame, count: int = 10, invert: bool = False) -> DataFrame:
    if not views(df) and not invert:
        return df.orderBy("pid").limit(count)
    return with_rank(df).where(F.col("rank") >= count if invert else F.col("rank") < count).drop("rank")


def tail(df: DataFrame, count: int = 10, invert: bool = False) -> DataFrame:
    if not views(df) and not invert:
        return df.orderBy(F.desc("pid")).limit(count)
    return with_rank(df, F.desc("pid")).where(F.col("rank") >= count if invert else F.col("rank") < count).drop("rank")


def locate(df: DataFrame, dimension: str, minmax: str = "max") -> DataFrame:
    """The first row with the least or largest value; NaN is never it, unless all are NaN: then the first row."""
    c = F.col(dimension).cast("double")
    nan_last = F.isnan(c).cast("int")
    value = F.when(F.isnan(c), F.lit(0.0)).otherwise(c)
    order = [nan_last, value.desc() if minmax == "max" else value, F.col("pid")]
    if views(df):
        return df.withColumn("__n", F.row_number().over(Window.partitionBy("view").orderBy(*order))).where("__n = 1").drop("__n")
    return df.orderBy(*order).limit(1)


def overlay(df: DataFrame, polygons: DataFrame, dimension: str, column: str = "value") -> DataFrame:
    """A dimension from the first polygon (by ``id``) that contains the point; other rows keep theirs.

    polygons: id, value, edges (array of struct x1, y1, x2, y2), few enough to be sent to all (checked);
    more are joined by the grid cells their boxes cover.
    """
    boxes = polygons.select("id", F.col(column).alias("__value"), "edges", F.expr("array_min(transform(edges, e -> least(e.x1, e.x2)))").alias("x0"), F.expr("array_max(transform(edges, e -> greatest(e.x1, e.x2)))").alias("x1"), F.expr("array_min(transform(edges, e -> least(e.y1, e.y2)))").alias("y0"), F.expr("array_max(transform(edges, e -> greatest(e.y1, e.y2)))").alias("y1"))
    size = boxes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.sum(F.size("edges"))).first()
    w = float(size[0] or 1.0) or 1.0

    def cells(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(a) / w), F.floor(F.col(b) / w))

    keyed = boxes.select("*", F.explode(cells("x0", "x1")).alias("__cx")).select("*", F.explode(cells("y0", "y1")).alias("__cy"))
    keyed = F.broadcast(keyed) if (size[1] or 0) < 100_000 else keyed
    x, y = F.col("X"), F.col("Y")
    rows = df.withColumn("__cx", F.floor(x / w)).withColumn("__cy", F.floor(y / w)).withColumn("__row", F.monotonically_increasing_id() if "pid" not in df.columns else F.col("pid"))
    hits = rows.join(keyed, ["__cx", "__cy"]).where(x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")) & geometry.inside_edges(F.col("edges"), x, y))
    best = hits.groupBy("__row").agg(F.min_by("__value", "id").alias("__value"))
    old = F.col(dimension) if dimension in df.columns else F.lit(0)
    kept = [c for c in df.columns if c != dimension]
    return rows.join(best, "__row", "left").select(*kept, F.coalesce("__value", old).alias(dimension))


def geomdistance(df: DataFrame, geometry_text: str, dimension: str = "distance", ring: bool = False) -> DataFrame:
    """Distance to polygons: 0 inside them, unless the ring itself is meant."""
    x, y = F.col("X"), F.col("Y")
    polygons = geometry.parse_polygons(geometry_text)
    d = F.least(*[geometry.segment_distance(geometry.edge_literal(geometry.edges_of(p)), x, y) for p in polygons], F.lit(float("inf")))
    if not ring:
        d = F.when(reduce(lambda a, b: a | b, (geometry.inside(p, x, y) for p in polygons)), 0.0).otherwise(d)
    return df.withColumn(dimension, d)


def streamcallback(df: DataFrame, callback) -> DataFrame:
    """Rows that a Python callback keeps: it gets a pandas frame and returns booleans."""

    def run(frames):
        for f in frames:
            yield f[callback(f)]

    return df.mapInPandas(run, df.schema)
