"""Splitting rows into views, and merging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.ordering import running_sum, views, with_rank
from ..schema import SPARK, declared_type, resolve_type, round_away
from ..scratch import materialize


def tile_index(value: Column, origin: float, length: float) -> Column:
    """Truncation toward zero, one lower below zero: an exact negative multiple falls a tile lower than its floor."""
    d = (value - origin) / length
    t = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))
    return F.when(value - origin < 0, t - 1).otherwise(t).cast("int")


def splitter(df: DataFrame, length: float = 1000.0, origin_x: float | None = None, origin_y: float | None = None, buffer: float = 0.0) -> DataFrame:
    """Rows with ``tile_x`` and ``tile_y``; a buffer copies rows near an edge to the tiles beside."""
    if buffer and buffer >= length / 2:
        raise ValueError("the buffer is less than half the length")
    if origin_x is None or origin_y is None:
        first = df.agg(F.min_by(F.struct("X", "Y"), "pid").alias("p")).select("p.X", "p.Y").first()
        origin_x, origin_y = first.X if origin_x is None else origin_x, first.Y if origin_y is None else origin_y
    tx, ty = tile_index(F.col("X"), origin_x, length), tile_index(F.col("Y"), origin_y, length)
    tiled = df.withColumn("tile_x", tx).withColumn("tile_y", ty)
    if not buffer:
        return tiled
    dx, dy = F.col("X") - origin_x - F.col("tile_x") * length, F.col("Y") - origin_y - F.col("tile_y") * length
    side = F.when(dx < buffer, -1).when(dx > length - buffer, 1).otherwise(0)
    level = F.when(dy < buffer, -1).when(dy > length - buffer, 1).otherwise(0)
    copies = tiled.withColumn("__sx", side).withColumn("__sy", level)
    where = F.array_distinct(F.expr("array(named_struct('x', 0, 'y', 0), named_struct('x', __sx, 'y', 0), named_struct('x', 0, 'y', __sy), named_struct('x', __sx, 'y', __sy))"))
    copies = copies.withColumn("__to", F.explode(where))
    return copies.withColumn("tile_x", F.col("tile_x") + F.col("__to.x")).withColumn("tile_y", F.col("tile_y") + F.col("__to.y")).drop("__sx", "__sy", "__to")


def divider(df: DataFrame, mode: str = "partition", count: int | None = None, capacity: int | None = None, expression: str | None = None) -> DataFrame:
    """A ``view`` of contiguous blocks, of every n-th row, or from each row that meets an expression on."""
    if mode == "expression":
        opens = F.when(expr.condition(df, expression), 1).otherwise(0)
        return running_sum(with_rank(df), opens, "view").drop("rank")
    if (count is None) == (capacity is None):
        raise ValueError("count or capacity")
    if count is not None and not 2 <= count <= 1000:
        raise ValueError("count is from 2 to 1000")
    n = df.count()
    if count is None:
        count = max(1, -(-n // capacity))
    ranked = with_rank(df)
    if mode == "round_robin":
        return ranked.withColumn("view", F.col("rank") % count).drop("rank")
    size = (n - 1) // count + 1
    return ranked.withColumn("view", F.floor(F.col("rank") / size)).drop("rank")


def groupby(df: DataFrame, dimension: str) -> DataFrame:
    """A ``view`` for each (rounded) value, in order of first appearance."""
    key = round_away(F.col(dimension).cast("double")).cast("long")
    keyed = df.withColumn("__key", key)
    firsts = keyed.groupBy("__key").agg(F.min("pid").alias("__first")) if "pid" in df.columns else keyed.select("__key").distinct().withColumn("__first", F.col("__key"))
    numbered = with_rank(firsts, "__first", name="view").drop("__first")
    return keyed.join(numbered, "__key").drop("__key")


def group_key(dimension: str) -> Column:
    return round_away(F.col(dimension).cast("double")).cast("long")


RETURN_GROUPS = {
    "first": "ReturnNumber = 1 AND NumberOfReturns > 1",
    "intermediate": "ReturnNumber > 1 AND ReturnNumber < NumberOfReturns AND NumberOfReturns > 2",
    "last": "ReturnNumber = NumberOfReturns AND NumberOfReturns > 1",
    "only": "NumberOfReturns = 1",
}


def returns(df: DataFrame, groups: list[str] = ("last",)) -> DataFrame:
    """A ``view`` for each group of returns asked for."""
    unknown = set(groups) - set(RETURN_GROUPS)
    if unknown:
        raise ValueError(f"unknown groups {sorted(unknown)}")
    label = F.coalesce(*[F.when(F.expr(RETURN_GROUPS[g]), F.lit(g)) for g in groups], F.lit(None).cast("string"))
    return df.withColumn("view", label).where("view IS NOT NULL")


def separatescanline(df: DataFrame, groupby: int = 1) -> DataFrame:
    """A new ``view`` after every ``groupby``-th row with EdgeOfFlightLine set."""
    edge = F.when(F.col("EdgeOfFlightLine") != 0, 1).otherwise(0)
    counted = running_sum(with_rank(df), edge, "__edges", inclusive=False)
    return counted.withColumn("view", F.floor(F.col("__edges") / groupby)).drop("__edges", "rank")


def chip_borders(n: int, capacity: int) -> list[int]:
    chips = max(1, -(-n // capacity))
    return [math.floor(i * n / chips + 0.5) for i in range(chips + 1)]


def chipper(df: DataFrame, capacity: int = 5000) -> DataFrame:
    """Chips of at most ``capacity`` rows: blocks are cut at fixed row counts, each time along the wider side.

    One round of window ranks per level; every round is written out, so plans stay short.
    """
    n = df.count()
    borders = chip_borders(n, capacity)
    now = materialize(df.withColumn("__lo", F.lit(0)).withColumn("__hi", F.lit(len(borders) - 1)))
    marks = F.lit(borders)
    while now.where("__hi - __lo > 1").limit(1).count():
        w = Window.partitionBy("__lo", "__hi")
        boxed = now.groupBy("__lo", "__hi").agg((F.max("X") - F.min("X")).alias("__wx"), (F.max("Y") - F.min("Y")).alias("__wy"))
        keyed = now.join(F.broadcast(boxed), ["__lo", "__hi"]).withColumn("__v", F.when(F.col("__wx") > F.col("__wy"), F.col("X")).otherwise(F.col("Y")))
        placed = keyed.withColumn("__at", F.row_number().over(w.orderBy("__v", "pid")) - 1)
        mid = F.floor((F.col("__lo") + F.col("__hi")) / 2).cast("int")
        low = F.col("__at") < F.element_at(marks, mid + 1) - F.element_at(marks, F.col("__lo") + 1)
        split = F.col("__hi") - F.col("__lo") > 1
        now = materialize(placed.withColumn("__nlo", F.when(split & ~low, mid).otherwise(F.col("__lo"))).withColumn("__hi", F.when(split & low, mid).otherwise(F.col("__hi"))).withColumn("__lo", F.col("__nlo")).drop("__nlo", "__wx", "__wy", "__v", "__at"))
    return now.withColumnRenamed("__lo", "view").drop("__hi")


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs as one view; dimensions of different types take the type that holds both."""
    kinds: dict[str, str] = {}
    for f in frames:
        for c in f.columns:
            kind = declared_type(f, c)
            kinds[c] = resolve_type(kinds[c], kind) if c in kinds else kind
    known = [f.select(*[F.col(f"`{c}`").cast(SPARK[kinds[c]]).alias(c) if dict(f.dtypes)[c] in set(SPARK.values()) else F.col(f"`{c}`") for c in f.columns]) for f in frames]
    out = known[0]
    for f in known[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.drop("view")


__all__ = ["chip_borders", "chipper", "divider", "group_key", "groupby", "merge", "returns", "separatescanline", "splitter", "tile_index", "views"]
