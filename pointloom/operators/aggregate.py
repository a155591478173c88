"""Statistics, per-expression counts, summaries, hexagons, grids and rasters."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from .pointwise import order_statistic
from .select import region_conditions

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def dimensions_of(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in ("pid", "view")]


def stats(df: DataFrame, dimensions: str | list[str] | None = None, advanced: bool = False, global_: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per dimension (and group): count, minimum, maximum, average, sample variance and deviation.

    ``advanced`` adds sample skewness and sample excess kurtosis, ``global_`` the upper median and
    its median deviation. One pass over all dimensions, partial sums first.
    """
    names = dimensions.split(",") if isinstance(dimensions, str) else dimensions or dimensions_of(df)
    parts = []
    for d in names:
        c = F.col(d.strip()).cast("double")
        n = F.count(c).cast("double")
        fields = [F.lit(d.strip()).alias("dimension"), F.count(c).cast("long").alias("count"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.avg(c).alias("average"), F.var_samp(c).alias("variance"), F.stddev_samp(c).alias("stddev")]
        if advanced:
            flat = F.coalesce(F.var_pop(c), F.lit(0.0)) == 0
            skew = F.when(flat | (n < 3), 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
            kurt = F.when(flat | (n < 4), 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (F.kurtosis(c) + 3) - 3 * (n - 1)))
            fields += [skew.alias("skewness"), kurt.alias("kurtosis")]
        parts.append(F.struct(*fields))
    one = df.groupBy(*by).agg(F.array(*parts).alias("s")) if by else df.agg(F.array(*parts).alias("s"))
    out = one.select(*by, F.inline("s"))
    if global_:
        mids = {}
        for d in names:
            c = F.col(d.strip()).cast("double")
            (mid,) = order_statistic(df, c, 0.5)
            mids[d.strip()] = (mid, order_statistic(df, F.abs(c - mid), 0.5)[0])
        pick = lambda i: F.coalesce(*[F.when(F.col("dimension") == d, F.lit(float(v[i]))) for d, v in mids.items()])
        out = out.withColumn("median", pick(0)).withColumn("mad", pick(1))
    return out


def stats_values(df: DataFrame, dimension: str) -> DataFrame:
    """Distinct values of a dimension with their counts."""
    return df.groupBy(F.col(dimension).cast("double").alias("value")).agg(F.count("*").cast("long").alias("count"))


def expressionstats(df: DataFrame, dimension: str, expressions: str | list[str]) -> DataFrame:
    """For each expression, the values of a dimension among its rows, with counts; an expression that no row meets has one row of nulls."""
    texts = list(dict.fromkeys([expressions] if isinstance(expressions, str) else expressions))
    matched = F.array_compact(F.array(*[F.when(expr.condition(df, t), F.lit(i)) for i, t in enumerate(texts)]))
    counts = df.select(F.col(dimension).cast("double").alias("value"), F.explode(matched).alias("id")).groupBy("id", "value").agg(F.count("*").cast("long").alias("count"))
    names = df.sparkSession.createDataFrame(list(enumerate(texts)), "id int, expression string")
    return names.join(counts, "id", "left").drop("id")


def info(df: DataFrame) -> DataFrame:
    """One row: count and bounds."""
    return df.agg(F.count("*").cast("long").alias("count"), *[f(c).alias(f"{n}{c.lower()}") for c in "XYZ" for n, f in (("min", F.min), ("max", F.max))])


def info_points(df: DataFrame, point: str) -> DataFrame:
    """Rows by 0-based ordinals and ranges, such as ``0,3,10-12``."""
    from ..plans.ordering import with_rank

    parts = [p.strip().split("-") for p in point.split(",")]
    wanted = F.lit(False)
    for p in parts:
        wanted = wanted | F.col("rank").between(int(p[0]), int(p[-1]))
    return with_rank(df).where(wanted).drop("rank")


def info_query(df: DataFrame, query: str) -> DataFrame:
    """The nearest rows to a place: ``x,y[,z][/count]``."""
    place, _, count = query.partition("/")
    xyz = [float(v) for v in re.split(r"[,\s]+", place.strip())]
    d2 = sum((F.pow(F.col(c) - v, F.lit(2)) for c, v in zip("XYZ", xyz, strict=False)), F.lit(0.0))
    return df.orderBy(d2, "pid").limit(int(count or 10))


def hex_cell(x: Column, y: Column, height: float, origin: tuple[float, float]) -> tuple[Column, Column]:
    """Column and row of the flat-topped hexagon of a point; odd columns lie half a height lower."""
    width = 3 / (2 * math.sqrt(3)) * height
    cx, cy = x - origin[0], y - origin[1]
    col = F.floor(cx / width)
    odd = F.pmod(col, F.lit(2)) != 0
    yy = F.when(odd, cy - height / 2).otherwise(cy)
    row = F.floor(yy / height)
    # in the last third of a column the slanted edges cut the corners off
    xr = cx - col * width - width * 2 / 3
    yr = yy - row * height
    half = height / 2
    slope = half / (width / 3)
    upper = (xr > 0) & (yr - half > half - slope * xr)
    lower = (xr > 0) & (half - yr > half - slope * xr)
    up_row = F.when(odd, row + 1).otherwise(row)
    low_row = F.when(odd, row).otherwise(row - 1)
    return F.when(upper | lower, col + 1).otherwise(col), F.when(upper, up_row).when(lower, low_row).otherwise(row)


def hexbin(df: DataFrame, edge_length: float | None = None, threshold: int = 15, sample_size: int = 5000, origin: tuple[float, float] | None = None) -> DataFrame:
    """hex_x, hex_y and the count of each hexagon, and whether it is dense."""
    if edge_length is None:
        rows = df.orderBy("pid").limit(sample_size).select("X", "Y").collect()
        steps = sum(math.hypot(a.X - b.X, a.Y - b.Y) for a, b in zip(rows, rows[1:], strict=False))
        height = threshold * steps / max(1, len(rows)) or 1.0
    else:
        height = edge_length * math.sqrt(3)
    if origin is None:
        p = df.agg(F.min_by(F.struct("X", "Y"), "pid").alias("p")).select("p.*").first()
        origin = (p.X, p.Y)
    hx, hy = hex_cell(F.col("X"), F.col("Y"), height, origin)
    return df.groupBy(hx.cast("long").alias("hex_x"), hy.cast("long").alias("hex_y")).agg(F.count("*").cast("long").alias("count")).withColumn("dense", F.col("count") >= threshold)


def hex_polygon(hx: int, hy: int, height: float, origin: tuple[float, float]) -> list[tuple[float, float]]:
    """The corners of a hexagon, anticlockwise."""
    width = 3 / (2 * math.sqrt(3)) * height
    x = origin[0] + hx * width
    y = origin[1] + hy * height + (height / 2 if hx % 2 else 0)
    return [(x, y), (x + width * 2 / 3, y), (x + width, y + height / 2), (x + width * 2 / 3, y + height), (x, y + height), (x - width / 3, y + height / 2)]


def hex_boundary(cells: DataFrame, height: float, origin: tuple[float, float], most: int = 1_000_000) -> str:
    """WKT of the border of the dense hexagons: edges that two cells share cancel, the rest are chained to rings.

    The dense cells come to the driver, so their number is checked.
    """
    dense = cells.where("dense").select("hex_x", "hex_y").limit(most + 1).collect()
    if len(dense) > most:
        raise ValueError(f"more than {most} dense hexagons; use longer edges")
    key = lambda p: (round(p[0], 6), round(p[1], 6))
    edges: dict[tuple, tuple] = {}
    for c in dense:
        corners = [key(p) for p in hex_polygon(c.hex_x, c.hex_y, height, origin)]
        for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
            if (b, a) in edges:
                del edges[b, a]
            else:
                edges[a, b] = (a, b)
    after: dict[tuple, list] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    rings = []
    while after:
        start = next(iter(after))
        ring = [start]
        while True:
            b = after[ring[-1]].pop()
            if not after[ring[-1]]:
                del after[ring[-1]]
            ring.append(b)
            if b == start:
                break
        rings.append(ring)
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2
    shells, holes = [r for r in rings if area(r) > 0], [r for r in rings if area(r) <= 0]

    def within(p, ring) -> bool:
        n = 0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1):
                n += 1
        return n % 2 == 1

    text = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r) + ")"
    polygons = []
    for s in shells:
        inner = [h for h in holes if within(((h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2), s)]
        polygons.append("(" + ", ".join(map(text, [s, *inner])) + ")")
    return "MULTIPOLYGON (" + ", ".join(polygons) + ")" if polygons else "MULTIPOLYGON EMPTY"


def grid_decimation(df: DataFrame, resolution: float = 1.0, output_type: str = "max", value: str | list[str] = ()) -> DataFrame:
    """Statements run on the first highest (or lowest) row of each cell alone; all rows stay."""
    cell = [F.floor(F.col(c) / resolution) for c in "XY"]
    best = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("Z") if output_type == "max" else F.col("Z"), "pid")) == 1
    df = df.withColumn("__best", best)
    for s in [value] if isinstance(value, str) else value:
        df = expr.assign(df, s, F.col("__best"))
    return df.drop("__best")


OUTPUTS = ("min", "max", "mean", "idw", "count", "stdev")


def rasterize(df: DataFrame, resolution: float, radius: float | None = None, power: float = 1.0, output_type: str | list[str] = "all", binmode: bool = False, window_size: int = 0, dimension: str = "Z", bounds: str | None = None, origin: tuple[float, float] | None = None) -> DataFrame:
    """Cells (col, row from the lower left) with minimum, maximum, mean, inverse-distance mean, count, population deviation and percentiles (``p90``).

    Without ``binmode`` a point counts in every cell whose centre is nearer than the radius (resolution times sqrt 2).
    ``window_size`` fills empty cells from those around, weighted by one over the larger of the two cell distances.
    """
    outputs = list(OUTPUTS) if output_type == "all" else [output_type] if isinstance(output_type, str) else list(output_type)
    if bounds:
        df = df.where(region_conditions(bounds)[0])
    if origin is None:
        low = df.agg(F.min("X").alias("x"), F.min("Y").alias("y")).first()
        origin = (low.x, low.y)
    x, y, z = F.col("X") - origin[0], F.col("Y") - origin[1], F.col(dimension).cast("double")
    if binmode:
        cells = df.select(F.floor(x / resolution).cast("int").alias("col"), F.floor(y / resolution).cast("int").alias("row"), z.alias("v"), F.lit(1.0).alias("d"))
    else:
        r = resolution * math.sqrt(2) if radius is None else radius
        reach = lambda c: F.sequence(F.ceil((c - r) / resolution - 0.5), F.floor((c + r) / resolution - 0.5))
        near = df.select(x.alias("x"), y.alias("y"), z.alias("v"), F.explode(reach(x)).alias("col")).select("*", F.explode(reach(F.col("y"))).alias("row"))
        d = F.sqrt(F.pow(F.col("x") - (F.col("col") + 0.5) * resolution, 2) + F.pow(F.col("y") - (F.col("row") + 0.5) * resolution, 2))
        cells = near.withColumn("d", d).where(F.col("d") < r).where("col >= 0 AND row >= 0").select(F.col("col").cast("int"), F.col("row").cast("int"), "v", "d")
    weight = F.when(F.col("d") > 0, F.pow(F.col("d"), F.lit(-float(power))))
    on_centre = F.min(F.when(F.col("d") == 0, F.col("v")))
    made = {
        "min": F.min("v"), "max": F.max("v"), "mean": F.avg("v"), "count": F.count("*").cast("double"), "stdev": F.stddev_pop("v"),
        "idw": F.coalesce(on_centre, F.sum(F.col("v") * weight) / F.sum(weight)),
    }
    for o in outputs:
        if re.fullmatch(r"p\d+(\.\d+)?", o):
            made[o] = F.percentile("v", float(o[1:]) / 100)
    out = cells.groupBy("col", "row").agg(*[made[o].alias(o) for o in outputs])
    if not window_size:
        return out
    steps = F.sequence(F.lit(-window_size), F.lit(window_size))
    around = out.select("*", F.explode(steps).alias("dc")).select("*", F.explode(steps).alias("dr")).where("dc != 0 OR dr != 0")
    w = 1.0 / F.greatest(F.abs("dc"), F.abs("dr"))
    limits = out.agg(F.max("col").alias("mc"), F.max("row").alias("mr")).first()
    target = around.select((F.col("col") + F.col("dc")).alias("col"), (F.col("row") + F.col("dr")).alias("row"), w.alias("w"), *outputs).where((F.col("col") >= 0) & (F.col("row") >= 0) & (F.col("col") <= (limits.mc or 0)) & (F.col("row") <= (limits.mr or 0)))
    filled = target.join(out.select("col", "row"), ["col", "row"], "left_anti").groupBy("col", "row").agg(*[(F.sum(F.col(o) * F.col("w")) / F.sum("w")).alias(o) for o in outputs])
    return out.unionByName(filled)
