"""Row-by-row derivation of dimensions."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, ranges
from ..plans.ordering import previous, running_sum, views, with_rank
from ..schema import SPARK, checked, declared_type


def assign(df: DataFrame, value: str | list[str] = (), assignment: str | None = None, condition: str | None = None) -> DataFrame:
    """Assignments in order, each seeing the last one's result; ``condition`` is a range that gates all of them."""
    gate = ranges.condition(condition) if condition else None
    for statement in [value] if isinstance(value, str) else value:
        df = expr.assign(df, statement, gate)
    if assignment:
        target, _, number = assignment.partition("=")
        r = ranges.parse_one(target)
        where = r.column() if gate is None else r.column() & gate
        new = checked(F.lit(float(number)), declared_type(df, r.dimension), r.dimension)
        df = df.withColumn(r.dimension, F.when(where, new).otherwise(F.col(r.dimension)))
    return df


def ferry(df: DataFrame, dimensions: str) -> DataFrame:
    """Copy dimensions (``A=>B``), or make empty ones (``=>B``)."""
    pairs = [[p.strip() for p in x.split("=>")] for x in dimensions.split(",")]
    targets = [b for _, b in pairs]
    if len(set(targets)) < len(targets):
        raise ValueError("a dimension is a target twice")
    new = {}
    for a, b in pairs:
        if a == b:
            raise ValueError(f"{a} is copied to itself")
        if a and a not in df.columns:
            raise ValueError(f"no dimension {a!r}")
        kind = declared_type(df, b) if b in df.columns else declared_type(df, a) if a else "double"
        new[b] = checked(F.col(f"`{a}`").cast("double"), kind, b) if a and b in df.columns else F.col(f"`{a}`") if a else F.lit(0).cast(SPARK[kind])
    return df.withColumns(new)


def transformation(df: DataFrame, matrix: str | list[float], invert: bool = False) -> DataFrame:
    """A 4x4 row-major transform of X, Y, Z with division by the fourth coordinate."""
    m = np.array([float(x) for x in (matrix.split() if isinstance(matrix, str) else matrix)]).reshape(4, 4)
    if invert:
        m[:3] = np.linalg.inv(m)[:3]
    row = [sum((F.col(c) * float(k) for c, k in zip("XYZ", r[:3], strict=True)), F.lit(float(r[3]))) for r in m]
    return df.withColumns({c: expr.divide(row[i], row[3]) for i, c in enumerate("XYZ")})


# Entries of each shipped ramp of 256 as (place, red, green, blue). Those between lie on straight lines, within
# one unit of the shipped image.
RAMPS = {
    "pestel_shades": ((0, 0, 88, 95), (10, 12, 96, 101), (20, 27, 107, 111), (34, 54, 126, 127), (48, 84, 148, 146), (76, 150, 195, 185), (90, 182, 215, 201), (104, 210, 231, 214), (116, 230, 240, 220), (128, 245, 243, 220), (140, 255, 240, 214), (153, 255, 230, 201), (165, 255, 216, 185), (180, 255, 195, 160), (220, 255, 129, 86), (236, 255, 107, 61), (250, 255, 92, 45), (255, 255, 89, 41)),
    "awesome_green": ((0, 0, 56, 64), (35, 0, 66, 69), (89, 1, 90, 81), (180, 1, 138, 104), (221, 2, 156, 113), (255, 2, 166, 118)),
    "black_orange": ((0, 38, 38, 38), (16, 50, 38, 37), (40, 77, 38, 36), (101, 162, 39, 32), (123, 186, 42, 31), (147, 204, 50, 30), (174, 219, 65, 30), (214, 233, 89, 29), (245, 240, 104, 29), (255, 242, 107, 29)),
    "blue_hue": ((0, 0, 106, 188), (30, 12, 114, 193), (68, 35, 127, 203), (134, 85, 157, 223), (177, 118, 177, 237), (215, 143, 192, 247), (249, 159, 202, 254), (255, 161, 203, 255)),
    "blue_orange": ((0, 41, 10, 89), (23, 53, 16, 84), (51, 73, 27, 76), (88, 107, 45, 62), (178, 199, 94, 23), (215, 231, 111, 10), (245, 250, 121, 2), (255, 255, 124, 0)),
    "blue_red": ((0, 0, 0, 255), (23, 14, 0, 241), (47, 35, 0, 220), (80, 69, 0, 186), (176, 186, 0, 69), (224, 234, 0, 21), (250, 252, 0, 3), (255, 254, 0, 1)),
    "heat_map": ((0, 10, 0, 178), (10, 21, 0, 169), (22, 40, 0, 156), (40, 76, 0, 130), (85, 182, 0, 53), (106, 224, 0, 22), (119, 245, 0, 8), (128, 255, 0, 0), (139, 255, 13, 0), (153, 255, 37, 0), (171, 255, 75, 0), (214, 255, 179, 0), (230, 255, 213, 0), (245, 255, 239, 0), (255, 255, 251, 0)),
}


def ramp_table(ramp: str | list) -> list[tuple[int, int, int]]:
    """A shipped ramp's colours, halves rounded up, or a list of (red, green, blue) as it is."""
    if not isinstance(ramp, str):
        return [tuple(map(int, c)) for c in ramp]
    if ramp not in RAMPS:
        raise ValueError(f"unknown ramp {ramp!r}: one of {', '.join(RAMPS)}, or a list of colours")
    out = [RAMPS[ramp][0][1:]]
    for (p, *low), (q, *high) in itertools.pairwise(RAMPS[ramp]):
        out += [tuple(a + (2 * (b - a) * k + q - p) // (2 * (q - p)) for a, b in zip(low, high, strict=True)) for k in range(1, q - p + 1)]
    return out


def order_statistic(df: DataFrame, column: Column, *places: float) -> list[float]:
    """Exact values at the 0-based places ``int(n * p)`` of the sorted column.

    Each value's count is summed first, then ranks run over distinct values.
    """
    counts = df.select(column.cast("double").alias("v")).where(~F.isnan("v")).groupBy("v").count()
    n = counts.agg(F.sum("count")).first()[0] or 0
    if not n:
        return [math.nan] * len(places)
    ranked = running_sum(with_rank(counts, "v"), F.col("count"), "upto")
    wanted = [min(int(n * p), n - 1) for p in places]
    found = ranked.agg(*[F.min(F.when(F.col("upto") > w, F.col("v"))).alias(f"p{i}") for i, w in enumerate(wanted)]).first()
    return list(found)


def colorinterp(df: DataFrame, dimension: str = "Z", minimum: float | None = None, maximum: float | None = None, clamp: bool = False, ramp: str | list = "pestel_shades", invert: bool = False, mad: bool = False, mad_multiplier: float = 1.4862, k: float = 0.0) -> DataFrame:
    """Red, Green and Blue from a ramp between two values of a dimension; outside it rows keep their colours unless clamped."""
    c = F.col(dimension).cast("double")
    if minimum is None or maximum is None:
        if k:
            (mid,) = order_statistic(df, c, 0.5)
            spread = order_statistic(df, F.abs(c - mid), 0.5)[0] * mad_multiplier if mad else df.agg(F.stddev_samp(c)).first()[0]
            low, high = mid - k * spread, mid + k * spread
        else:
            low, high = df.agg(F.min(c), F.max(c)).first()
        minimum, maximum = low if minimum is None else minimum, high if maximum is None else maximum
    table = ramp_table(ramp)
    width = len(table)
    table = table[::-1] if invert else table
    span = float(maximum) - float(minimum)
    x = F.least(F.greatest(c, F.lit(float(minimum))), F.lit(float(maximum))) if clamp else c
    at = F.least(F.floor(expr.divide(x - float(minimum), F.lit(span)) * width), F.lit(width - 1)).cast("int")
    inside = (x >= minimum) & (x <= maximum) & ~F.isnan(x)
    new = {}
    for i, name in enumerate(("Red", "Green", "Blue")):
        old = F.col(name) if name in df.columns else F.lit(0)
        new[name] = F.when(inside, F.element_at(F.lit([t[i] for t in table]), at + 1)).otherwise(old).cast("int")
    return df.withColumns(new)


def colorization(df: DataFrame, raster: DataFrame, transform: tuple[float, float, float, float], dimensions: str = "Red:1:1.0,Green:2:1.0,Blue:3:1.0") -> DataFrame:
    """Raster bands at X, Y as dimensions. raster: col, row, band1..; transform: left, top, cell width, cell height."""
    left, top, w, h = transform
    keyed = df.withColumn("__c", F.floor((F.col("X") - left) / w).cast("int")).withColumn("__r", F.floor((F.lit(top) - F.col("Y")) / h).cast("int"))
    cells = raster.withColumnsRenamed({"col": "__c", "row": "__r"})
    joined = keyed.join(cells, ["__c", "__r"], "left")
    new = {}
    for i, d in enumerate(dimensions.split(",")):
        name, _, rest = d.strip().partition(":")
        band, _, scale = rest.partition(":")
        old = F.col(name) if name in df.columns else F.lit(0.0)
        new[name] = F.coalesce(F.col(f"band{band or i + 1}") * float(scale or 1), old.cast("double")).cast(dict(df.dtypes).get(name, "double"))
    return joined.withColumns(new).select(*df.columns, *[n for n in new if n not in df.columns])


WEEK, DAY, GPS_OFFSET = 604800.0, 86400.0, 1e9


def gps_unwrap(df: DataFrame, period: float = WEEK, tolerance: float = 1.0, column: str = "GpsTime") -> DataFrame:
    """Make wrapped times monotone: a fall of more than the tolerance begins a new period."""
    ranked = previous(with_rank(df), [column])
    fell = F.when(F.col(f"prev_{column}") - F.col(column) > tolerance, 1).otherwise(0)
    return running_sum(ranked, fell, "__wraps").withColumn(column, F.col(column) + F.col("__wraps") * period).drop("__wraps", f"prev_{column}", "rank")


def gpstimeconvert(df: DataFrame, in_time: str = "gws", out_time: str = "gt", start_date: str | None = None, wrap: bool = False, wrapped: bool = False, wrapped_tolerance: float = 1.0) -> DataFrame:
    """GpsTime among gt (GPS seconds), gst (those less 1e9), gws (week seconds) and gds (day seconds)."""
    import datetime

    t = F.col("GpsTime")
    epoch = datetime.date(1980, 1, 6)
    if in_time in ("gws", "gds"):
        if start_date is None:
            raise ValueError("start_date is needed for week and day seconds")
        day = (datetime.date.fromisoformat(start_date) - epoch).days
        period = WEEK if in_time == "gws" else DAY
        if wrapped:
            df = gps_unwrap(df, period, wrapped_tolerance)
        start = day // 7 * WEEK if in_time == "gws" else day * DAY
        gps = t + start
    else:
        gps = t + GPS_OFFSET if in_time == "gst" else t
    if out_time == "gt":
        out = gps
    elif out_time == "gst":
        out = gps - GPS_OFFSET
    else:
        period = WEEK if out_time == "gws" else DAY
        if wrap:
            out = F.pmod(gps, F.lit(period))
        else:
            least = df.agg(F.min(gps)).first()[0] or 0.0
            out = gps - math.floor(least / period) * period
    return df.withColumn("GpsTime", out)


def straighten(df: DataFrame, polyline: list[tuple[float, float, float, float]], reverse: bool = False, offset: float = 0.0) -> DataFrame:
    """Coordinates along, across and above a polyline of (x, y, z, roll); ``reverse`` undoes it."""
    spans, along = [], offset
    for (x0, y0, z0, r0), (x1, y1, z1, r1) in zip(polyline, polyline[1:], strict=False):
        length = math.hypot(x1 - x0, y1 - y0)
        spans.append((along, x0, y0, z0, r0, (x1 - x0) / length, (y1 - y0) / length, z1 - z0, r1 - r0, length))
        along += length
    names = ["m", "x", "y", "z", "r", "dx", "dy", "dz", "dr", "len"]
    literal = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, s, strict=True)]) for s in spans])
    if reverse:
        pick = F.element_at(F.filter(literal, lambda s: (F.col("X") >= s["m"]) | (s["m"] == offset)), -1)
        s = df.withColumn("__s", pick)
        t = F.col("X") - F.col("__s.m")
        f = t / F.col("__s.len")
        a = F.col("__s.r") + f * F.col("__s.dr")
        across, up = F.col("Y") * F.cos(a) - F.col("Z") * F.sin(a), F.col("Y") * F.sin(a) + F.col("Z") * F.cos(a)
        new = {"X": F.col("__s.x") + t * F.col("__s.dx") - across * F.col("__s.dy"), "Y": F.col("__s.y") + t * F.col("__s.dy") + across * F.col("__s.dx"), "Z": F.col("__s.z") + f * F.col("__s.dz") + up}
        return s.withColumns(new).drop("__s")

    def place(s: Column) -> Column:
        px, py = F.col("X") - s["x"], F.col("Y") - s["y"]
        t = F.greatest(F.lit(0.0), F.least(s["len"], px * s["dx"] + py * s["dy"]))
        d2 = F.pow(px - t * s["dx"], 2) + F.pow(py - t * s["dy"], 2)
        return F.struct(d2.alias("d2"), t.alias("t"), *[s[n].alias(n) for n in names])

    s = df.withColumn("__s", F.array_min(F.transform(literal, place)))
    f = F.col("__s.t") / F.col("__s.len")
    px, py = F.col("X") - F.col("__s.x"), F.col("Y") - F.col("__s.y")
    across = py * F.col("__s.dx") - px * F.col("__s.dy")
    up = F.col("Z") - (F.col("__s.z") + f * F.col("__s.dz"))
    a = F.col("__s.r") + f * F.col("__s.dr")
    new = {"X": F.col("__s.m") + F.col("__s.t"), "Y": across * F.cos(a) + up * F.sin(a), "Z": up * F.cos(a) - across * F.sin(a)}
    return s.withColumns(new).drop("__s")


# WGS 84.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
_E2 = WGS84_F * (2 - WGS84_F)


def geographic_to_geocentric(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude and latitude in degrees and ellipsoid height to earth-centred coordinates."""
    lon, lat = F.radians(x), F.radians(y)
    n = F.lit(WGS84_A) / F.sqrt(1 - _E2 * F.pow(F.sin(lat), 2))
    return (n + z) * F.cos(lat) * F.cos(lon), (n + z) * F.cos(lat) * F.sin(lon), (n * (1 - _E2) + z) * F.sin(lat)


def geographic_to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.radians(x) * WGS84_A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * WGS84_A


def mercator_to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)


def _krueger() -> tuple[float, list[float], list[float]]:
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    back = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3]
    return a, forward, back


def geographic_to_utm(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Krueger's series to the third order (millimetres inside a zone)."""
    a, al, _ = _krueger()
    n = WGS84_F / (2 - WGS84_F)
    lat, dl = F.radians(y), F.radians(x - (zone * 6 - 183.0))
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(lat)) - c * F.atanh(c * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e = eta + sum((F.cos(2 * j * xi) * F.sinh(2 * j * eta) * k for j, k in enumerate(al, 1)), F.lit(0.0))
    nn = xi + sum((F.sin(2 * j * xi) * F.cosh(2 * j * eta) * k for j, k in enumerate(al, 1)), F.lit(0.0))
    return e * (0.9996 * a) + 500000.0, nn * (0.9996 * a) + (0.0 if north else 1e7)


def utm_to_geographic(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    a, _, be = _krueger()
    n = WGS84_F / (2 - WGS84_F)
    xi, eta = (y - (0.0 if north else 1e7)) / (0.9996 * a), (x - 500000.0) / (0.9996 * a)
    xi1 = xi - sum((F.sin(2 * j * xi) * F.cosh(2 * j * eta) * k for j, k in enumerate(be, 1)), F.lit(0.0))
    eta1 = eta - sum((F.cos(2 * j * xi) * F.sinh(2 * j * eta) * k for j, k in enumerate(be, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    d = [2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3]
    lat = chi + sum((F.sin(2 * j * chi) * k for j, k in enumerate(d, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183.0), F.degrees(lat)


def _zone(code: str) -> tuple[int, bool] | None:
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", code)
    return (int(m[2]), m[1] == "6") if m else None


def reprojection(df: DataFrame, in_srs: str, out_srs: str, error_on_failure: bool = False) -> DataFrame:
    """X, Y, Z between EPSG:4326, 3857, 4978 (out only) and WGS 84 UTM zones, in closed form; rows that fail go, or raise."""
    x, y, z = (F.col(c).cast("double") for c in "XYZ")
    source, target = _zone(in_srs), _zone(out_srs)
    if in_srs == "EPSG:3857":
        x, y = mercator_to_geographic(x, y)
    elif source:
        x, y = utm_to_geographic(x, y, *source)
    elif in_srs != "EPSG:4326":
        raise NotImplementedError(f"no closed form here for {in_srs}")
    if out_srs == "EPSG:3857":
        x, y = geographic_to_mercator(x, y)
    elif target:
        x, y = geographic_to_utm(x, y, *target)
    elif out_srs == "EPSG:4978":
        x, y, z = geographic_to_geocentric(x, y, z)
    elif out_srs != "EPSG:4326":
        raise NotImplementedError(f"no closed form here for {out_srs}")
    fine = F.lit(True)
    for c in (x, y, z):
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = df.withColumns({"X": x, "Y": y, "Z": z, "__fine": fine})
    if error_on_failure:
        return out.withColumn("X", F.when(F.col("__fine"), F.col("X")).otherwise(F.raise_error(F.lit("a point could not be projected")).cast("double"))).drop("__fine")
    return out.where("__fine").drop("__fine")


def projpipeline(df: DataFrame, coord_op: str, reverse_transfo: bool = False) -> DataFrame:
    """A pipeline of the steps axisswap, unitconvert (deg, rad), affine offsets and scales, utm and webmerc."""
    steps = [dict((k.lstrip("+"), v) for k, _, v in (p.partition("=") for p in s.split() if p.lstrip("+"))) for s in re.split(r"\+?step", coord_op.replace("+proj=pipeline", "").replace("proj=pipeline", "")) if s.strip()]
    for s in reversed(steps) if reverse_transfo else steps:
        back = ("inv" in s) != reverse_transfo
        x, y, z = F.col("X"), F.col("Y"), F.col("Z")
        proj = s.get("proj")
        if proj == "axisswap":
            order = [int(i) for i in s["order"].split(",")]
            df = df.withColumns({c: (F.col("XYZ"[abs(i) - 1]) * (1.0 if i > 0 else -1.0)) for c, i in zip("XYZ", order, strict=False)})
        elif proj == "unitconvert":
            to_rad = (s.get("xy_in") == "deg") != back
            f = math.pi / 180 if to_rad else 180 / math.pi
            df = df.withColumns({"X": x * f, "Y": y * f})
        elif proj == "affine":
            new = {}
            for c, off, k in (("X", "xoff", "s11"), ("Y", "yoff", "s22"), ("Z", "zoff", "s33")):
                o, m = float(s.get(off, 0)), float(s.get(k, 1))
                new[c] = (F.col(c) - o) / m if back else F.col(c) * m + o
            df = df.withColumns(new)
        elif proj == "utm":
            zone, north = int(s["zone"]), "south" not in s
            if back:
                px, py = utm_to_geographic(x, y, zone, north)
                df = df.withColumns({"X": F.radians(px), "Y": F.radians(py)})
            else:
                px, py = geographic_to_utm(F.degrees(x), F.degrees(y), zone, north)
                df = df.withColumns({"X": px, "Y": py})
        elif proj == "webmerc":
            if back:
                px, py = mercator_to_geographic(x, y)
                df = df.withColumns({"X": F.radians(px), "Y": F.radians(py)})
            else:
                px, py = geographic_to_mercator(F.degrees(x), F.degrees(y))
                df = df.withColumns({"X": px, "Y": py})
        elif proj != "noop":
            raise NotImplementedError(f"step {proj!r}")
    return df


def _turn(a: Column, b: Column, f: Column) -> Column:
    """Between two angles (radians) the short way round."""
    d = F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi
    return a + d * f


def georeference(df: DataFrame, trajectory: DataFrame, time_offset: float = 0.0, keep_unposed: bool = True) -> DataFrame:
    """Scanner coordinates to geocentric ones by the pose at each point's time, interpolated between the poses around it.

    The trajectory (GpsTime, X, Y in radians, Z, Roll, Pitch, Azimuth, WanderAngle) is merged
    with the points by time; each point takes the pose before and after it.
    Points at or before the first pose or after the last have no pose: they stay as they are, or go.
    """
    names = ["GpsTime", "X", "Y", "Z", "Roll", "Pitch", "Azimuth", "WanderAngle"]
    pose = trajectory.select(F.col("GpsTime").alias("__t"), F.struct(*names).alias("__pose"))
    points = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), (F.col("GpsTime") + time_offset).alias("__t"))
    # time slots hold both tables; each slot also gets the last pose before it and the first after
    step = trajectory.agg((F.max("GpsTime") - F.min("GpsTime")) / 64).first()[0] or 1.0
    slot = F.floor(F.col("__t") / step).alias("__slot")
    pose = pose.withColumn("__slot", slot)
    edges = pose.groupBy("__slot").agg(F.max_by("__pose", "__t").alias("last"), F.min_by("__pose", "__t").alias("first"))
    around = points.withColumn("__slot", slot).select("__slot").distinct().unionByName(edges.select("__slot")).distinct().join(edges, "__slot", "left")
    order = Window.orderBy("__slot")  # a row per slot of time
    around = around.select("__slot", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    lists = pose.groupBy("__slot").agg(F.sort_array(F.collect_list("__pose")).alias("inside"))
    slots = around.join(lists, "__slot", "left").withColumn("poses", F.expr("concat(if(before is null, array(), array(before)), coalesce(inside, array()), if(after is null, array(), array(after)))"))
    p = points.withColumn("__slot", slot).join(slots.select("__slot", "poses"), "__slot", "left")
    p = p.withColumn("__i", F.expr("aggregate(poses, 0, (a, x) -> if(x.GpsTime < __t, a + 1, a))"))
    p = p.withColumn("a", F.expr("if(__i > 0, poses[__i - 1], null)")).withColumn("b", F.expr("if(__i < size(poses), poses[__i], null)"))
    posed = F.col("a").isNotNull() & F.col("b").isNotNull()
    f = (F.col("__t") - F.col("a.GpsTime")) / (F.col("b.GpsTime") - F.col("a.GpsTime"))
    lon, lat, roll, pitch, yaw, wander = (_turn(F.col(f"a.{n}"), F.col(f"b.{n}"), f) for n in ("X", "Y", "Roll", "Pitch", "Azimuth", "WanderAngle"))
    height = F.col("a.Z") + (F.col("b.Z") - F.col("a.Z")) * f
    heading = yaw - wander
    x, y, z = F.col("__row.X"), F.col("__row.Y"), F.col("__row.Z")
    x1, y1, z1 = x, y * F.cos(roll) - z * F.sin(roll), y * F.sin(roll) + z * F.cos(roll)
    x2, y2, z2 = x1 * F.cos(pitch) + z1 * F.sin(pitch), y1, z1 * F.cos(pitch) - x1 * F.sin(pitch)
    north, east, down = x2 * F.cos(heading) - y2 * F.sin(heading), x2 * F.sin(heading) + y2 * F.cos(heading), z2
    ox, oy, oz = geographic_to_geocentric(F.degrees(lon), F.degrees(lat), height)
    gx = ox - F.sin(lon) * east - F.sin(lat) * F.cos(lon) * north - F.cos(lat) * F.cos(lon) * down
    gy = oy + F.cos(lon) * east - F.sin(lat) * F.sin(lon) * north - F.cos(lat) * F.sin(lon) * down
    gz = oz + F.cos(lat) * north - F.sin(lat) * down
    if not keep_unposed:
        p = p.where(posed)
    new = {"X": gx, "Y": gy, "Z": gz}
    return p.select(*[F.when(posed, new[c]).otherwise(F.col(f"__row.{c}")).alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def where(df: DataFrame, condition: str, stage, merge: bool = True) -> DataFrame:
    """Run ``stage`` on the rows that meet the condition; the others follow untouched, or are left out."""
    c = expr.condition(df, condition)
    done = stage(df.where(c))
    return done.unionByName(df.where(~c), allowMissingColumns=True) if merge else done


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not n.startswith("_")] + ["views"]
