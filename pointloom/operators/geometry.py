"""Boxes and polygons as literal edge lists, and predicates over them."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
Polygon = list[Ring]


def parse_bounds(text: str) -> list[tuple[float, float]]:
    """``([x0,x1],[y0,y1][,[z0,z1]])`` as pairs."""
    pairs = re.findall(r"\[\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)\s*\]", text)
    if len(pairs) not in (2, 3):
        raise ValueError(f"not bounds: {text!r}")
    return [(float(a), float(b)) for a, b in pairs]


def parse_polygons(text: str) -> list[Polygon]:
    """The polygons of WKT or GeoJSON (POLYGON, MULTIPOLYGON)."""
    text = text.strip()
    if text.startswith("{"):
        g = json.loads(text)
        g = g.get("geometry", g)
        sets = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
        return [[[(float(p[0]), float(p[1])) for p in ring] for ring in poly] for poly in sets]
    kind, _, body = text.partition("(")
    body = "(" + body
    if kind.strip().upper().startswith("POLYGON"):
        body = "(" + body + ")"
    numbers = re.sub(r"([-+.\deE]+)\s+([-+.\deE]+)(?:\s+[-+.\deE]+)?", r"[\1,\2]", body)
    tree = json.loads(numbers.replace("(", "[").replace(")", "]"))
    return [[[(float(x), float(y)) for x, y in ring] for ring in poly] for poly in tree]


def edges_of(polygon: Polygon) -> list[tuple[float, float, float, float]]:
    out = []
    for ring in polygon:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        out += [(*a, *b) for a, b in zip(closed, closed[1:], strict=False)]
    return out


def edge_literal(edges) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in edges])


def inside_edges(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of edges."""

    def step(n: Column, e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"])
        return n + F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), step) % 2 == 1


def inside(polygon: Polygon, x: Column, y: Column) -> Column:
    edges = edges_of(polygon)
    xs, ys = [v for e in edges for v in (e[0], e[2])], [v for e in edges for v in (e[1], e[3])]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside_edges(edge_literal(edges), x, y)


def segment_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest of the edges."""

    def square(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.pow(x - e["x1"] - t * dx, F.lit(2)) + F.pow(y - e["y1"] - t * dy, F.lit(2))

    return F.sqrt(F.array_min(F.transform(edges, square)))


def circle(cx: float, cy: float, r: float, n: int = 64) -> Polygon:
    return [[(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n + 1)]]
