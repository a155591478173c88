"""Meshes: triangulation, greedy surfaces, and their rasters."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Rows of a leaf in the search for neighbours.
LEAF = 64


def _orient(a, b, c) -> float:
    """Positive where a, b and c turn left; exact in its sign."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det = left - right
    if abs(det) > 4e-16 * (abs(left) + abs(right)):
        return det
    if a == b or b == c or a == c:
        return 0.0
    (ax, ay), (bx, by), (cx, cy) = (tuple(map(Fraction, v)) for v in (a, b, c))
    det = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return float((det > 0) - (det < 0))


def _in_circle(a, b, c, d) -> float:
    """Positive where d lies inside the circle of a, b and c, which turn left; exact in its sign."""
    dx, dy = d
    ax, ay, bx, by, cx, cy = a[0] - dx, a[1] - dy, b[0] - dx, b[1] - dy, c[0] - dx, c[1] - dy
    bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    al, bl, cl = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = al * (bc - cb) + bl * (ca - ac) + cl * (ab - ba)
    if abs(det) > 1.2e-15 * ((abs(bc) + abs(cb)) * al + (abs(ca) + abs(ac)) * bl + (abs(ab) + abs(ba)) * cl):
        return det
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(v[0]) - Fraction(dx), Fraction(v[1]) - Fraction(dy)) for v in (a, b, c))
    det = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    return float((det > 0) - (det < 0))


def triangulate(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles of points in the plane, by insertion: triangles whose circle holds the new point make room for a fan around it.

    The first of these is found by a walk from a point near the new one, the others across their edges. Outside the hull
    each edge has a triangle with a point at infinity, 0 here (others count from 1). Signs are exact; a point in a place that is taken is left out.
    """
    first: dict[tuple[float, float], int] = {}
    p: list[tuple[float, float]] = [(math.nan, math.nan), *map(tuple, xy.tolist())]
    for i in range(1, len(p)):
        if math.isfinite(p[i][0]) and math.isfinite(p[i][1]):
            first.setdefault((p[i][0] + 0.0, p[i][1] + 0.0), i)
    todo = list(first.values())
    third = next((k for k in range(2, len(todo)) if _orient(p[todo[0]], p[todo[1]], p[todo[k]]) != 0), None)
    if third is None:
        return []
    start = [todo[0], todo[1], todo.pop(third)]
    if _orient(*(p[i] for i in start)) < 0:
        start = [start[1], start[0], start[2]]
    m = len(p)
    apex: dict[int, int] = {}  # the third corner of the triangle to the left of an edge
    out = [0] * m  # the end of some edge from each point
    live: dict[tuple[int, int, int], int] = {}  # triangles, their largest point last, by the number of their making
    made = 0

    def turned(a: int, b: int, c: int) -> tuple[int, int, int]:
        return (a, b, c) if c > a and c > b else (b, c, a) if a > b else (c, a, b)

    def add(a: int, b: int, c: int) -> None:
        nonlocal made
        apex[a * m + b], apex[b * m + c], apex[c * m + a] = c, a, b
        out[a], out[b], out[c] = b, c, a
        live[turned(a, b, c)] = made
        made += 1

    def holds(a: int, b: int, c: int, q) -> bool:
        """Whether the triangle's circle holds q; outside the hull, its edge's outer side, or the edge."""
        if a and b and c:
            return _in_circle(p[a], p[b], p[c], q) > 0
        u, v = (a, b) if not c else (b, c) if not a else (c, a)
        side = _orient(p[u], p[v], q)
        return side > 0 or (side == 0 and min(p[u], p[v]) < q < max(p[u], p[v]))

    a, b, c = start
    for t in ((a, b, c), (b, a, 0), (c, b, 0), (a, c, 0)):
        add(*t)
    x0, y0 = min(q[0] for q in first), min(q[1] for q in first)
    wide = max(max(q[0] for q in first) - x0, max(q[1] for q in first) - y0)
    deep = max(0, int(math.log2(len(todo) + 1) / 2))
    grids: list[dict[int, int]] = [{} for _ in range(deep + 1)]  # the last point of each square, from one square to about one a point
    scale = [(1 << level) * (1 - 1e-9) / wide for level in range(deep + 1)]

    def seen(i: int) -> None:
        x, y = p[i][0] - x0, p[i][1] - y0
        for g, s in zip(grids, scale, strict=True):
            g[int(x * s) << 32 | int(y * s)] = i

    for i in start:
        seen(i)
    for i in todo:
        if i in start:
            continue
        q = p[i]
        x, y = q[0] - x0, q[1] - y0
        for level in range(deep, -1, -1):
            a = grids[level].get(int(x * scale[level]) << 32 | int(y * scale[level]), 0)
            if a:
                break
        b = out[a]
        c = apex[a * m + b]
        if not (a and b and c):  # begin inside the hull
            a, b = (b, a) if not c else (c, b) if not a else (a, c)
            c = apex[a * m + b]
        while c:
            if _orient(p[b], p[c], q) < 0:
                a, b = c, b
            elif _orient(p[c], p[a], q) < 0:
                a, b = a, c
            elif _orient(p[a], p[b], q) < 0:
                a, b = b, a
            else:
                break
            c = apex[a * m + b]
        bad = {turned(a, b, c)}
        edge = [(b, a), (c, b), (a, c)]
        while edge:
            u, v = edge.pop()
            w = apex[u * m + v]
            t = turned(u, v, w)
            if t not in bad and holds(u, v, w, q):
                bad.add(t)
                edge += [(w, v), (u, w)]
        rim: dict[tuple[int, int], int] = {}
        for t in sorted(bad, key=live.__getitem__):
            a, b, c = t
            for e in ((a, b), (b, c), (c, a)):
                if (e[1], e[0]) in rim:
                    del rim[e[1], e[0]]
                else:
                    rim[e] = 1
        for a, b, c in bad:
            del live[a, b, c], apex[a * m + b], apex[b * m + c], apex[c * m + a]
        for a, b in rim:
            add(a, b, i)
        seen(i)
    return [(a - 1, b - 1, c - 1) for a, b, c in live if a and b]


def _mesh(df: DataFrame, fn, columns: list[str]) -> DataFrame:
    ship(df.sparkSession)
    keyed = df.select("pid", *columns, F.col("view").alias("view") if "view" in df.columns else F.lit(0).alias("view"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pid").reset_index(drop=True)
        ids = f["pid"].to_numpy()
        return pd.DataFrame([(int(f["view"][0]), k, int(ids[a]), int(ids[b]), int(ids[c])) for k, (a, b, c) in enumerate(fn(f))], columns=["view", "tri_id", "a", "b", "c"])

    return keyed.groupBy("view").applyInPandas(run, "view long, tri_id long, a long, b long, c long")


def delaunay(df: DataFrame) -> DataFrame:
    """Triangles (view, tri_id, a, b, c by pid) of each view's Delaunay mesh in the plane."""
    return _mesh(df, lambda f: triangulate(f[["X", "Y"]].to_numpy(float)), ["X", "Y"])


def _nearest(xyz: np.ndarray, radius: float, k: int) -> list[list[tuple[int, float]]]:
    """Index and distance of the rows not farther than the radius among each row's k nearest after the first, which is itself or in its place.

    Rows are halved into leaves; a leaf looks at those whose boxes can hold one of the k.
    """
    out: list[list[tuple[int, float]]] = [[] for _ in xyz]
    leaves, todo = [], [np.flatnonzero(np.isfinite(xyz).all(1))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves += [rows] if len(rows) else []
            continue
        p = xyz[rows]
        half = np.argpartition(p[:, np.argmax(p.max(0) - p.min(0))], len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    if not leaves:
        return out
    low, high = (np.stack([f(xyz[rows], 0) for rows in leaves]) for f in (np.min, np.max))
    for rows, a, b in zip(leaves, low, high, strict=True):
        gap = np.maximum(np.maximum(a - high, low - b), 0.0)
        bound = np.sqrt((gap * gap).sum(1)) * (1 - 1e-12)
        reach, many = radius, 1 + k // LEAF
        while True:  # enough of the nearest leaves first, for a bound of the k-th distance
            chosen = np.argsort(bound, kind="stable")[:many] if many < len(leaves) else np.arange(len(leaves))
            held = np.sort(np.concatenate([leaves[c] for c in chosen]))
            if len(held) > k or many >= len(leaves):
                break
            many *= 2
        for last in (False, True):
            if last:
                held = np.sort(np.concatenate([leaves[c] for c in np.flatnonzero(bound <= reach)]))
            d = np.sqrt(((xyz[rows][:, None] - xyz[held]) ** 2).sum(2))
            kth = np.partition(d, k, axis=1)[:, k] if len(held) > k else np.full(len(rows), math.inf)
            reach = min(reach, float(kth.max()))
        for i, row, far in zip(rows.tolist(), d, kth, strict=True):
            near = np.flatnonzero(row <= min(far, radius))
            near = near[np.argsort(row[near], kind="stable")][1 : k + 1]
            out[i] = [(j, v) for j, v in zip(held[near].tolist(), row[near].tolist(), strict=True) if v > 0]
    return out


def greedyprojection(df: DataFrame, radius: float, multiplier: float = 2.5, num_neighbors: int = 100, min_angle: float = math.pi / 18, max_angle: float = 2 * math.pi / 3, eps_angle: float = math.pi / 4) -> DataFrame:
    """Triangles grown over oriented points: each point's neighbours are projected on its tangent plane, and
    consecutive directions become triangles if their angle and normals allow and they overlap no triangle there is:
    an edge has two at most, on its two sides, and no edges cross in the plane."""

    least = math.cos(eps_angle)

    def fn(f: pd.DataFrame):
        xyz, nor = f[["X", "Y", "Z"]].to_numpy(float), f[["NormalX", "NormalY", "NormalZ"]].to_numpy(float).tolist()
        nearest, points = _nearest(xyz, radius, num_neighbors), xyz.tolist()
        opposite: dict[tuple[int, int], list[int]] = {}  # the third corners of an edge's triangles
        joined: dict[int, set[int]] = {}  # the points that a point has an edge to
        out, have = [], set()
        for i, ((x, y, z), (n0, n1, n2)) in enumerate(zip(points, nor, strict=True)):
            near = [(j, d) for j, d in nearest[i] if abs(n0 * nor[j][0] + n1 * nor[j][1] + n2 * nor[j][2]) >= least]
            if len(near) < 2:
                continue
            close = [j for j, d in near if d <= multiplier * near[0][1]]
            u0, u1, u2 = (0.0, n2, -n1) if abs(n0) < 0.9 else (-n2, 0.0, n0)
            size = math.sqrt(u0 * u0 + u1 * u1 + u2 * u2) or math.nan
            u0, u1, u2 = u0 / size, u1 / size, u2 / size
            v0, v1, v2 = n1 * u2 - n2 * u1, n2 * u0 - n0 * u2, n0 * u1 - n1 * u0
            at: dict[int, tuple[float, float]] = {}  # places in the point's plane

            def plane(j: int) -> tuple[float, float]:
                if j not in at:  # noqa: B023
                    a, b, c = points[j][0] - x, points[j][1] - y, points[j][2] - z  # noqa: B023
                    at[j] = (a * u0 + b * u1 + c * u2, a * v0 + b * v1 + c * v2)  # noqa: B023
                return at[j]  # noqa: B023

            def side(p: int, q: int, r: int) -> float:
                (px, py), (qx, qy), (rx, ry) = plane(p), plane(q), plane(r)  # noqa: B023
                return (qx - px) * (ry - py) - (qy - py) * (rx - px)

            edges_near: dict[tuple[int, int], tuple[float, float, float, float]] = {}

            def lay(c: int, d: int) -> None:
                edges_near[min(c, d), max(c, d)] = (*plane(c), *plane(d))  # noqa: B023

            def crossed(p: int, q: int) -> bool:
                """Whether an edge near the point crosses the one from p to q."""
                if not edges_near:  # noqa: B023
                    for c in {i, *close}:  # noqa: B023
                        for d in joined.get(c, ()):
                            lay(c, d)  # noqa: B023
                (px, py), (qx, qy) = plane(p), plane(q)  # noqa: B023
                wx, wy = qx - px, qy - py
                for (c, d), (cx, cy, dx, dy) in edges_near.items():  # noqa: B023
                    if (wx * (cy - py) - wy * (cx - px)) * (wx * (dy - py) - wy * (dx - px)) < 0 and c != p and c != q and d != p and d != q:
                        ex, ey = dx - cx, dy - cy
                        if (ex * (py - cy) - ey * (px - cx)) * (ex * (qy - cy) - ey * (qx - cx)) < 0:
                            return True
                return False

            def free(p: int, q: int, r: int) -> bool:
                """Whether the edge from p to q can have a triangle with the corner r."""
                there = opposite.get((min(p, q), max(p, q)), [])
                return not crossed(p, q) if not there else len(there) == 1 and side(p, q, there[0]) * side(p, q, r) < 0  # noqa: B023

            ring = sorted(close, key=lambda j: math.atan2(plane(j)[1], plane(j)[0]))  # noqa: B023
            for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
                p0, p1, p2 = points[a][0] - x, points[a][1] - y, points[a][2] - z
                q0, q1, q2 = points[b][0] - x, points[b][1] - y, points[b][2] - z
                turn = math.atan2((p1 * q2 - p2 * q1) * n0 + (p2 * q0 - p0 * q2) * n1 + (p0 * q1 - p1 * q0) * n2, p0 * q0 + p1 * q1 + p2 * q2)
                if not min_angle <= turn <= max_angle:
                    continue
                key = tuple(sorted((i, a, b)))
                edges = ((i, a, b), (a, b, i), (b, i, a))
                if key not in have and all(free(*e) for e in edges):
                    have.add(key)
                    for c, d, e in edges:
                        opposite.setdefault((min(c, d), max(c, d)), []).append(e)
                        joined.setdefault(c, set()).add(d)
                        joined.setdefault(d, set()).add(c)
                        if edges_near:
                            lay(c, d)
                    out.append((i, a, b))
        return out

    return _mesh(df, fn, ["X", "Y", "Z", "NormalX", "NormalY", "NormalZ"])


def faceraster(points: DataFrame, mesh: DataFrame, resolution: float, origin: tuple[float, float], max_triangle_edge_length: float = math.inf) -> DataFrame:
    """col, row and value of the cells (by centre) that triangles cover: barycentric Z of the first triangle."""
    corner = lambda n: points.select(F.col("pid").alias(n), *[F.col(c).cast("double").alias(f"{n}{c}") for c in ("X", "Y", "Z")])
    t = mesh.join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c")
    length = lambda p, q: F.sqrt(sum((F.pow(F.col(f"{p}{k}") - F.col(f"{q}{k}"), F.lit(2)) for k in "XYZ"), F.lit(0.0)))
    if max_triangle_edge_length != math.inf:
        t = t.where(F.greatest(length("a", "b"), length("b", "c"), length("c", "a")) <= max_triangle_edge_length)
    span = lambda k, o: F.sequence(F.ceil((F.least(*[F.col(f"{n}{k}") for n in "abc"]) - o) / resolution - 0.5), F.floor((F.greatest(*[F.col(f"{n}{k}") for n in "abc"]) - o) / resolution - 0.5))
    low = F.ceil((F.least("aX", "bX", "cX") - origin[0]) / resolution - 0.5) <= F.floor((F.greatest("aX", "bX", "cX") - origin[0]) / resolution - 0.5)
    high = F.ceil((F.least("aY", "bY", "cY") - origin[1]) / resolution - 0.5) <= F.floor((F.greatest("aY", "bY", "cY") - origin[1]) / resolution - 0.5)
    cells = t.where(low & high).select("*", F.explode(span("X", origin[0])).alias("col")).select("*", F.explode(span("Y", origin[1])).alias("row"))
    x, y = F.lit(origin[0]) + (F.col("col") + 0.5) * resolution, F.lit(origin[1]) + (F.col("row") + 0.5) * resolution
    det = (F.col("bY") - F.col("cY")) * (F.col("aX") - F.col("cX")) + (F.col("cX") - F.col("bX")) * (F.col("aY") - F.col("cY"))
    u = ((F.col("bY") - F.col("cY")) * (x - F.col("cX")) + (F.col("cX") - F.col("bX")) * (y - F.col("cY"))) / F.col("det")
    v = ((F.col("cY") - F.col("aY")) * (x - F.col("cX")) + (F.col("aX") - F.col("cX")) * (y - F.col("cY"))) / F.col("det")
    covered = cells.withColumn("det", det).where("det != 0").withColumns({"u": u, "v": v}).where("u >= 0 AND v >= 0 AND u + v <= 1")
    z = F.col("u") * F.col("aZ") + F.col("v") * F.col("bZ") + (1 - F.col("u") - F.col("v")) * F.col("cZ")
    return covered.groupBy(F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row")).agg(F.min_by(z, F.struct("view", "tri_id")).alias("value"))
