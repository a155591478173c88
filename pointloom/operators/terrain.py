"""Ground, heights and terrain.

Raster methods reduce the cloud to one value a cell first (a distributed aggregate), work on
the cells in one numpy task (``MOST_CELLS`` bounds it; larger clouds are tiled by ``view``
first) and join the cells' answers back to the points.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges
from ..plans.ordering import running_sum, with_rank
from ..scratch import materialize
from ..ship import ship
from .neighbors import AXES, knn, radius_pairs
from .partition import RETURN_GROUPS
from .voxel import greedy

MOST_CELLS = 40_000_000


def _eligible(df: DataFrame, returns: str | list[str] = ("last", "only"), ignore: str | None = None) -> Column:
    """Rows of the wanted returns that no range ignores; without return numbers all rows count."""
    c = F.lit(True)
    if "ReturnNumber" in df.columns and "NumberOfReturns" in df.columns:
        wanted = [returns] if isinstance(returns, str) else list(returns)
        any_ = (F.col("ReturnNumber") == 0) & (F.col("NumberOfReturns") == 0)
        for g in wanted:
            any_ = any_ | F.expr(RETURN_GROUPS[g])
        c = any_
    if ignore:
        c = c & ~ranges.condition(ignore)
    return c


def check_returns(df: DataFrame) -> None:
    """Mixed zero and other return numbers are an error."""
    if "ReturnNumber" in df.columns:
        t = df.agg(F.max((F.col("ReturnNumber") == 0).cast("int")).alias("z"), F.max((F.col("ReturnNumber") != 0).cast("int")).alias("o")).first()
        if t.z and t.o:
            raise ValueError("some return numbers are 0 and some are not")


def fill_nearest(z: np.ndarray, k: int = 8) -> np.ndarray:
    """Empty cells take the mean of their k nearest filled cells, found ring by ring."""
    out = z.copy()
    rows, cols = np.nonzero(np.isnan(z))
    if not len(rows) or np.isnan(z).all():
        return out
    h, w = z.shape
    for r, c in zip(rows, cols, strict=True):
        reach = 1
        while True:
            r0, r1, c0, c1 = max(0, r - reach), min(h, r + reach + 1), max(0, c - reach), min(w, c + reach + 1)
            part = z[r0:r1, c0:c1]
            rr, cc = np.nonzero(~np.isnan(part))
            d2 = (rr + r0 - r) ** 2 + (cc + c0 - c) ** 2
            whole = r0 == 0 and c0 == 0 and r1 == h and c1 == w
            if (d2 <= reach * reach).sum() >= k or whole:
                near = np.argsort(d2, kind="stable")[:k]
                out[r, c] = part[rr[near], cc[near]].mean()
                break
            reach *= 2
    return out


def _shifted(z: np.ndarray, fn, fill: float, times: int) -> np.ndarray:
    """``times`` steps of a cross-shaped (diamond) erosion or dilation."""
    for _ in range(times):
        p = np.pad(z, 1, constant_values=fill)
        z = fn.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
    return z


def opened(z: np.ndarray, radius: int) -> np.ndarray:
    return _shifted(_shifted(z, np.minimum, np.inf, radius), np.maximum, -np.inf, radius)


def _disk_opening(z: np.ndarray, radius: int) -> np.ndarray:
    yy, xx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    offsets = np.argwhere(yy**2 + xx**2 <= radius**2) - radius

    def pass_(a: np.ndarray, fn, fill: float) -> np.ndarray:
        p = np.pad(a, radius, constant_values=fill)
        h, w = a.shape
        out = None
        for dy, dx in offsets:
            part = p[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
            out = part.copy() if out is None else fn(out, part, out=out)
        return out

    return pass_(pass_(z, np.minimum, np.inf), np.maximum, -np.inf)


def progressive_mask(z: np.ndarray, cell: float, slope: float, window: float, previous_erosion: bool = True) -> np.ndarray:
    """Cells that openings of growing radius lower by more than the slope allows."""
    mask = np.zeros(z.shape, bool)
    last, eroded = z, z
    for radius in range(1, math.ceil(window / cell) + 1):
        eroded = _shifted(eroded, np.minimum, np.inf, 1)
        now = _shifted(eroded, np.maximum, -np.inf, radius)
        mask |= last - now > slope * cell * radius
        last = now
    return mask


def _grid(df: DataFrame, cell: float, agg: Column, where: Column, origin: tuple[float, float] | None = None):
    """The cells' values and the frame (origin, columns, rows)."""
    b = df.where(where).agg(F.min("X").alias("x0"), F.max("X").alias("x1"), F.min("Y").alias("y0"), F.max("Y").alias("y1")).first()
    if b.x0 is None:
        return None, None
    x0, y0 = origin or (b.x0, b.y0)
    cols, rows = int((b.x1 - x0) // cell) + 1, int((b.y1 - y0) // cell) + 1
    if cols * rows > MOST_CELLS:
        raise ValueError(f"{cols} x {rows} cells are more than {MOST_CELLS}; use larger cells, or tile the cloud")
    c = F.least(F.floor((F.col("X") - x0) / cell), F.lit(cols - 1)).cast("int").alias("c")
    r = F.least(F.floor((F.col("Y") - y0) / cell), F.lit(rows - 1)).cast("int").alias("r")
    return df.where(where).groupBy(c, r).agg(agg.alias("z")), (x0, y0, cols, rows, c, r)


def _on_cells(cells: DataFrame, frame, fn, schema: str) -> DataFrame:
    """``fn`` of the dense grid in one task; it returns a grid for each column of the schema."""
    _, _, cols, rows, _, _ = frame
    names = [p.split()[0] for p in schema.split(", ")]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        z = np.full((rows, cols), np.nan)
        z[f["r"], f["c"]] = f["z"]
        made = fn(z)
        rr, cc = np.mgrid[:rows, :cols]
        return pd.DataFrame({"c": cc.ravel().astype("int32"), "r": rr.ravel().astype("int32"), **{n: g.ravel() for n, g in zip(names, made, strict=True)}})

    ship(cells.sparkSession)
    return cells.groupBy().applyInPandas(run, f"c int, r int, {schema}")


def _classified(df: DataFrame, ground: Column, eligible: Column, ground_class: int, other_class: int, only_ground: bool) -> DataFrame:
    old = F.col("Classification") if "Classification" in df.columns else F.lit(0)
    if only_ground:
        return df.where(eligible & ground)
    return df.withColumn("Classification", F.when(eligible, F.when(ground, F.lit(ground_class)).otherwise(F.lit(other_class))).otherwise(old).cast("int"))


def smrf(df: DataFrame, cell: float = 1.0, slope: float = 0.15, window: float = 18.0, scalar: float = 1.25, threshold: float = 0.5, cut: float = 0.0, returns=("last", "only"), ignore: str | None = None, ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Ground by a simple morphological filter on the least Z of cells and a slope-scaled height threshold."""
    check_returns(df)
    where = _eligible(df, returns, ignore)
    cells, frame = _grid(df, cell, F.min("Z"), where)
    if cells is None:
        return df

    def fn(z):
        filled = fill_nearest(z)
        low = progressive_mask(-filled, cell, 5.0, cell)
        base = filled
        if cut > 0:
            step = math.ceil(cut / cell)
            net = np.zeros(z.shape, bool)
            net[::step, :] = net[:, ::step] = True
            base = np.where(net, _disk_opening(filled, 2 * step), filled)
        objects = progressive_mask(base, cell, slope, window)
        kept = np.where(low | objects | np.isnan(z), np.nan, z)
        dem = fill_nearest(kept) if not np.isnan(kept).all() else filled
        gy, gx = np.gradient(dem / cell) if min(dem.shape) > 1 else (np.zeros_like(dem), np.zeros_like(dem))
        return dem, np.hypot(gx, gy)

    made = _on_cells(cells, frame, fn, "dem double, steep double")
    x0, y0, cols, rows, _, _ = frame
    c = F.greatest(F.lit(0), F.least(F.floor((F.col("X") - x0) / cell), F.lit(cols - 1))).cast("int")
    r = F.greatest(F.lit(0), F.least(F.floor((F.col("Y") - y0) / cell), F.lit(rows - 1))).cast("int")
    joined = df.withColumn("c", c).withColumn("r", r).join(made, ["c", "r"], "left")
    ground = F.abs(F.col("Z") - F.col("dem")) <= threshold + scalar * F.col("steep")
    return _classified(joined, ground, where, ground_class, other_class, only_ground).drop("c", "r", "dem", "steep")


def pmf_schedule(cell_size: float, exponential: bool, initial_distance: float, max_distance: float, max_window_size: float, slope: float) -> list[tuple[int, float]]:
    """Radii (cells) and height thresholds of the growing windows."""
    out, last, i = [], 0.0, 0
    while True:
        half = 2.0**i if exponential else (i + 1.0)
        window = cell_size * (2 * half + 1)
        if window > max_window_size:
            return out
        height = initial_distance if not out else min(slope * (window - last) * cell_size + initial_distance, max_distance)
        out.append((int(half), height))
        last, i = window, i + 1


def pmf(df: DataFrame, cell_size: float = 1.0, exponential: bool = True, initial_distance: float = 0.15, max_distance: float = 2.5, max_window_size: float = 33.0, slope: float = 1.0, returns=("last", "only"), ignore: str | None = None, ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Ground by progressive morphological openings of the least-Z grid.

    The first grid floors the offset before dividing by the cell size, the later look-up divides first.
    """
    check_returns(df)
    where = _eligible(df, returns, ignore)
    b = df.where(where).agg(F.min("X").alias("x0"), F.max("X").alias("x1"), F.min("Y").alias("y0"), F.max("Y").alias("y1")).first()
    if b.x0 is None:
        return df
    cols, rows = int((b.x1 - b.x0) // cell_size) + 1, int((b.y1 - b.y0) // cell_size) + 1
    if cols * rows > MOST_CELLS:
        raise ValueError("too many cells")
    first = [F.least(F.floor(F.floor(F.col(a) - lo) / cell_size), F.lit(n - 1)).cast("int").alias(k) for a, lo, n, k in (("X", b.x0, cols, "c"), ("Y", b.y0, rows, "r"))]
    cells = df.where(where).groupBy(*first).agg(F.min("Z").alias("z"))
    schedule = pmf_schedule(cell_size, exponential, initial_distance, max_distance, max_window_size, slope)

    def fn(z):
        grids, now = [], fill_nearest(z, 1)
        for radius, _ in schedule:
            now = opened(now, radius)
            grids.append(now)
        return (_rows(grids, z.size),)

    def _rows(grids, n):
        out = np.empty(n, dtype=object)
        stacked = np.stack([g.ravel() for g in grids], 1) if grids else np.zeros((n, 0))
        for i in range(n):
            out[i] = stacked[i]
        return out

    made = _on_cells(cells, (b.x0, b.y0, cols, rows, None, None), fn, "levels array<double>")
    later = {k: F.greatest(F.lit(0), F.least(F.floor((F.col(a) - lo) / cell_size), F.lit(n - 1))).cast("int") for a, lo, n, k in (("X", b.x0, cols, "c"), ("Y", b.y0, rows, "r"))}
    joined = df.withColumns(later).join(made, ["c", "r"], "left")
    ground = F.lit(True)
    for i, (_, height) in enumerate(schedule):
        ground = ground & (F.col("Z") - F.element_at("levels", i + 1) < height)
    return _classified(joined, ground, where, ground_class, other_class, only_ground).drop("c", "r", "levels")


def _along_lines(z: np.ndarray) -> np.ndarray:
    """Missing cells take the next known one of their row (to the right, else to the left), else of their column (below, else above), else the nearest."""

    def before(g: np.ndarray) -> np.ndarray:
        """The last known value up to each place of a row."""
        at = np.maximum.accumulate(np.where(np.isnan(g), -1, np.arange(g.shape[1])), axis=1)
        return np.where(at >= 0, np.take_along_axis(g, np.maximum(at, 0), 1), np.nan)

    out = z
    for found in (before(z[:, ::-1])[:, ::-1], before(z), before(z.T).T, before(z[::-1].T).T[::-1]):
        out = np.where(np.isnan(out), found, out)
    return fill_nearest(out, 1) if np.isnan(out).any() else out


def _regions(mask: np.ndarray) -> np.ndarray:
    """A label for each cell of the mask: the least index in its region of cells with common sides."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        p = np.pad(label, 1, constant_values=mask.size)
        near = np.minimum.reduce([label, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        near = np.where(mask, near, mask.size)
        near = np.append(near.ravel(), mask.size)[near]  # and the label of that cell
        if (near == label).all():
            return label
        label = near


# Fixed values of the cloth: damping and gravity, the shares of a height difference that one or both nodes give up a round
# of rigidness, its margin (nodes), the fall that counts as rest, and the regions that are not smoothed.
DAMPING, GRAVITY, ONE_KEEPS, BOTH_KEEP, MARGIN, REST, SMALL_REGION = 0.01, 0.2, 0.7, 0.4, 2, 0.005, 50
#: Nodes are tied to those next to them and to the next but one, along axes and diagonals.
TIES = ((0, 1), (1, 0), (1, 1), (1, -1), (0, 2), (2, 0), (2, 2), (2, -2))


def fall(under: np.ndarray, rigidness: int, iterations: int, step: float, smooth: bool, hdiff: float) -> np.ndarray:
    """Where a cloth comes to rest that falls on the heights ``under``."""
    cloth = np.full(under.shape, np.max(under) + 0.05)
    before, movable = cloth.copy(), np.ones(under.shape, bool)
    one, both = (1 - ONE_KEEPS**rigidness, (1 - BOTH_KEEP**rigidness) / 2) if rigidness < 15 else (1.0, 0.5)
    rows, cols = under.shape

    def tie(dr: int, dc: int) -> None:
        # pairs in two turns, so that no node is in two of one turn
        for turn in (0, 1):
            r, c = np.arange(rows - dr), np.arange(max(0, -dc), cols - max(0, dc))
            if dr:
                r = r[r // dr % 2 == turn]
            else:
                c = c[c // dc % 2 == turn]
            a, b = np.ix_(r, c), np.ix_(r + dr, c + dc)
            d = cloth[b] - cloth[a]
            cloth[a] += d * np.where(movable[a], np.where(movable[b], both, one), 0.0)
            cloth[b] -= d * np.where(movable[b], np.where(movable[a], both, one), 0.0)

    for _ in range(iterations):
        moved = cloth + (cloth - before) * (1 - DAMPING) - GRAVITY * step**4
        before, cloth = cloth, np.where(movable, moved, cloth)
        for _ in range(2):  # each tie pulls from both its ends
            for dr, dc in TIES:
                tie(dr, dc)
        fell = np.abs(cloth - before)[movable].max(initial=0.0)
        hit = cloth < under
        cloth = np.where(hit, under, cloth)
        movable &= ~hit
        if 0 < fell < REST or not movable.any():
            break
    if smooth and movable.any():
        label = _regions(movable)
        large = movable & (np.bincount(label.ravel(), minlength=label.size + 1)[label] > SMALL_REGION)
        while True:
            p, h = np.pad(~movable, 1), np.pad(under, 1, constant_values=np.inf)
            sides = ((slice(None, -2), slice(1, -1)), (slice(2, None), slice(1, -1)), (slice(1, -1), slice(None, -2)), (slice(1, -1), slice(2, None)))
            drop = large & movable & np.logical_or.reduce([p[s] & (np.abs(under - h[s]) < hdiff) for s in sides])
            if not drop.any():
                break
            cloth, movable = np.where(drop, under, cloth), movable & ~drop
    return cloth


def csf(df: DataFrame, resolution: float = 1.0, threshold: float = 0.5, rigidness: int = 3, iterations: int = 500, step: float = 0.65, smooth: bool = True, hdiff: float = 0.3, returns=("last", "only"), ignore: str | None = None, ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Ground by a cloth that falls on the cloud turned upside down.

    A node's obstacle is the row nearest to it; a row is ground if the cloth, between the four nodes around it, comes near.
    """
    check_returns(df)
    where = _eligible(df, returns, ignore)
    b = df.where(where).agg(F.min("X").alias("x0"), F.max("X").alias("x1"), F.min("Y").alias("y0"), F.max("Y").alias("y1")).first()
    if b.x0 is None:
        return df
    x0, y0 = b.x0 - MARGIN * resolution, b.y0 - MARGIN * resolution
    cols, rows = int((b.x1 - b.x0) // resolution) + 2 * MARGIN, int((b.y1 - b.y0) // resolution) + 2 * MARGIN
    if cols * rows > MOST_CELLS:
        raise ValueError(f"{cols} x {rows} nodes are more than {MOST_CELLS}; use a coarser cloth, or tile the cloud")
    fx, fy = (F.col("X") - x0) / resolution, (F.col("Y") - y0) / resolution
    c, r = F.floor(fx + 0.5).cast("int"), F.floor(fy + 0.5).cast("int")
    away = F.pow(fx - F.floor(fx + 0.5), F.lit(2)) + F.pow(fy - F.floor(fy + 0.5), F.lit(2))
    nodes = df.where(where).groupBy(c.alias("c"), r.alias("r")).agg(F.min_by(-F.col("Z"), F.struct(away, "pid")).alias("z"))

    def fn(z):
        cloth = np.pad(fall(_along_lines(z), rigidness, iterations, step, smooth, hdiff), ((0, 1), (0, 1)), mode="edge")
        return cloth[:-1, :-1], cloth[:-1, 1:], cloth[1:, :-1], cloth[1:, 1:]

    made = materialize(_on_cells(nodes, (x0, y0, cols, rows, None, None), fn, "__a double, __b double, __d double, __e double"))
    inside = {"c": F.greatest(F.lit(0), F.least(F.floor(fx), F.lit(cols - 1))).cast("int"), "r": F.greatest(F.lit(0), F.least(F.floor(fy), F.lit(rows - 1))).cast("int")}
    joined = df.withColumns(inside).join(made, ["c", "r"], "left")
    u, v = fx - F.col("c"), fy - F.col("r")
    cloth = F.col("__a") * (1 - u) * (1 - v) + F.col("__b") * u * (1 - v) + F.col("__d") * (1 - u) * v + F.col("__e") * u * v
    ground = F.abs(cloth + F.col("Z")) < threshold
    return _classified(joined, ground, where, ground_class, other_class, only_ground).drop("c", "r", "__a", "__b", "__d", "__e")


def elm(df: DataFrame, cell: float = 10.0, threshold: float = 1.0, class_: int = 7) -> DataFrame:
    """Low noise: in each cell, from the lowest row up, until the gap to the next is small; the last row never is."""
    b = df.agg(F.min("X").alias("x"), F.min("Y").alias("y")).first()
    keys = [F.floor(F.floor(F.col(a) - lo) / cell).alias(k) for a, lo, k in (("X", b.x or 0.0, "__c"), ("Y", b.y or 0.0, "__r"))]
    w = Window.partitionBy("__c", "__r").orderBy("Z", "pid")
    gap = F.lead("Z").over(w) - F.col("Z")
    rows = df.select("*", *keys).withColumn("__far", F.coalesce((gap >= threshold).cast("int"), F.lit(0)))
    all_far = F.min("__far").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    old = F.col("Classification") if "Classification" in df.columns else F.lit(0)
    return rows.withColumn("Classification", F.when(all_far, F.lit(class_)).otherwise(old)).drop("__c", "__r", "__far")


def skewnessbalancing(df: DataFrame, ground_class: int = 2, other_class: int = 1, only_ground: bool = False) -> DataFrame:
    """Rows by height up to the last place where their running skewness turns from negative to positive are ground.

    Sums are of heights above the lowest row: the first rows lie near it, so that their moments are not differences of large sums.
    """
    ranked = with_rank(df, "Z", "pid")
    z = F.col("Z").cast("double")
    z = z - (F.min(z).over(Window.partitionBy("view")) if "view" in df.columns else F.lit(df.agg(F.min(z)).first()[0] or 0.0))
    for i in (1, 2, 3):
        ranked = running_sum(ranked, F.pow(z, F.lit(i)) if i > 1 else z, f"__s{i}")
    n = F.col("rank") + 1.0
    m = F.col("__s1") / n
    m2 = F.col("__s2") / n - m * m
    m3 = F.col("__s3") / n - 3 * m * F.col("__s2") / n + 2 * m * m * m
    ranked = materialize(ranked.withColumn("__skew", F.when(m2 > 1e-300, m3 / F.pow(m2, 1.5)).otherwise(0.0)))
    from ..plans.ordering import previous

    crossed = previous(ranked.select("rank", "__skew", *(["view"] if "view" in df.columns else [])), ["__skew"]).where((F.col("prev___skew") < 0) & (F.col("__skew") > 0)).agg(F.max("rank")).first()[0]
    top = crossed if crossed is not None else ranked.count()
    out = _classified(ranked, F.col("rank") < top, F.lit(True), ground_class, other_class, only_ground)
    return out.drop("rank", "__s1", "__s2", "__s3", "__skew")


def sparsesurface(df: DataFrame, radius: float = 1.0, ground_class: int = 2, low_point_class: int = 7) -> DataFrame:
    """From the lowest row up, an unlabelled row becomes ground and its unlabelled neighbours in the plane low points."""
    ground = greedy(df.select("pid", F.col("Z").cast("double").alias("o")), radius_pairs(df, df, radius, 2), "o").withColumn("__g", F.lit(True))
    return df.join(ground, "pid", "left").withColumn("Classification", F.when(F.col("__g"), ground_class).otherwise(low_point_class)).drop("__g")


def _barycentric(tri: np.ndarray, p: np.ndarray) -> np.ndarray | None:
    a = np.array([[*tri[0], 1], [*tri[1], 1], [*tri[2], 1]]).T
    det = np.linalg.det(a)
    return np.linalg.solve(a, [*p, 1]) if abs(det) > 1e-12 else None


def hag_delaunay(df: DataFrame, count: int = 10, allow_extrapolation: bool = True, class_: int = 2) -> DataFrame:
    """HeightAboveGround against the triangle of the nearest ground rows' Delaunay triangulation; else the nearest one's Z."""
    from .mesh import triangulate

    ground, others = df.where(F.col("Classification") == class_), df.where(F.col("Classification") != class_)
    near = knn(others, ground, max(3, count), 2, keep=AXES).groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("d2", "nid", *[F.col(f"n_{c}").cast("double").alias(c.lower()) for c in AXES]))).alias("near"))
    rows = others.select("pid", "X", "Y", "Z").join(near, "pid")

    def run(frames):
        for f in frames:
            out = []
            for x, y, z, near_ in zip(f["X"], f["Y"], f["Z"], f["near"], strict=True):
                g = np.array([(p["x"], p["y"], p["z"]) for p in near_], float)
                found = None
                if len(g) >= 3:
                    for t in triangulate(g[:, :2]):
                        b = _barycentric(g[list(t), :2], np.array((x, y)))
                        if b is not None and (b >= -1e-9).all():
                            found = float(b @ g[list(t), 2])
                            break
                if found is None:
                    found = float(g[0, 2]) if len(g) and allow_extrapolation else float(z)
                out.append(float(z) - found)
            yield pd.DataFrame({"pid": f["pid"], "HeightAboveGround": out})

    ship(df.sparkSession)
    made = rows.mapInPandas(run, "pid long, HeightAboveGround double")
    return df.drop("HeightAboveGround").join(made, "pid", "left").fillna(0.0, ["HeightAboveGround"])


def hag_dem(df: DataFrame, raster: DataFrame, transform: tuple[float, float, float, float], band: int = 1, zero_ground: bool = True, min_clamp: float | None = None, max_clamp: float | None = None, nodata_hag: float = 0.0, class_: int = 2) -> DataFrame:
    """HeightAboveGround against a raster, with clamps; a value for rows off it."""
    left, top, w, h = transform
    keyed = df.withColumn("__c", F.floor((F.col("X") - left) / w).cast("int")).withColumn("__r", F.floor((F.lit(top) - F.col("Y")) / h).cast("int"))
    joined = keyed.join(raster.select(F.col("col").alias("__c"), F.col("row").alias("__r"), F.col(f"band{band}").alias("__v")), ["__c", "__r"], "left")
    hag = F.col("Z") - F.col("__v")
    if min_clamp is not None:
        hag = F.greatest(hag, F.lit(min_clamp))
    if max_clamp is not None:
        hag = F.least(hag, F.lit(max_clamp))
    hag = F.when(F.col("__v").isNull(), F.lit(nodata_hag)).otherwise(hag)
    if zero_ground and "Classification" in df.columns:
        hag = F.when(F.col("Classification") == class_, 0.0).otherwise(hag)
    return joined.withColumn("HeightAboveGround", hag).drop("__c", "__r", "__v")


def trajectory(df: DataFrame, dts: float = 1.0, minsep: float = 0.01) -> DataFrame:
    """Sensor positions: for each slot of time, the point nearest (by least squares) to the lines through the first and last return of pulses."""
    ends = df.where("NumberOfReturns > 1").groupBy("GpsTime").agg(F.min_by(F.struct(*AXES), "ReturnNumber").alias("a"), F.max_by(F.struct(*AXES), "ReturnNumber").alias("b"))
    d = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in AXES]
    length = F.sqrt(sum((v * v for v in d), F.lit(0.0)))
    lines = ends.withColumn("len", length).where(F.col("len") >= minsep).select(F.floor(F.col("GpsTime") / dts).alias("slot"), "GpsTime", *[F.col(f"a.{c}").alias(c) for c in AXES], *[(v / F.col("len")).alias(f"d{c}") for v, c in zip(d, AXES, strict=True)])
    sums = []
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES):
            m = F.lit(1.0 if i == j else 0.0) - F.col(f"d{a}") * F.col(f"d{b}")
            sums += [F.sum(m).alias(f"m{i}{j}"), F.sum(m * F.col(b)).alias(f"v{i}{j}")]
    slots = lines.groupBy("slot").agg(F.avg("GpsTime").alias("GpsTime"), F.count("*").alias("n"), *sums).where("n > 1")

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                m = np.array([[getattr(r, f"m{i}{j}") for j in range(3)] for i in range(3)])
                v = np.array([sum(getattr(r, f"v{i}{j}") for j in range(3)) for i in range(3)])
                x = np.linalg.lstsq(m, v, rcond=None)[0]
                out.append((r.GpsTime, *map(float, x)))
            yield pd.DataFrame(out, columns=["GpsTime", *AXES])

    return slots.mapInPandas(run, "GpsTime double, X double, Y double, Z double")
