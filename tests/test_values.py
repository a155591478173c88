"""Operators that SQL cannot express, against independent plain versions and hand-checked answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import cluster, mesh, neighbors, order, partition, pointwise, terrain, voxel
from pointloom.plans import apps


def column(df, name, key="pid"):
    return [r[name] for r in df.orderBy(key).select(name).collect()]


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(12)
    return np.round(np.vstack([r.normal(0, 1, (60, 3)), r.normal(5, 0.5, (40, 3)) * [1, 1, 0.05]]), 3)


def nearest(p, k):
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    at = np.array([np.lexsort((np.arange(len(p)), row))[:k] for row in d2])
    return at, np.take_along_axis(d2, at, 1)


def spectrum(q):
    """Eigenvalues, largest first, and the direction of the least."""
    v, e = np.linalg.eigh(np.cov(q.T))
    return v[::-1], e[:, 0], e


def test_covariance_features(cloud, points):
    at, d2 = nearest(points, 10)
    got = neighbors.covariancefeatures(cloud(points.tolist()), mode="raw").orderBy("pid").collect()
    for i, r in enumerate(got):
        (a, b, c), _, e = spectrum(points[at[i]])
        spread = np.abs(e) @ np.array([c, b, a])
        want = {
            "Linearity": (a - b) / a, "Planarity": (b - c) / a, "Scattering": c / a, "Omnivariance": np.cbrt(a * b * c), "Anisotropy": (a - c) / a, "EigenvalueSum": a + b + c,
            "SurfaceVariation": c / (a + b + c), "Eigenentropy": -sum(x * math.log(x) for x in (a, b, c)), "Verticality": spread[2] / np.linalg.norm(spread),
            "DemantkeVerticality": 1 - abs(e[2, 0]), "Density": 11 / (4 / 3 * math.pi * math.sqrt(d2[i].max()) ** 3),
        }
        assert {k: r[k] for k in want} == pytest.approx(want, rel=2e-3, abs=1e-5)


def test_coplanar_rank_and_normals(cloud, points):
    flat = np.array([(x, y, 0.0) for x in range(6) for y in range(6)])
    line = np.array([(x, 0.0, 0.0) for x in range(12)])
    assert column(neighbors.approximatecoplanar(cloud(flat.tolist())), "Coplanar")[14] == 1  # an inner row
    assert set(column(neighbors.estimaterank(cloud(flat.tolist())), "Rank")) == {2}
    assert set(column(neighbors.estimaterank(cloud(line.tolist())), "Rank")) == {1}
    assert set(column(neighbors.estimaterank(cloud([(1, 1, 1)] * 10)), "Rank")) == {0}
    at, _ = nearest(points, 8)
    want = [int(v[1] > 25 * v[2] and 6 * v[1] > v[0]) for v, _, _ in (spectrum(points[a]) for a in at)]
    assert column(neighbors.approximatecoplanar(cloud(points.tolist())), "Coplanar") == want and 0 < sum(want) < len(want)
    got = neighbors.normal(cloud(points.tolist())).orderBy("pid").collect()
    for i, r in enumerate(got):
        v, n, _ = spectrum(points[at[i]])
        assert abs(np.dot(n, (r.NormalX, r.NormalY, r.NormalZ))) == pytest.approx(1, abs=1e-4) and r.NormalZ >= 0
        assert r.Curvature == pytest.approx(v[2] / v.sum(), rel=1e-2, abs=1e-5)


def test_optimal_neighbourhood(cloud, points):
    at, d2 = nearest(points, 14)
    got = neighbors.optimalneighborhood(cloud(points.tolist()), 6, 14).orderBy("pid").collect()
    for i, r in enumerate(got):
        entropy = {}
        for k in range(6, 15):
            p = spectrum(points[at[i, :k]])[0]
            p = p / p.sum()
            entropy[k] = -(p * np.log(p)).sum()
        assert entropy[r.OptimalKNN] == pytest.approx(min(entropy.values()), rel=1e-4)
        assert r.OptimalRadius == pytest.approx(math.sqrt(d2[i, r.OptimalKNN - 1]))


def test_plane_fit(cloud, points):
    pyramid = [(0, 0, 1), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0)]
    assert column(neighbors.planefit(cloud(pyramid), 4), "PlaneFit")[0] == pytest.approx(1)
    at, _ = nearest(points, 9)
    got = column(neighbors.planefit(cloud(points.tolist())), "PlaneFit")
    for i, v in enumerate(got):
        q = points[at[i, 1:]]
        _, n, _ = spectrum(q)
        d, m = abs((points[at[i, 0]] - q.mean(0)) @ n), np.abs((q - q.mean(0)) @ n).mean()
        assert v == pytest.approx(d / (d + m), abs=2e-3)


def test_miniball(cloud, points):
    cross = [(0, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]
    assert column(neighbors.miniball(cloud(cross), 6), "Miniball")[0] == pytest.approx(0)
    at, _ = nearest(points, 9)
    got = column(neighbors.miniball(cloud(points.tolist())), "Miniball")
    for i in range(0, len(points), 25):
        q = points[at[i, 1:]]
        c = q.mean(0)
        for t in range(20_000):  # ever smaller steps to the farthest point
            d = np.linalg.norm(q - c, axis=1)
            c = c + (q[d.argmax()] - c) / (t + 2)
        d, r = np.linalg.norm(points[at[i, 0]] - c), np.linalg.norm(q - c, axis=1).max()
        assert got[i] == pytest.approx(d / (d + 2 * r / math.sqrt(3)), abs=5e-3)


def test_m3c2_of_a_raised_plane(cloud):
    grid = [(x * 0.5, y * 0.5) for x in range(21) for y in range(21)]
    first, second = cloud([(x, y, 0) for x, y in grid]), cloud([(x, y, 0.75 + 0.01 * (i % 2)) for i, (x, y) in enumerate(grid)])
    r = neighbors.m3c2(first, second, cloud([(5, 5, 0), (100, 100, 0)]), 2.0, 1.0, 3.0).orderBy("pid").collect()
    inside = [z for i, (x, y) in enumerate(grid) if (x - 5) ** 2 + (y - 5) ** 2 <= 1 for z in [0.75 + 0.01 * (i % 2)]]
    assert (r[0].m3c2_count1, r[0].m3c2_count2) == (len(inside), len(inside))
    assert r[0].m3c2_distance == pytest.approx(np.mean(inside)) and r[0].m3c2_significant == 1
    assert r[0].m3c2_std_dev2 == pytest.approx(np.std(inside)) and r[0].m3c2_std_dev1 == pytest.approx(0, abs=1e-9)
    assert r[0].m3c2_uncertainty == pytest.approx(1.96 * math.sqrt(np.var(inside) / len(inside)))
    assert r[1].m3c2_distance is None and r[1].m3c2_count1 == 0


SLOPE = [(289814.15, 4320978.61, 170.76), (289814.64, 4320978.84, 170.76), (289815.12, 4320979.06, 170.75), (289815.60, 4320979.28, 170.74), (289816.08, 4320979.50, 170.68), (289816.56, 4320979.71, 170.66), (289817.03, 4320979.92, 170.63), (289817.53, 4320980.16, 170.62), (289818.01, 4320980.38, 170.61), (289818.50, 4320980.59, 170.58)]


def village():
    """A gentle slope with a house and a tree on it, and what of it is ground."""
    rows, ground = [], []
    for x, y in itertools.product(range(30), range(30)):
        house, tree = 8 <= x < 16 and 8 <= y < 16, (x - 23) ** 2 + (y - 6) ** 2 <= 4
        rows.append((x + 0.5, y + 0.5, 0.02 * x + (6.0 if house else 9.0 if tree else 0.0)))
        ground.append(not house and not tree)
    return rows, ground


@pytest.mark.parametrize("run", [terrain.smrf, terrain.pmf, terrain.csf, lambda df: apps.ground(df, denoise=False)], ids=["smrf", "pmf", "csf", "ground"])
def test_ground_of_a_village(cloud, run):
    rows, ground = village()
    got = [c == 2 for c in column(run(cloud(rows)), "Classification")]
    wrong = [rows[i] for i in range(len(rows)) if got[i] != ground[i]]
    assert len(wrong) <= 0.02 * len(rows), wrong[:5]
    assert set(column(run(cloud(SLOPE)), "Classification")) == {2}


def test_cloth_steps():
    """A cloth on flat land lies on it and spans pits, tight ones more than loose ones; missing nodes take those along their lines."""
    flat = terrain.fall(np.zeros((6, 6)), 3, 500, 0.65, False, 0.3)
    assert np.abs(flat).max() < 0.05
    pit = np.zeros((15, 15))
    pit[5:10, 5:10] = -20
    tight, loose = (terrain.fall(pit, r, 500, 0.65, False, 0.3)[7, 7] for r in (8, 1))
    assert -20 <= loose <= tight + 0.01 <= 0.06
    z = np.array([[np.nan, 1, np.nan], [np.nan, np.nan, np.nan], [5, np.nan, 7]])
    assert terrain._along_lines(z).tolist() == [[1, 1, 1], [5, 1, 7], [5, 7, 7]]


def test_sparse_surface_is_sequential(cloud, points):
    state = {}
    for i in sorted(range(len(points)), key=lambda i: (points[i, 2], i)):
        if i not in state:
            state[i] = 2
            for j in range(len(points)):
                if j not in state and ((points[i, :2] - points[j, :2]) ** 2).sum() < 0.25:
                    state[j] = 7
    assert column(terrain.sparsesurface(cloud(points.tolist()), 0.5), "Classification") == [state[i] for i in range(len(points))]


HAG = [(-2, 4, 20, 1), (4, 1, 20, 1), (2, 3, 20, 1), (4, 4, 20, 1), (0, 0, 0, 2), (3, 0, 10, 2), (5, 1, 10, 2), (3, 3, 4, 2), (0, 3, 10, 2), (1, 5, 10, 2)]


def test_heights_above_ground(cloud):
    df = cloud(HAG, "X", "Y", "Z", "Classification")
    assert column(terrain.hag_delaunay(df, 10), "HeightAboveGround") == pytest.approx([10, 11, 14, 16] + [0] * 6)
    assert column(neighbors.hag_nn(df, 2), "HeightAboveGround") == pytest.approx([10, 10, 14.8, 15] + [0] * 6)
    assert column(neighbors.hag_nn(df, 1), "HeightAboveGround")[:2] == pytest.approx([10, 10])


def test_chips(cloud, points):
    got = partition.chipper(cloud(points.tolist()), 13).groupBy("view").agg(F.collect_list("pid").alias("ids")).collect()
    chips = [sorted(r.ids) for r in got]
    want = []

    def cut(rows, borders):
        if len(borders) == 2:
            want.append(sorted(rows))
            return
        wide = [np.ptp([points[i][a] for i in rows]) for a in (0, 1)]
        axis = 0 if wide[0] > wide[1] else 1
        rows = sorted(rows, key=lambda i: (points[i][axis], i))
        mid = (len(borders) - 1) // 2
        n = borders[mid] - borders[0]
        cut(rows[:n], borders[: mid + 1])
        cut(rows[n:], borders[mid:])

    cut(list(range(len(points))), partition.chip_borders(len(points), 13))
    assert sorted(chips) == sorted(want) and max(map(len, chips)) <= 13


def test_shuffles_are_permutations(cloud, points):
    df = cloud(points.tolist()).withColumn("old", F.col("pid"))
    a, b = (column(order.randomize(df, s), "old") for s in (1, 2))
    assert sorted(a) == sorted(b) == list(range(len(points))) and a != b and a != sorted(a)
    assert column(order.randomize(df.repartition(5), 1), "old") == a


def test_dart_throwing(cloud, points):
    df = cloud(points.tolist())
    kept = points[[r.pid for r in voxel.relaxationdartthrowing(df, 12, 2.0, 0.8).collect()]]
    assert len(kept) == 12
    d = np.sqrt(((kept[:, None] - kept[None]) ** 2).sum(2))
    assert d[~np.eye(len(kept), dtype=bool)].min() > 0.3
    assert voxel.relaxationdartthrowing(df, 1000, 1.0).count() == len(points)
    chosen = []  # without a shuffle: passes in row order with ever smaller radii
    r = 2.0
    while len(chosen) < 12 and r >= 0.001:
        for i in range(len(points)):
            if len(chosen) < 12 and i not in chosen and all(((points[i] - points[j]) ** 2).sum() >= r * r for j in chosen):
                chosen.append(i)
        r *= 0.8
    assert sorted(x.pid for x in voxel.relaxationdartthrowing(df, 12, 2.0, 0.8, shuffle=False).collect()) == sorted(chosen)


def test_k_means(cloud, points):
    centres = [points[0]]
    while len(centres) < 4:
        centres.append(points[np.min([((points - c) ** 2).sum(1) for c in centres], 0).argmax()])
    for _ in range(10):
        label = np.argmin([((points - c) ** 2).sum(1) for c in centres], 0)
        centres = [points[label == i].mean(0) if (label == i).any() else centres[i] for i in range(4)]
    label = np.argmin([((points - c) ** 2).sum(1) for c in centres], 0)
    assert column(cluster.lloydkmeans(cloud(points.tolist()), 4), "ClusterID") == label.tolist()


def test_trees(cloud):
    r = np.random.default_rng(4)
    crowns = [(x + dx, y + dy, 12 - 2 * math.hypot(dx, dy)) for x, y in ((0, 0), (15, 0), (0, 20)) for dx, dy in r.normal(0, 1, (40, 2))]
    df = cloud([*crowns, (40, 40, 1)]).withColumn("HeightAboveGround", F.col("Z"))
    ids = column(cluster.litree(df, 10, 3.0), "ClusterID")
    of = [{i for i, (_, _, z) in zip(ids[k * 40 : k * 40 + 40], crowns[k * 40 : k * 40 + 40], strict=True) if z >= 3 and i} for k in range(3)]
    assert all(len(o) == 1 for o in of) and len(set.union(*of)) == 3 and ids[-1] == 0


def test_supervoxels(cloud):
    rows = [(1, 1, 0, 0, 1, 0), (2, 2, 0, 0, 1, 0), (4, 2, 0, 1, 1, 0), (5, 1, 0, 1, 1, 0), (1, 5, 0, 0, -1, 0), (2, 4, 0, 0, -1, 0), (4, 4, 0, 0, 1, 0), (5, 4, 0, 0, 1, 0)]
    ids = column(cluster.supervoxel(cloud(rows, "X", "Y", "Z", "NormalX", "NormalY", "NormalZ"), 3, 3), "ClusterID")
    assert len(set(ids)) == 4 and [ids[i] == ids[i + 1] for i in (0, 2, 4, 6)] == [True] * 4
    # a roof of two sides: no supervoxel has rows of both
    roof = [(x, y, min(x, 12 - x) * 1.0, *((-0.7071, 0, 0.7071) if x < 6 else (0.7071, 0, 0.7071))) for x in range(13) for y in range(6) if x != 6]
    ids = column(cluster.supervoxel(cloud(roof, "X", "Y", "Z", "NormalX", "NormalY", "NormalZ"), 8, 4.0), "ClusterID")
    sides = {}
    for i, r in zip(ids, roof, strict=True):
        sides.setdefault(i, set()).add(r[0] < 6)
    assert all(len(s) == 1 for s in sides.values()) and len(sides) > 3


def test_drift_finds_a_turn(cloud, points):
    a = 0.2
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    moved = (points - [0.1, 0.2, 0.3]) @ turn  # the turn back
    laid, found = cluster.cpd(cloud(points.tolist()), cloud(moved.tolist()))
    m = np.array(found["transform"]).reshape(4, 4)
    assert m[:3, :3] == pytest.approx(turn, abs=2e-2) and m[:3, 3] == pytest.approx([0.1, 0.2, 0.3], abs=5e-2)
    assert np.array([(r.X, r.Y, r.Z) for r in laid.orderBy("pid").collect()]) == pytest.approx(points, abs=0.1)


def test_registration_and_rasters_in_pipelines(cloud, spark):
    from pointloom.plans import pipeline

    grid = [(x, y, x * 0.5 + (y % 3)) for x in range(6) for y in range(6)]
    a, b = cloud(grid), cloud([(x + 0.02, y - 0.03, z) for x, y, z in grid])
    stages = [
        {"type": "readers.buffer", "tag": "a", "frame": "@a"}, {"type": "readers.buffer", "tag": "b", "frame": "@b"}, {"type": "filters.icp", "inputs": ["a", "b"]},
        {"type": "filters.faceraster", "inputs": ["a"], "resolution": 1.0, "origin": [0.0, 0.0]},
    ]
    assert pipeline.validate(stages)[2] == "filters.icp"
    out = pipeline.run(spark, stages, {"a": a, "b": b})
    assert out.reports["icp"].first().transform[3] == pytest.approx(-0.02, abs=1e-3)
    assert out.reports["faceraster"].count() == 25


def test_meshes_and_their_rasters(cloud, spark):
    df = cloud([(0, 0, 0), (4, 0, 4), (0, 4, 8), (4, 4, 12)])
    tri = mesh.delaunay(df)
    assert tri.count() == 2
    cells = {(r.col, r.row): r.value for r in mesh.faceraster(df, tri, 1.0, (0.0, 0.0)).collect()}
    assert cells == pytest.approx({(c, r): (c + 0.5) + 2 * (r + 0.5) for c in range(4) for r in range(4)})
    assert mesh.faceraster(df, tri, 1.0, (0.0, 0.0), 5.0).count() == 0
    flat = cloud([(x, y, 0, 0, 0, 1) for x in range(4) for y in range(4)], "X", "Y", "Z", "NormalX", "NormalY", "NormalZ")
    t = mesh.greedyprojection(flat, 1.6, 2.5).collect()
    at = {r.pid: (r.X, r.Y) for r in flat.collect()}
    area = sum(abs((at[r.b][0] - at[r.a][0]) * (at[r.c][1] - at[r.a][1]) - (at[r.c][0] - at[r.a][0]) * (at[r.b][1] - at[r.a][1])) / 2 for r in t)
    edges = [frozenset(e) for r in t for e in ((r.a, r.b), (r.b, r.c), (r.c, r.a))]
    assert area == pytest.approx(9) and all(edges.count(e) <= 2 for e in edges)


def test_georeference(cloud, spark):
    """A level scanner that looks north sees forward, right and down as north, east and down."""
    lon, lat, h = 0.3, 0.8, 500.0
    poses = spark.createDataFrame([(t, lon, lat, h, 0.0, 0.0, yaw, 0.0) for t, yaw in ((0.0, 0.0), (10.0, 0.0), (20.0, math.pi / 2))], "GpsTime double, X double, Y double, Z double, Roll double, Pitch double, Azimuth double, WanderAngle double")
    df = cloud([(5, 1), (5, 15), (-5, 1), (5, 99)], "Z", "GpsTime").withColumns({"X": F.lit(3.0), "Y": F.lit(4.0)})
    got = {r.pid: np.array([r.X, r.Y, r.Z]) for r in pointwise.georeference(df, poses).collect()}
    a, e2 = 6378137.0, 0.0066943799901413165
    n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    base = np.array([(n + h) * math.cos(lat) * math.cos(lon), (n + h) * math.cos(lat) * math.sin(lon), (n * (1 - e2) + h) * math.sin(lat)])
    east = np.array([-math.sin(lon), math.cos(lon), 0])
    north = np.array([-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)])
    down = -np.cross(east, north)
    assert got[0] == pytest.approx(base + 3 * north + 4 * east + 5 * down, abs=1e-5)
    assert got[2] == pytest.approx(base + 3 * north + 4 * east - 5 * down, abs=1e-5)
    s = math.sqrt(0.5)  # halfway to east
    assert got[1] == pytest.approx(base + 3 * (s * north + s * east) + 4 * (s * east - s * north) + 5 * down, abs=1e-5)
    assert got[3].tolist() == [3, 4, 5] and pointwise.georeference(df, poses, keep_unposed=False).count() == 3


def test_sensor_positions(cloud):
    """Pulses from one place: their lines meet there."""
    r = np.random.default_rng(6)
    rows = []
    for t in range(30):
        end = np.array([*r.uniform(-50, 50, 2), 0.0])
        way = (np.array([10.0, 20.0, 300.0]) - end) / 300
        rows += [(*(end + way * 12), t * 0.01, 1, 2), (*end, t * 0.01, 2, 2)]
    got = terrain.trajectory(cloud(rows, "X", "Y", "Z", "GpsTime", "ReturnNumber", "NumberOfReturns"), 1.0).collect()
    assert [(x.X, x.Y, x.Z) for x in got] == [pytest.approx((10, 20, 300), abs=1e-6)]


def test_null_conditions_keep_their_rows(spark):
    from pointloom.plans import pipeline

    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 9.0)], "pid long, X double")
    out = pipeline.run_filter(df, "assign", {"value": "X = 5"}, where="X > 3")
    assert {r.pid: r.X for r in out.collect()} == {0: 1.0, 1: None, 2: 5.0}


def test_face_raster_covers_flat_triangles_at_the_hull(cloud):
    df = cloud([(0, 0, 0), (1000, 0, 0), (500, 1000, 0), (500, 0.05, 7)])
    cells = mesh.faceraster(df, mesh.delaunay(df), 100.0, (0.0, -49.99)).where("row = 0").collect()  # centres at 0.01 above the edge
    assert sorted(r.col for r in cells) == list(range(10))


def test_dart_throwing_among_many_neighbours(cloud, spark):
    """30,000 rows that all lie within a radius of each other are no pairs; later rounds and batches take what one pass would."""
    import time

    df = spark.range(30_000).select(F.col("id").alias("pid"), *[(F.hash(F.lit(i), "id") / 2.0**32).alias(c) for i, c in enumerate("XYZ")])
    began = time.time()
    got = sorted(r.pid for r in voxel.relaxationdartthrowing(df, 40, 2.0, 0.25, shuffle=False).collect())
    assert time.time() - began < 60
    p, want, r = df.orderBy("pid").toPandas()[["X", "Y", "Z"]].to_numpy(), [], 2.0
    while len(want) < 40:
        for i in range(len(p)):
            if len(want) < 40 and i not in want and (not want or ((p[want] - p[i]) ** 2).sum(1).min() >= r * r):
                want.append(i)
        r *= 0.25
    assert got == sorted(want)


def test_zsmooth_among_many_neighbours(spark):
    """20,000 rows within a radius, some in one place, one without a height: no pairs are written, values are those of all pairs."""
    import time

    df = spark.range(20_000).select(F.col("id").alias("pid"), *[((F.hash(F.lit(i), "id") % 100) / 250.0).alias(c) for i, c in enumerate("XY")], F.when(F.col("id") != 7, F.hash("id") / 2.0**31).alias("Z"))
    began = time.time()
    got = {r.pid: r.Zsmooth for r in neighbors.zsmooth(df.unionByName(spark.createDataFrame([(20_000, 50.0, 0.0, 4.5)], df.schema)), 0.5, 30.0).collect()}
    assert time.time() - began < 60 and len(got) == 20_001 and got[20_000] == 4.5
    f = df.orderBy("pid").toPandas()
    x, y, z = f["X"].to_numpy(), f["Y"].to_numpy(), f["Z"].to_numpy()
    for i in (0, 7, 11, 19_999):
        near = ((x - x[i]) ** 2 + (y - y[i]) ** 2 < 0.25) & (np.arange(len(x)) != i) & ~np.isnan(z)
        assert got[i] == pytest.approx(np.quantile(z[near], 0.3), abs=1e-12)


def test_m3c2_among_many_neighbours(spark):
    """12,000 rows of each epoch within every core row's reach: no pairs are written, values are those of all pairs."""
    import time

    df = spark.range(24_000).select(F.col("id").alias("pid"), *[(F.hash(F.lit(i), "id") / 2.0**33).alias(c) for i, c in enumerate("XY")], (F.hash(F.lit(2), "id") / 2.0**36 + F.col("id") % 2 * 0.01).alias("Z"))
    began = time.time()
    got = {r.pid: r for r in neighbors.m3c2(df.where("pid % 2 = 0"), df.where("pid % 2 = 1"), df.where("pid % 4 = 0"), 0.3, 0.25, 0.5).collect()}
    assert time.time() - began < 60 and len(got) == 6_000
    p = df.orderBy("pid").toPandas()[["X", "Y", "Z"]].to_numpy()
    for i in (0, 4_000):
        near = p[::2][((p[::2] - p[i]) ** 2).sum(1) < 0.09]
        n = neighbors.eigen(near)[1][:, 0]
        n = -n if n[2] < 0 else n
        held = []
        for epoch in (p[::2], p[1::2]):
            t, d2 = (epoch - p[i]) @ n, ((epoch - p[i]) ** 2).sum(1)
            held.append(t[(abs(t) <= 0.5) & (d2 - t * t <= 0.0625)])
        assert (got[i].m3c2_count1, got[i].m3c2_count2) == (len(held[0]), len(held[1]))
        assert got[i].m3c2_distance == pytest.approx(held[1].mean() - held[0].mean(), abs=1e-9)


def test_greedy_projection_of_many_points(cloud):
    """Neighbours are those of all distances, ties and copies included, and 4,000 points take less time than checks of every pair."""
    import time

    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(size=(400, 3)), rng.integers(0, 4, (200, 3)).astype(float)])
    for radius, k in ((0.7, 12), (9.0, 3), (0.01, 5)):
        near = mesh._nearest(p, radius, k)
        for i in range(len(p)):
            d = np.linalg.norm(p - p[i], axis=1)
            assert [j for j, _ in near[i]] == [j for j in np.argsort(d, kind="stable")[1 : k + 1] if 0 < d[j] <= radius]
    flat = cloud([(x, y, 0, 0, 0, 1) for x, y in rng.uniform(0, 60, (4_000, 2))], "X", "Y", "Z", "NormalX", "NormalY", "NormalZ")
    began = time.time()
    tri = mesh.greedyprojection(flat, 3.0, 3.0, 12).collect()
    assert time.time() - began < 40
    sides = [tuple(sorted(e)) for t in tri for e in ((t.a, t.b), (t.b, t.c), (t.c, t.a))]
    assert len(tri) > 3_000 and max(sides.count(e) for e in set(sides[:300])) <= 2
